"""Cross-tokenizer alignment by pointer jumping.

Both tokenizers cut the same bytes. Tokens that overlap, directly or through
others, form a group; groups are cut where tokens of both end together. Every
token points to its farthest-right overlapping token of the other side (a last
token of a group on side B points to itself), and the successors are doubled,
``s = s[s]`` for all tokens of a batch at once, until nothing changes: each
token then names the terminal token of its component, which labels its group.
The number of steps is the logarithm of the longest chain.

Links are the A-B token pairs of a group. An id pair counts the documents that
hold it linked. Documents are handled in blocks of some megabytes: a block
lists its distinct pairs once, with their document numbers; these are summed
over all blocks, and each block gets back the counts of its own pairs. A pair
that every document holds is therefore one row per block, not per document, and
the join with the counts can be split by adaptive execution. Nothing but the
highest count per A id (at most the vocabulary's size) is broadcast.

Edge cases: texts that are null, empty, no valid UTF-8, or whose joined tokens
differ from the text have no tokens: zeros and an empty ``groups``. Repeated
rows and ids are documents of their own. A very long text is a block of its own;
a group with very many tokens is handled in pieces, by its distinct ids and
their multiplicities. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, save
from .vocab import TextEncoder, byte_encoder, default_path, piece_encoder

BLOCK_BYTES = 8 << 20                           # text of one block
SLICE_BYTES = 1 << 20                           # text aligned at once
LINKS = 1 << 20                                 # links written out at once

DOC = ("n_a", "n_b", "n_groups", "n_links")
_ROWS = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, packed binary, "
         "pairs array<bigint>, docs array<int>")


@functools.lru_cache(maxsize=4)
def _tables(path_a: str, path_b: str):
    """(encoder of both, token lengths and strings of both sides)."""
    a, b = byte_encoder(path_a), piece_encoder(path_b)
    n_a, n_b = len(a.bytes), len(b.bytes)
    written = ([f"{i}," for i in range(n_a)] + [f"{i}|" for i in range(n_a)]
               + [f"{i}," for i in range(n_b)] + [f"{i};" for i in range(n_b)])
    return TextEncoder(a, b), a.sizes, b.sizes, written


def jump(succ: np.ndarray) -> np.ndarray:
    """Terminal of every node: successor doubling until nothing changes."""
    while True:
        further = succ[succ]
        if np.array_equal(further, succ):
            return succ
        succ = further


def groups(end_a: np.ndarray, end_b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray):
    """Group number of every A and every B token (ends are byte offsets over
    all documents of a batch; both sides cover the same bytes)."""
    n_a, n_b = len(end_a), len(end_b)
    over_b = np.repeat(np.arange(n_b), len_b)[end_a - 1]        # the token at a token's last byte reaches farthest
    over_a = np.repeat(np.arange(n_a), len_a)[end_b - 1]
    own = np.arange(n_a, n_a + n_b)
    last = jump(np.concatenate([n_a + over_b, np.where(end_a[over_a] > end_b, over_a, own)]))
    number = np.cumsum(last[n_a:] == own) - 1
    return number[last[:n_a] - n_a], number[last[n_a:] - n_a]


def _pairs(ids_a, ids_b, first_a, count_a, first_b, count_b, doc, n_b, space):
    """(distinct doc * space + a * n_b + b, how often) over all links."""
    links = count_a * count_b
    keys, times = [], []
    single = (count_a == 1) & (count_b == 1)
    keys.append(doc[single] * space + ids_a[first_a[single]] * n_b + ids_b[first_b[single]])
    rest = np.flatnonzero(~single & (links <= LINKS))
    part = np.cumsum(links[rest]) // LINKS
    for some in np.split(rest, np.flatnonzero(np.diff(part)) + 1) if len(rest) else []:
        n = links[some]
        row = np.repeat(some, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = count_b[row]
        keys.append(doc[row] * space + ids_a[first_a[row] + at // wide] * n_b + ids_b[first_b[row] + at % wide])
    flat = np.concatenate(keys)
    found, often = np.unique(flat, return_counts=True)
    keys, times = [found], [often]
    for g in np.flatnonzero(links > LINKS):
        a, ma = np.unique(ids_a[first_a[g]:first_a[g] + count_a[g]], return_counts=True)
        b, mb = np.unique(ids_b[first_b[g]:first_b[g] + count_b[g]], return_counts=True)
        keys.append((doc[g] * space + a[:, None] * n_b + b).ravel())
        times.append((ma[:, None] * mb).ravel())
    if len(keys) > 1:
        found, back = np.unique(np.concatenate(keys), return_inverse=True)
        often = np.zeros(len(found), np.int64)
        np.add.at(often, back, np.concatenate(times))
    return found, often


def _spread(per_group: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Sums over the groups of every document."""
    total = np.concatenate([[0], np.cumsum(per_group)])
    cut = np.searchsorted(doc, np.arange(n_docs + 1))
    return total[cut[1:]] - total[cut[:-1]]


def _slice(raws: list[bytes | None], path_a: str, path_b: str, hashed: bool):
    """Rows of one slice of documents, and the distinct pairs of each as one
    array (a pair appears once per document)."""
    import zstandard
    both, size_a, size_b, written = _tables(path_a, path_b)
    texts = []
    for raw in raws:
        try:
            texts.append((raw or b"").decode())
        except UnicodeDecodeError:
            texts.append("")
    blob_a, blob_b = zip(*both.encode(texts))
    good = [i for i, (a, b) in enumerate(zip(blob_a, blob_b)) if a and b]
    rows = [(0, 0, 0, 0, "", None)] * len(raws)
    if not good:
        return rows, np.zeros(0, np.int64)
    n_a, n_b = np.array([len(blob_a[i]) // 4 for i in good]), np.array([len(blob_b[i]) // 4 for i in good])
    ids_a = np.frombuffer(b"".join([blob_a[i] for i in good]), np.int32).astype(np.int64)
    ids_b = np.frombuffer(b"".join([blob_b[i] for i in good]), np.int32).astype(np.int64)
    len_a, len_b = size_a[ids_a], size_b[ids_b]
    group_a, group_b = groups(np.cumsum(len_a), np.cumsum(len_b), len_a, len_b)
    count_a, count_b = np.bincount(group_a), np.bincount(group_b)
    end_a, end_b = np.cumsum(count_a), np.cumsum(count_b)
    first_a, first_b = end_a - count_a, end_b - count_b
    doc = np.repeat(np.arange(len(good)), n_a)[first_a]         # document of every group
    n_groups = np.bincount(doc, minlength=len(good))
    n_links = _spread(count_a * count_b, doc, len(good))
    # tokens in the order of the groups, A before B, with what follows each
    order = np.empty(len(ids_a) + len(ids_b), np.int64)
    at_a, at_b = np.arange(len(ids_a)), np.arange(len(ids_b))
    order[at_a + first_b[group_a]] = ids_a + len(size_a) * (at_a + 1 == end_a[group_a])
    order[at_b + end_a[group_b]] = 2 * len(size_a) + ids_b + len(size_b) * (at_b + 1 == end_b[group_b])
    strings = list(map(written.__getitem__, order.tolist()))
    space = len(size_a) * len(size_b)
    found, often = _pairs(ids_a, ids_b, first_a, count_a, first_b, count_b, doc, len(size_b), space)
    owner, pairs = found // space, found % space
    cut = np.searchsorted(owner, np.arange(len(good) + 1))
    stop = np.cumsum(n_a + n_b)
    pack = zstandard.ZstdCompressor(level=1).compress
    for k, i in enumerate(good):
        own = "".join(strings[stop[k] - n_a[k] - n_b[k]:stop[k]])[:-1]
        lo, hi = cut[k], cut[k + 1]
        step = np.diff(pairs[lo:hi], prepend=0)
        packed = pack(step.astype("<u8").view("u1").reshape(-1, 8).T.tobytes() + often[lo:hi].astype("<u4").tobytes())
        rows[i] = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]),
                   hashlib.sha256(own.encode()).hexdigest() if hashed else own, packed)
    return rows, pairs


def unpack(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, how often linked) of a document; pairs ascend."""
    if blob is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // 12
    step = np.ascontiguousarray(raw[:8 * n].reshape(8, n).T).view("<i8").ravel()
    return np.cumsum(step), raw[8 * n:].view("<u4").astype(np.int64)


def _align(batches, path_a: str, path_b: str, hashed: bool, block_bytes: int):
    """Document rows, and behind each block's documents its row of pairs."""
    from pyspark import TaskContext
    block, held, pairs = TaskContext.get().partitionId() << 32, 0, []
    names = [c.split(" ")[0] for c in _ROWS.split(", ")]
    types = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def rows_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def close():
        found, docs = np.unique(np.concatenate(pairs), return_counts=True) if pairs else (np.zeros(0), np.zeros(0))
        if len(found):
            yield rows_of([(block, None, None, None, None, None, None, None, found.astype(np.int64).tolist(),
                            docs.astype(np.int32).tolist())])

    for batch in batches:
        ids, raws = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        a = 0
        while a < len(raws):
            b, size = a, 0
            while b < len(raws) and (b == a or size + len(raws[b] or b"") <= SLICE_BYTES):
                size += len(raws[b] or b"")
                b += 1
            if held and held + size > block_bytes:
                yield from close()
                block, held, pairs = block + 1, 0, []
            rows, found = _slice(raws[a:b], path_a, path_b, hashed)
            yield rows_of([(block, i, *r, None, None) for i, r in zip(ids[a:b], rows)])
            pairs.append(found)
            held += size
            a = b
    yield from close()


def _score(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """Adds n_best and count_sum to the documents of one block."""
    pair = np.asarray(counts.column("pair"))
    order = np.argsort(pair)
    pair, n = pair[order], np.asarray(counts.column("n"))[order]
    best = np.asarray(counts.column("best").cast(pa.int8()))[order].astype(np.int64)
    n_best, count_sum = [], []
    for blob in docs.column("packed").to_pylist():
        own, often = unpack(blob)
        at = np.searchsorted(pair, own)
        n_best.append(int((often * best[at]).sum()) if len(own) else 0)
        count_sum.append(int((often * n[at]).sum()) if len(own) else 0)
    out = docs.select(["doc_id", *DOC, "groups"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column(
        "count_sum", pa.array(count_sum, pa.int64()))


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): documents that hold a pair linked, and whether no other
    pair of its A id has more. ``pair`` is ``A id * size_b + B id``."""
    counts, _ = save(aligned.where("pairs IS NOT NULL")
                     .select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
                     .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n")))
    a = F.expr(f"pair div {size_b}").alias("a")
    top = counts.groupBy(a).agg(F.max("n").alias("top"))
    # at most one row per entry of vocabulary A
    return (counts.select(a, "pair", "n").join(F.broadcast(top), "a")
            .select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, hashed: bool = False,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links,
    groups, n_best, count_sum.

    ``groups`` is ``a1,a2|b1;a3|b2,b3`` (ids of both sides per group), or with
    ``hashed`` its sha256, so that the long string is not moved on."""
    path_a, path_b = path_a or default_path("byte_bpe_50k.json"), path_b or default_path("piece_bpe_32k.model")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    aligned, aligned_path = save(source.mapInArrow(functools.partial(
        _align, path_a=path_a, path_b=path_b, hashed=hashed, block_bytes=block_bytes), _ROWS))
    size_b = len(piece_encoder(path_b).bytes)
    counts, counts_path = save(pair_counts(aligned, size_b))
    own = aligned.where("pairs IS NOT NULL").select(F.col("block").alias("own"), F.explode("pairs").alias("pair"))
    found = own.join(counts, "pair").select("own", "pair", "n", "best")
    rows = aligned.where("pairs IS NULL").select("block", "doc_id", *DOC, "groups", "packed")
    out, _ = save(rows.groupBy("block").cogroup(found.groupBy("own")).applyInArrow(
        _score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, "
                "count_sum long"))
    remove(docs.sparkSession, aligned_path, counts_path)
    return out

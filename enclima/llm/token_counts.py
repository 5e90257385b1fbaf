"""Token counts at every prefix of a text, by prefix dynamic programming.

The encoding of a prefix of a piece ends in exactly one token, and dropping it
leaves the encoding of a shorter prefix. So one left-to-right pass stores, per
position, that last token and the number of tokens: of the vocabulary entries
that end at a position (an Aho-Corasick automaton names them, longest first)
the one that merging would leave next to the last token of the position where
it starts. ``count(position) = count(start of its last token) + 1``.

``prefix_counts`` writes the counts of every prefix (in code points) of every
text as one compressed column of differences; ``truncate`` and ``count_at``
answer budget and truncation questions from that column alone, without the
text or the tokenizer. The count of a prefix is the count that the library
gives for that prefix as a text of its own. It may fall from one prefix to the
next, so a budget is answered by the longest prefix within it.

Three rules of the split are part of the pass: a run of white space is one
piece while it ends the prefix, but leaves its last character to the next
piece in a longer one; a contraction is cut differently before its last
letter; a special string counts as one token once it is whole.

Edge cases: a null or empty text has 0 bytes and 0 tokens; bytes that are no
UTF-8 count as U+FFFD for tokens and as they are for ``n_bytes``; repeated rows
and ids are rows of their own; a very long text is one pass with memory of
about 16 bytes per character; other columns of ``docs`` are kept, and a column
named like an added one (in any case) is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from array import array
from itertools import chain
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocab import CONTRACTIONS, OTHER, ByteBpe, Cache, default_path, words

ADDED = ("n_bytes", "n_tokens", "prefix_counts")
PAIRS = 300_000                               # remembered neighbour checks per worker


class PrefixCounter:
    """Token counts of all prefixes by one byte-level vocabulary."""

    def __init__(self, path: str):
        import ahocorasick
        self.vocab = v = ByteBpe(path)
        self._rank = {(a, b): r for r, (a, b, _) in enumerate(v.merges)}
        self._formed = {i: -1 for i in v.ids.values()}  # rank of the merge that forms a token
        self._halves = {}
        for r, (a, b, t) in enumerate(v.merges):
            if self._formed[t] < 0:
                self._formed[t], self._halves[t] = r, (a, b)
        self._ends = ahocorasick.Automaton()
        for token, i in v.ids.items():
            self._ends.add_word(token.decode("latin-1"), (len(token), i))
        self._ends.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self._piece = Cache(self._measure)
        self._word = Cache(self._unit)

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether merging keeps ``left`` and ``right`` apart. Both tokens'
        merges are undone in reverse order, one at a time; at no stage may the
        two parts at the border have a merge that comes before the one that
        takes the left part (equal merges go from left to right) or the right
        part away from the border."""
        taken_left = taken_right = len(self._rank)
        while True:
            rank = self._rank.get((left, right))
            if rank is not None and rank < taken_left and rank <= taken_right:
                return False
            formed_left, formed_right = self._formed[left], self._formed[right]
            if formed_left < 0 and formed_right < 0:
                return True
            if formed_left > formed_right:
                taken_left, left = formed_left, self._halves[left][1]
            else:
                taken_right, right = formed_right, self._halves[right][0]

    def piece(self, data: bytes) -> list[int]:
        """Token counts of ``data[:1], data[:2], ...`` as one piece."""
        n = len(data)
        last, count = [0] * (n + 1), [0] * (n + 1)
        fits, check = self._fits, self._neighbours
        for at, (length, token) in self._ends.iter(data.decode("latin-1")):
            end = at + 1
            if count[end]:
                continue
            start = end - length
            if start:                               # one token is always its own encoding
                pair = (last[start], token)
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) >= PAIRS:
                        fits.clear()
                    ok = fits[pair] = check(*pair)
                if not ok:
                    continue
            last[end], count[end] = token, count[start] + 1
        return count[1:]

    def _measure(self, piece: str):
        """Differences of the counts per code point of one piece (int16)."""
        if piece in CONTRACTIONS:
            counts = [self._tokens(self.vocab.split(piece[:j])) for j in range(1, len(piece))]
            counts.append(self.piece(piece.encode())[-1])
        else:
            data = piece.encode()
            counts = self.piece(data)
            if len(data) != len(piece):
                counts = [counts[i] for i in _last_bytes(data)]
        return array("h", map(sub, counts, chain((0,), counts))).tobytes()

    def _unit(self, word: str) -> bytes:
        """Differences of the counts of a word with the space before it."""
        pieces = self.vocab.split(" " + word)
        if len(pieces) == 1:
            return self._measure(pieces[0])
        if any(p.isspace() for p in pieces):
            return self._pieces(" " + word).astype("<i2").tobytes()
        return b"".join(map(self._piece.__getitem__, pieces))

    def _tokens(self, pieces: list[str]) -> int:
        return int(sum(np.frombuffer(self._piece[p], np.int16).sum() for p in pieces))

    def _blank(self, piece: str) -> bool:
        """Whether a piece is white space only, by the library's classes."""
        return piece.isspace() and all(
            c == " " or "\t" <= c <= "\r" or (c >= "\x80" and len(self.vocab.split(OTHER + c)) == 2) for c in piece)

    def _ordinary(self, text: str) -> np.ndarray:
        """Differences of the prefix counts of a text without special tokens.
        Words are pieces' runs that no piece crosses, so they are remembered."""
        first, space, rest = text.partition(" ")
        ws = words(rest) if space and not first[-1:].isspace() else None
        if ws is None:
            return self._pieces(text)
        own = self._pieces(first)
        return np.concatenate([own, np.frombuffer(b"".join(map(self._word.__getitem__, ws)), "<i2")])

    def _pieces(self, text: str) -> np.ndarray:
        pieces = self.vocab.split(text)
        steps = np.frombuffer(b"".join(map(self._piece.__getitem__, pieces)), np.int16).astype(np.int32)
        runs = [k for k, p in enumerate(pieces) if p.isspace()]
        if not runs or runs == [len(pieces) - 1]:
            return steps
        ends = np.cumsum(list(map(len, pieces)))
        for k in runs:
            if k + 1 < len(pieces) and pieces[k + 1][0].isspace() and self._blank(pieces[k] + pieces[k + 1][0]):
                # the prefix that ends behind the next piece's first character
                off = (self._tokens([pieces[k] + pieces[k + 1][0]])
                       - self._tokens([pieces[k], pieces[k + 1][0]]))
                at = int(ends[k])
                steps[at] += off
                if at + 1 < len(steps):
                    steps[at + 1] -= off
        return steps

    def steps(self, text: str) -> np.ndarray:
        """Differences of the token counts of all prefixes of ``text``."""
        special = self.vocab.special
        if not any(s in text for s in special):
            return self._ordinary(text)
        import re
        out, at = [], 0
        for m in re.finditer("|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)), text):
            # until the special string is whole, its characters are ordinary
            own = self._ordinary(text[at:m.end() - 1])
            before = int(own[:m.start() - at].sum())
            out += [own, np.array([before + 1 - int(own.sum())], np.int32)]
            at = m.end()
        return np.concatenate([*out, self._ordinary(text[at:])])


def _last_bytes(data: bytes) -> list[int]:
    """Positions of the last byte of every code point."""
    return [i - 1 for i in range(1, len(data)) if data[i] & 0xC0 != 0x80] + [len(data) - 1]


@functools.lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def _count(batches, path: str, schema: pa.Schema):
    import zstandard
    own = counter(path)
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        for row in range(0, batch.num_rows, 256):
            part = batch.slice(row, 256)
            sizes, tokens, blobs = [], [], []
            for raw in part.column(part.num_columns - 1).to_pylist():
                raw = raw or b""
                steps = own.steps(raw.decode("utf-8", "replace"))
                sizes.append(len(raw))
                tokens.append(int(steps.sum()))
                wide = steps.astype("<i4") if len(steps) and np.abs(steps).max() > 127 else steps.astype("i1")
                blobs.append(bytes([wide.itemsize]) + pack(wide.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array(blobs, pa.binary())], names=schema)


def counts_of(blob: bytes) -> np.ndarray:
    """Token counts of all prefixes (1, 2, ... code points) from the stored column."""
    import zstandard
    kind = {1: "i1", 4: "<i4"}[blob[0]]
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), kind), dtype=np.int64)


def prefix_counts(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` without its text column, plus n_bytes, n_tokens and
    prefix_counts (the stored counts of all prefixes).

    One pass over the texts, no shuffle."""
    path = path or default_path("byte_bpe_50k.json")
    gone = {c.lower() for c in (*ADDED, text)}
    others = [c for c in docs.columns if c.lower() not in gone]
    source = docs.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").cast("binary").alias("_text"))
    schema = T.StructType([f for f in source.schema.fields[:-1]]
                          + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
                             T.StructField("prefix_counts", T.BinaryType())])
    return source.mapInArrow(functools.partial(_count, path=path, schema=[f.name for f in schema.fields]), schema)


def _fit(batches, budget: int):
    for batch in batches:
        fit, used = [], []
        for blob in batch.column(batch.num_columns - 1).to_pylist():
            counts = counts_of(blob)
            within = np.flatnonzero(counts <= budget)
            fit.append(int(within[-1]) + 1 if len(within) else 0)
            used.append(int(counts[within[-1]]) if len(within) else 0)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fit, pa.int64()), pa.array(used, pa.int64())],
                                         names=[*batch.schema.names[:-1], "fit_chars", "fit_tokens"])


def truncate(counted: DataFrame, budget: int) -> DataFrame:
    """Adds fit_chars (code points of the longest prefix with at most
    ``budget`` tokens) and fit_tokens (its tokens) and drops the counts."""
    others = [c for c in counted.columns if c.lower() not in ("prefix_counts", "fit_chars", "fit_tokens")]
    source = counted.select(*[F.col(f"`{c}`") for c in others], "prefix_counts")
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("fit_chars", T.LongType()),
                           T.StructField("fit_tokens", T.LongType())])
    return source.mapInArrow(functools.partial(_fit, budget=budget), schema)


def count_at(counted: DataFrame, chars: str) -> DataFrame:
    """Adds tokens_at: tokens of the prefix of as many code points as column
    ``chars`` says (the whole text if it is shorter; null stays null)."""
    @F.pandas_udf("long")
    def look_up(blobs, n):
        import pandas as pd
        out = []
        for blob, k in zip(blobs, n):
            if pd.isna(k):
                out.append(None)
                continue
            counts = counts_of(blob)
            k = min(int(k), len(counts))
            out.append(int(counts[k - 1]) if k > 0 else 0)
        return pd.Series(out, dtype="Int64")

    return counted.withColumn("tokens_at", look_up("prefix_counts", F.col(f"`{chars}`")))

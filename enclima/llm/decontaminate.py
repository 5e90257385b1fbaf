"""Benchmark decontamination with a BM25 index and block-max pruning.

The benchmark's items are the indexed documents, training passages the
queries. Passages are windows of 2h words, h apart, with h at least the length
of the longest item of the index, so that an item copied anywhere into a text
lies within one passage.

* Entries: the whole item, and its question (all but its last sentence) if that
  has five words or more, each with its own weights.
* Score: BM25 of an entry for the distinct words of a passage, divided by the
  entry's score for its own words. 1 means that all of its words occur.
* Retrieve: entries are in blocks of eight of similar length. For the rarer
  words the index holds each block's largest impact as postings, for the common
  ones as a table of words and blocks. A passage's block sums bound its scores
  (every passage with a word of the index has some), and only blocks whose bound
  reaches the threshold are scored entry by entry. All entries at or above the
  threshold are retrieved. An entry whose heaviest words can be missing while
  0.8 of its shingles occur has a lower threshold: the least score that such a
  passage can have.
* Verify: the 5-word shingles of the item, its question and its answer (its last
  sentence) are looked up in every passage that retrieves one of its entries. A
  text is contaminated if in a passage 0.8 or more of the item's shingles occur,
  or of those of its question (of five words or more). Score and shares are the
  largest over the passages.

Index statistics come from all items; equal items are held once, with all their
ids. The index is cut into parts of a bounded number of postings (items of
similar length together); a part is small enough to be sent to all tasks, and
texts pass through the parts in groups of ``PARTS_AT_ONCE``, row by row, without
a shuffle.

Edge cases: null and empty texts and items match nothing; an item of fewer
than 5 words is one shingle; repeated items are all reported; with an empty
benchmark nothing is contaminated; all rows and columns of the texts stay.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W
from .common import SHINGLE_WORDS, SIMILARITY, save
from .ngram_join import LOWER

K1, B = 1.2, 0.75
THRESHOLD = 0.5
BLOCK = 8
PART_POSTINGS = 200_000
PARTS_AT_ONCE = 16
COMMON_SHARE = 1 / 16
HIT = "array<struct<item_id:long,score:double,question:double,answer:double,overlap:double>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()),
                           ("answer", pa.float64()), ("overlap", pa.float64())]))


def lower_words(data: np.ndarray, starts, ends):
    """(word hashes, first and past-the-last word per text), A-Z lower-cased."""
    data = LOWER[data]
    ws, we, lo, hi = W.split_words(data, starts, ends)
    return W.word_hashes(data, ws, we), lo, hi


def word_shingles(units: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    if len(units) >= k:
        return np.unique(W.rolling(units, k))
    return W.rolling(units, len(units)) if len(units) else units


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the answer is the last sentence."""
    body = text.rstrip()
    cut = max(body.rfind(mark, 0, max(len(body) - 1, 0)) for mark in (". ", "? ", "! ", ".\n", "?\n", "!\n", "\n"))
    return (body[:cut + 1], body[cut + 1:]) if cut >= 0 else (body, "")


def word_terms(units: np.ndarray, k: int = SHINGLE_WORDS) -> list[dict]:
    """Distinct words with their count and the number of distinct shingles that hold them."""
    t, tf = np.unique(units.view(np.int64), return_counts=True)
    n = np.ones(len(t), np.int64)
    if len(units) >= k:
        first = np.unique(W.rolling(units, k), return_index=True)[1]
        held = np.searchsorted(t, units.view(np.int64)[first[:, None] + np.arange(k)])
        pair = np.unique(np.arange(len(first))[:, None] * len(t) + held)
        n = np.bincount(pair % len(t), minlength=len(t))
    return [{"t": x, "tf": y, "n": z} for x, y, z in zip(t.tolist(), tf.tolist(), n.tolist())]


def least_score(weight: np.ndarray, held: np.ndarray, shingles: int) -> float:
    """Least score of a passage with SIMILARITY of an entry's shingles: a word is
    missing only if all ``held`` shingles that hold it are, and a missing
    shingle takes part in the loss of at most SHINGLE_WORDS words."""
    gone = shingles - int(np.ceil(SIMILARITY * shingles - 1e-9))
    can = np.flatnonzero(held <= gone)
    can = can[np.argsort(-weight[can] / held[can], kind="stable")]
    left = SHINGLE_WORDS * gone - (np.cumsum(held[can]) - held[can])
    return 1 - float((weight[can] * np.clip(left / held[can], 0, 1)).sum())


_TERMS = "array<struct<t:long,tf:long,n:long>>"
ITEMS = (f"item long, item_id long, same binary, n_words long, q_words long, terms {_TERMS}, q_terms {_TERMS}, "
         "question array<long>, answer array<long>, whole array<long>")


def _items(batches):
    for batch in batches:
        out = [[] for _ in range(10)]
        for row, item_id, text in zip(*(batch.column(c).to_pylist() for c in ("item", "item_id", "text"))):
            def hashes(s):
                raw = np.frombuffer(s.encode(), np.uint8)
                return lower_words(raw, np.array([0]), np.array([len(raw)]))[0]
            units = hashes(text)
            q, a = (hashes(part) for part in split_item(text))
            asked = SHINGLE_WORDS <= len(q) < len(units)
            for col, v in zip(out, (row, item_id, units.tobytes() + len(q).to_bytes(8),
                                    len(units), len(q), word_terms(units), word_terms(q) if asked else [],
                                    word_shingles(q).view(np.int64), word_shingles(a).view(np.int64),
                                    word_shingles(units).view(np.int64))):
                col.append(v)
        longs = pa.list_(pa.int64())
        terms = pa.list_(pa.struct([("t", pa.int64()), ("tf", pa.int64()), ("n", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in out[:2]] + [pa.array(out[2], pa.binary())]
            + [pa.array(c, pa.int64()) for c in out[3:5]] + [pa.array(c, terms) for c in out[5:7]]
            + [pa.array(c, longs) for c in out[7:]],
            ["item", "item_id", "same", "n_words", "q_words", "terms", "q_terms", "question", "answer", "whole"])


class Part:
    """One part of the index, in numpy arrays."""

    def __init__(self, items: list[dict], threshold: float):
        items.sort(key=lambda r: (r["n_words"], r["item"]))
        self.ids = [r["item_ids"] for r in items]
        self.half = max(16, max(r["n_words"] for r in items))
        as_hash = lambda v: np.array(v, np.int64).view(np.uint64)
        self.question, self.answer, self.whole = ([as_hash(r[c]) for r in items] for c in ("question", "answer", "whole"))
        self.asked = [r["q_words"] >= SHINGLE_WORDS for r in items]
        # entries: (words, item, postings, shingles)
        entries = [(r["n_words"], i, r["p"], len(r["whole"])) for i, r in enumerate(items)]
        entries += [(r["q_words"], i, r["q"], len(r["question"])) for i, r in enumerate(items) if r["q"]]
        entries.sort(key=lambda e: e[:2])
        self.owner = [i for _, i, _, _ in entries]
        self.terms = [np.array([x["t"] for x in p], np.int64) for _, _, p, _ in entries]
        self.impact = [np.array([x["w"] for x in p], np.float64) for _, _, p, _ in entries]
        self.need = np.array([min(threshold, least_score(w, np.array([x["n"] for x in p], np.int64), size))
                              for w, (_, _, p, size) in zip(self.impact, entries)]) - 1e-9
        self.whole_entry = {i: e for e, (_, i, p, _) in enumerate(entries) if p is items[i]["p"]}
        term, weight = np.concatenate(self.terms), np.concatenate(self.impact)
        item = np.repeat(np.arange(len(entries)), [len(t) for t in self.terms])
        self.vocab, t, df = np.unique(term, return_inverse=True, return_counts=True)
        self.word, self.weight = t, weight
        self.start = np.cumsum([0] + [len(t) for t in self.terms])
        block, self.n_blocks = item // BLOCK, (len(entries) + BLOCK - 1) // BLOCK
        common = df[t] > max(4, COMMON_SHARE * len(entries))
        self.block_need = np.minimum.reduceat(self.need, np.arange(0, len(entries), BLOCK))
        # block maxima of the common words, at most two cells per posting
        words = np.unique(t[common])
        self.column = np.full(len(self.vocab), -1)
        self.column[words] = np.arange(len(words))
        self.rest = np.zeros((len(words), self.n_blocks))
        np.maximum.at(self.rest, (self.column[t[common]], block[common]), weight[common])
        # block-max postings of the rarer words, by term
        key = t[~common].astype(np.int64) * self.n_blocks + block[~common]
        cells, where = np.unique(key, return_inverse=True)
        top = np.zeros(len(cells))
        np.maximum.at(top, where, weight[~common])
        self.block, self.top = cells % self.n_blocks, top
        self.begin = np.searchsorted(cells // self.n_blocks, np.arange(len(self.vocab) + 1))

    def candidates(self, units, lo, hi):
        """(text, first word, past-the-last word, block) of passages whose bound
        reaches the threshold."""
        at = np.searchsorted(self.vocab, units.view(np.int64))
        at = np.minimum(at, len(self.vocab) - 1)
        known = np.flatnonzero(self.vocab[at] == units.view(np.int64))
        if not len(known):
            return []
        text = np.searchsorted(hi, known, side="right")          # texts without words are skipped by hi
        chunks = np.maximum(-(-(hi - lo) // self.half), 1)
        base = np.cumsum(chunks + 1) - (chunks + 1) + 1           # one empty chunk before each text
        chunk = base[text] + (known - lo[text]) // self.half
        size = len(self.vocab)
        pair = np.unique(np.concatenate([chunk * size + at[known], (chunk - 1) * size + at[known]]))
        passage, term = pair // size, pair % size
        names, dense = np.unique(passage, return_inverse=True)
        out, step = [], max(1, 4_000_000 // max(self.n_blocks, len(self.rest)))
        edges = np.searchsorted(dense, np.arange(0, len(names) + step, step))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            rows, row, word = min(step, len(names) - i * step), dense[a:b] - i * step, term[a:b]
            usual = self.column[word] >= 0
            has = np.zeros((rows, len(self.rest)))
            has[row[usual], self.column[word[usual]]] = 1
            row, word = row[~usual], word[~usual]
            count = self.begin[word + 1] - self.begin[word]
            post = np.repeat(self.begin[word] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            bound = has @ self.rest + np.bincount(
                np.repeat(row, count) * self.n_blocks + self.block[post], weights=self.top[post],
                minlength=rows * self.n_blocks).reshape(rows, self.n_blocks)
            for p, blk in np.argwhere(bound >= self.block_need).tolist():
                out.append((int(names[i * step + p]), blk))
        owner = np.searchsorted(base - 1, [p for p, _ in out], side="right") - 1
        found = []
        for (p, blk), d in zip(out, owner.tolist()):
            first = lo[d] + (p - base[d]) * self.half
            found.append((d, max(int(first), int(lo[d])), min(int(first) + 2 * self.half, int(hi[d])), blk))
        return found

    def hits(self, units, lo, hi):
        """Verified hits per text: {text: {item position: values}}."""
        out: dict[int, dict[int, tuple]] = {}
        last, grams, done = None, {}, set()
        at = np.minimum(np.searchsorted(self.vocab, units.view(np.int64)), len(self.vocab) - 1)
        at[self.vocab[at] != units.view(np.int64)] = len(self.vocab)
        seen, inside = np.zeros(len(self.vocab) + 1, bool), at[:0]
        for d, a, z, blk in self.candidates(units, lo, hi):
            if (d, a) != last:
                seen[inside] = False
                last, inside, grams, done = (d, a), at[a:z], {}, set()
                seen[inside] = True
                seen[-1] = False
            e0, e1 = blk * BLOCK, min(len(self.owner), blk * BLOCK + BLOCK)
            for e in (e0 + np.flatnonzero(self._scores(e0, e1, seen) >= self.need[e0:e1])).tolist():
                i = self.owner[e]
                if i in done:
                    continue
                done.add(i)
                own = self.whole_entry[i]
                new = (float(self._scores(own, own + 1, seen)[0]),
                       *(self._share(s[i], units[a:z], grams) for s in (self.question, self.answer, self.whole)))
                old = out.setdefault(d, {}).get(i, new)
                out[d][i] = tuple(map(max, old, new))
        return out

    def _scores(self, first: int, end: int, seen: np.ndarray) -> np.ndarray:
        """Scores of the entries first..end - 1; ``seen`` marks the passage's words."""
        a, z = self.start[first], self.start[end]
        return np.add.reduceat(self.weight[a:z] * seen[self.word[a:z]], self.start[first:end] - a)

    @staticmethod
    def _share(want: np.ndarray, units: np.ndarray, grams: dict) -> float:
        if not len(want):
            return 0.0
        k = SHINGLE_WORDS
        if k not in grams:
            # short questions, answers and items are one shingle of their whole length
            grams[k] = np.unique(np.concatenate([W.rolling(units, n) for n in range(1, k + 1)]))
        return float(np.isin(want, grams[k]).mean())


def _scan(batches, parts, column: str, names: list[str]):
    for batch in batches:
        for part in W.slices(batch, "text"):
            units, lo, hi = lower_words(*W.arrow_text(part.column("text")))
            found = part.column(column).to_pylist()
            for p in parts.value:
                for d, items in p.hits(units, lo, hi).items():
                    for i, (score, q, a, full) in sorted(items.items()):
                        if full >= SIMILARITY or (p.asked[i] and q >= SIMILARITY):
                            found[d] = [*found[d], *({"item_id": x, "score": round(score, 6), "question": round(q, 6),
                                                      "answer": round(a, 6), "overlap": round(full, 6)} for x in p.ids[i])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, _HIT) if c == column else part.column(c) for c in names], names)


def index_table(benchmark: DataFrame) -> DataFrame | None:
    """The index as a table (part, item, item_ids, n_words, q_words, p, q,
    question, answer, whole), one row per distinct item; p and q are the postings (word,
    weight, shingles) of the item and of its question. None without items."""
    items, _ = save(
        benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .mapInArrow(_items, ITEMS))
    items = items.where("n_words > 0")
    n, avg = items.agg(F.count("*"), F.avg("n_words")).first()
    if not n:
        return None
    df = items.select(F.explode("terms.t").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n_words") / F.lit(avg)))
    # equal items are one entry with all ids
    ids = items.groupBy("same").agg(F.min("item").alias("item"), F.array_sort(F.collect_list(F.struct("item_id"))).alias("ids"))
    ids = ids.select("item", F.col("ids.item_id").alias("item_ids"))
    items, _ = save(items.drop("same", "item_id").join(ids, "item"))
    table = items.drop("terms", "q_terms")
    for name, terms, length in (("p", "terms", "n_words"), ("q", "q_terms", "q_words")):
        post = items.select("item", F.col(length).alias("n_words"), F.explode(terms).alias("x")).select("item", "n_words", "x.*")
        lists = (post.join(df, "t").withColumn("w", impact).groupBy("item")
                 .agg(F.sort_array(F.collect_list(F.struct("t", "w", "n"))).alias(name), F.sum("w").alias("own")))
        share = F.transform(name, lambda x: F.struct(x["t"].alias("t"), (x["w"] / F.col("own")).alias("w"), x["n"].alias("n")))
        table = table.join(lists, "item", "left").withColumn(name, share).drop("own")
    # parts: items of one length band, dealt by hash to enough buckets
    band = F.floor(F.log2(F.col("n_words").cast("double")))
    size = table.withColumn("band", band).groupBy("band").agg(F.sum(F.size("p") + F.coalesce(F.size("q"), F.lit(0))).alias("postings"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("postings") / F.lit(PART_POSTINGS))).cast("int")
    out, _ = save(table.withColumn("band", band).join(size.withColumn("buckets", buckets), "band")
                  .withColumn("part", F.struct("band", F.pmod(F.xxhash64("item"), F.col("buckets")).alias("bucket")))
                  .drop("postings", "buckets", "band"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, hits: str = "hits", threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs`` (with a ``text`` column) and the column
    ``hits``: the items each text leaks (empty: clean)."""
    if hits in docs.columns:
        raise ValueError(f"column {hits} exists; name another")
    spark = docs.sparkSession
    out = docs.withColumn(hits, F.array().cast(HIT))
    table = index_table(benchmark)
    if table is None:
        return out
    names = [r["part"] for r in table.select("part").distinct().orderBy("part").collect()]
    for a in range(0, len(names), PARTS_AT_ONCE):
        group = []
        for name in names[a:a + PARTS_AT_ONCE]:
            rows = table.where((F.col("part.band") == name["band"]) & (F.col("part.bucket") == name["bucket"])).drop("part")
            group.append(Part([r.asDict() for r in rows.collect()], threshold))      # a bounded part of the index
        shared = spark.sparkContext.broadcast(group)
        out = out.mapInArrow(functools.partial(_scan, parts=shared, column=hits, names=out.columns), out.schema)
    return out

"""Language ID with language-bitmask n-gram filters.

Training counts character n-grams per language on a bounded sample of labelled
texts. The n-grams that make up the bulk of a language's text form its set.
All sets live in one bit-sliced Bloom filter: a slot holds one bit per
language, and the AND over an n-gram's slots returns the mask of all languages
whose set contains it. A text's n-grams are looked up once; the bits are
counted per language, corrected for each language's false-positive rate, and
the largest corrected share decides (ties: first language in alphabetical
order).

Sample bound: about ``sample_docs`` texts, spread evenly over the languages
and chosen by a hash of doc_id.

Edge cases: null texts and texts without a letter get ``und`` and score 0;
rows without a language are never trained on; without any training rows every
text is ``und``; repeated rows get equal results.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows as W

UND = "und"
SAMPLE_DOCS = 20000
ORDERS = (3, 4)
HASHES = 3
COVER = 0.9
_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def text_grams(texts: list[str | None], orders=ORDERS):
    """n-gram hashes of all texts and, per text, the number of grams and
    letters: words are runs of letters, lower-cased, with one edge mark on
    either side; a gram never crosses a word."""
    joined = "\0".join((t or "").replace("\0", " ").lower() for t in texts)
    codes = np.frombuffer((joined + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    doc = np.cumsum(codes == 0)
    doc[codes == 0] -= 1
    keep = letter.copy()
    keep[1:] |= letter[:-1]                     # one edge mark behind every word
    c = np.where(letter, codes, 0).astype(np.uint64)[keep]
    d = doc[keep]
    n_letters = np.bincount(doc[letter], minlength=len(texts))
    c = np.concatenate([np.zeros(1, np.uint64), c])   # edge mark before the first word
    d = np.concatenate([np.zeros(1, d.dtype), d])
    hashes, owners = [], []
    for n in orders:
        m = len(c) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        ok = np.ones(m, bool)
        for i in range(n):
            part = c[i:i + m]
            h = h * np.uint64(0x100000001B3) + part
            h ^= h >> np.uint64(27)
            if 0 < i < n - 1:
                ok &= part != 0
        hashes.append(W.mix(h[ok]))
        owners.append(d[1:m + 1][ok])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_letters
    return np.concatenate(hashes), np.concatenate(owners), n_letters


@dataclass
class GramFilter:
    """Bit-sliced Bloom filter: ``slots`` (slots x words of 64 languages)."""
    langs: list[str]
    slots: np.ndarray
    fill: np.ndarray                            # false-positive rate per language

    @classmethod
    def build(cls, sets: dict[str, np.ndarray]) -> "GramFilter":
        langs = sorted(sets)
        most = max((len(s) for s in sets.values()), default=1)
        size = 1 << int(np.ceil(np.log2(max(1024, 12 * most))))
        slots = np.zeros((size, max(1, (len(langs) + 63) // 64)), np.uint64)
        fill = np.zeros(len(langs))
        for i, name in enumerate(langs):
            at = np.unique(np.concatenate(cls.places(sets[name], size))) if len(sets[name]) else np.zeros(0, np.int64)
            slots[at, i // 64] |= np.uint64(1 << (i % 64))
            fill[i] = (len(at) / size) ** HASHES
        return cls(langs, slots, fill)

    @staticmethod
    def places(h: np.ndarray, size: int) -> list[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(j) * step) & np.uint64(size - 1)).astype(np.int64) for j in range(HASHES)]

    def masks(self, h: np.ndarray, word: int) -> np.ndarray:
        col = self.slots[:, word]
        at = self.places(h, len(col))
        out = col[at[0]]
        for a in at[1:]:
            out = out & col[a]
        return out

    def shares(self, h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """(n, languages): share of each text's grams in each language's set,
        corrected for false positives."""
        total = np.maximum(np.bincount(owner, minlength=n), 1)
        out = np.zeros((n, len(self.langs)))
        for word in range(self.slots.shape[1]):
            masks = self.masks(h, word)
            for i in range(word * 64, min(len(self.langs), word * 64 + 64)):
                bit = ((masks >> np.uint64(i % 64)) & np.uint64(1)).astype(bool)
                hit = np.bincount(owner[bit], minlength=n) / total
                out[:, i] = np.clip((hit - self.fill[i]) / (1 - self.fill[i]), 0.0, 1.0)
        return out


def _gram_counts(batches):
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        for name in sorted(set(langs)):
            texts = batch.filter(pa.array(langs == name)).column("text").to_pylist()
            for a in range(0, len(texts), 500):
                h, c = np.unique(text_grams(texts[a:a + 500])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(h), pa.string()), pa.array(h.view(np.int64)),
                                                  pa.array(c)], ["lang", "gram", "c"])


def train(rows: DataFrame, sample_docs: int = SAMPLE_DOCS, cover: float = COVER, max_grams: int = 200_000) -> GramFilter:
    """Fit on labelled rows (doc_id, text, lang): a language's set is its most
    frequent n-grams that together make up ``cover`` of its n-gram occurrences
    (``max_grams`` at most: a bound of the filter, which is broadcast)."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return GramFilter.build({})
    share = sample_docs / len(sizes)
    take = F.lit(False)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    for name, n in sorted(sizes.items()):
        take = take | ((F.col("lang") == name) & (draw < min(1.0, share / n)))
    counts = (rows.where(take).select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, c long")
              .groupBy("lang", "gram").agg(F.sum("c").alias("c")))
    from pyspark.sql import Window
    top = (counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "gram")))
           .withColumn("before", F.sum("c").over(Window.partitionBy("lang").orderBy("r")) - F.col("c"))
           .withColumn("total", F.sum("c").over(Window.partitionBy("lang")))
           .where((F.col("before") < cover * F.col("total")) & (F.col("r") <= max_grams))
           .select("lang", "gram").toArrow())
    names, grams = np.array(top.column("lang").to_pylist(), object), np.asarray(top.column("gram")).view(np.uint64)
    return GramFilter.build({name: grams[names == name] for name in sizes})


def _predict(batches, model, text, columns, names):
    f: GramFilter = model.value
    for batch in batches:
        for part in W.slices(batch, text, 1 << 20):
            texts = part.column(text).to_pylist()
            h, owner, letters = text_grams(texts)
            if f.langs:
                share = f.shares(h, owner, len(texts))
                best = share.argmax(axis=1)
                score = share[np.arange(len(texts)), best]
                pred = [f.langs[b] if n else UND for b, n in zip(best.tolist(), letters.tolist())]
            else:
                pred, score = [UND] * len(texts), np.zeros(len(texts))
            score = np.where(letters > 0, score, 0.0)
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in columns] + [pa.array(pred, pa.string()), pa.array(score)], names)


def predict(docs: DataFrame, model: GramFilter, keep: list[str], pred: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """``keep`` columns of ``docs`` plus the predicted language and its score;
    ``text`` is read whole and is the only input of the prediction."""
    from pyspark.sql import types as T
    cols = list(dict.fromkeys([*keep, "text"]))
    rows = docs.select(*[F.col(f"`{c}`") for c in cols])
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(pred, T.StringType()),
                           T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(functools.partial(_predict, model=shared, text="text", columns=keep,
                                             names=schema.fieldNames()), schema)

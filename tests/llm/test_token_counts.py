"""Prefix token counts against the library, prefix by prefix."""
import random

import pytest
from pyspark.sql import functions as F

from enclima.llm.token_counts import count_at, counts_of, prefix_counts, truncate
from enclima.llm.vocab import default_path

BITS = ["a", "'s", "'re", "'ll", "'", "  ", "\n", " ", "\t", "\r\n", "　", " ", "don", "’", "é", "日本", "1", "23",
        "<|endoftext|>", "<|", "hello", "World", "--------", "=", "Ᲊ", "\U00031350", "ﬀ", "😀", "\x85", "the", "\x1c",
        "\x1f", "​", " word", " and,"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def texts():
    rng = random.Random(13)
    made = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 14))) for _ in range(250)]
    return made + ["", None, " ", "   ", "\n", "x" * 3000, "ab" * 500 + " \n \n z", "the " * 800]


def test_every_prefix_as_the_library_counts_it(spark, documents, library):
    rows = list(enumerate(texts()))
    got = {r.doc_id: r for r in prefix_counts(documents(rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        text = text or ""
        counts = counts_of(got[i].prefix_counts).tolist()
        step = 1 if len(text) < 100 else 97
        assert counts[::step] == [library(text[:k]) for k in range(1, len(text) + 1, step)], repr(text)
        assert got[i].n_tokens == library(text) and got[i].n_bytes == len(text.encode())


def test_truncation_and_counts_need_no_text(spark, documents, library):
    rows = [(i, t) for i, t in enumerate(texts()) if t and len(t) < 100]
    counted = prefix_counts(documents(rows))
    for budget in (0, 3):
        got = {r.doc_id: (r.fit_chars, r.fit_tokens) for r in truncate(counted, budget).collect()}
        for i, text in rows:
            best = max((k for k in range(len(text) + 1) if library(text[:k]) <= budget), default=0)
            assert got[i] == (best, library(text[:best]))
    asked = count_at(counted.withColumn("k", F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 7)), "k").collect()
    for r in asked:
        assert r.tokens_at == (None if r.doc_id % 7 == 0 else library(dict(rows)[r.doc_id][:r.doc_id % 7]))


def test_edge_rows(spark, documents):
    twice = documents([(1, "a b"), (1, "a b"), (None, None)]).withColumn("N_TOKENS", F.lit("x"))
    out = prefix_counts(twice)
    assert [c for c in out.columns if c.lower() == "n_tokens"] == ["n_tokens"]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out.collect()) == [(0, 0, 0), (1, 3, 2), (1, 3, 2)]
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'41FF42' AS string) AS text")
    r = prefix_counts(broken).first()
    assert r.n_bytes == 3 and r.n_tokens > 0
    assert prefix_counts(documents([])).count() == 0


def test_query_over_the_whole_table(spark, library):
    from enclima.llm.queries import QUERIES
    base = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op13_token_counts"](spark, base).collect()}
    docs = spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(got)
    for d in docs:
        n = library(d.text or "")
        assert (got[d.doc_id].n_tokens, got[d.doc_id].over_limit) == (n, n > 1024)
        assert got[d.doc_id].n_bytes == len((d.text or "").encode())
        if n <= 1024:
            assert got[d.doc_id].fit_chars == len(d.text or "")

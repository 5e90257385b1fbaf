"""Substring, suffix and n-gram dedup against brute force."""
import random

import pytest

import corpus_pipeline
from enclima.llm.ngram_join import ngram_join
from enclima.llm.substring_dedup import substring_dedup
from enclima.llm.suffix_dedup import suffix_dedup
from . import brute


def corpus():
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, line = text(70), text(24)
    docs = {1: None, 2: "", 3: " \t\n ", 4: "a", 5: "one two three four", 6: "One two three FOUR", 7: "x " * 400,
            8: text(30), 9: text(5)}
    docs[10] = docs[8]
    base = text(200).split()
    for i in range(11, 31):                                     # near copies
        w = list(base)
        for _ in range(rnd.randrange(1, 14)):
            w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
        docs[i] = "\n".join(w)
    for i in range(31, 50):                                     # a shared passage, a frequent line
        docs[i] = f"{text(rnd.randrange(0, 60))}  {passage}\t{text(rnd.randrange(0, 40))} {line}"
    docs[50] = f"{line} {line}\r\n{passage} {passage}"
    docs[51] = "é" * 300 + text(12) + "é" * 301
    docs[52] = text(3000) + " " + passage
    return docs


def frame(documents, docs):
    return documents(list(docs.items()))


def test_substring_dedup_matches_brute_force(spark, documents):
    docs = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, brute.sha(r.kept)) for r in substring_dedup(frame(documents, docs)).collect()}
    assert got == brute.op1(docs)


def test_suffix_dedup_matches_brute_force(spark, documents):
    docs = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept)))
           for r in suffix_dedup(frame(documents, docs)).collect()}
    assert got == brute.op3(docs)


def test_ngram_join_matches_brute_force(spark, documents):
    docs = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(frame(documents, docs)).collect()}
    assert got == brute.op2(docs)


@pytest.mark.parametrize("op", [substring_dedup, suffix_dedup, ngram_join])
def test_empty_repeated_and_extra_columns(spark, documents, op):
    from pyspark.sql import functions as F
    assert op(documents([])).count() == 0
    long = " ".join(f"t{i}" for i in range(90))
    rows = documents([(1, long), (1, long), (2, long), (None, long), (None, None), (3, "b c")])
    rows = rows.withColumns({c: F.lit("x") for c in ("key", "pos", "core", "n", "spans", "sid", "root", "body")})
    out = op(rows).collect()
    assert len(out) == 6
    if op is substring_dedup:
        by = {}
        for r in out:
            by.setdefault(r.doc_id, []).append(r.n_removed)
        assert by[2] == [90] and by[3] == [0] and by[1] == [90, 90] and sorted(by[None]) == [0, 0]   # null id is first
    elif op is suffix_dedup:
        assert sorted(r.n_removed for r in out) == [0, 0] + [len(long)] * 4
    else:
        assert {r.doc_id: r.component_id for r in out} == {1: 1, 2: 1, 3: 3, None: None}


def test_texts_under_one_id(spark, documents):
    """Two texts of one document, each with a near copy of its own."""
    rnd = random.Random(8)
    a, b, c, d = (" ".join(f"{x}{rnd.randrange(10**6)}" for _ in range(80)) for x in "abcd")
    rows = [(5, a), (5, b), (5, ""), (3, b + " end"), (9, a + " end"), (7, c), (8, d), (8, c[::-1]), (None, a)]
    got = {(r.doc_id, r.n_shingles): r for r in ngram_join(documents(rows)).collect()}
    assert {k: r.component_id for k, r in got.items() if k[0] is not None} == {
        (5, 76): 3, (5, 0): 3, (3, 77): 3, (9, 77): 3, (7, 76): 7, (8, 76): 8}
    assert got[3, 77].root != got[9, 77].root
    kept = corpus_pipeline.near_duplicates(spark, documents(rows), "")
    assert sorted((r.doc_id, r.text) for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(
        [(5, a), (3, b + " end"), (5, ""), (7, c), (8, d), (8, c[::-1])])


def test_components_of_a_chain_and_a_star(spark):
    from enclima.llm.common import components
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(300, 360)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(100, 141)} == {100} and {got[i] for i in range(300, 360)} == {7} and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_cores_of_long_texts_in_pieces():
    import numpy as np

    from enclima.llm import windows as W
    rng = np.random.default_rng(8)
    for n, docs, length, core in ((1, 1, 5, 2), (400, 1, 20, 5), (700, 9, 20, 5), (900, 40, 12, 4), (0, 2, 5, 2)):
        units = rng.integers(0, 3, n).astype(np.uint64)                 # few values: many repeats and ties
        cut = np.sort(rng.integers(0, n + 1, docs - 1))
        starts, ends = np.append(0, cut).astype(np.int64), np.append(cut, n).astype(np.int64)
        whole = W.cores(units, starts, ends, length, core)
        for at_once in (2 * length, 2 * length + 3, 5 * length):
            for a, b in zip(whole, W.cores(units, starts, ends, length, core, at_once)):
                assert a.tolist() == b.tolist()

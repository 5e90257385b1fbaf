"""Alignment against a plain version over bytes."""
import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import pytest

from enclima.llm import token_alignment
from enclima.llm.token_alignment import align, groups, jump
from enclima.llm.vocab import byte_characters, default_path

BITS = ["a", "'s", "  ", "\n", " ", "\t", "don", "’", "é", "日本", "12", "<|endoftext|>", "<s>", "hello", "World",
        "--------", "ﬀ", "😀", "\x85", "the", "ing", "▁", " word", " and,", "​", "<0x0A>", "　", "\n "]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(default_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))
    return a, b


def plain(docs, libraries):
    a, b = libraries
    alphabet = byte_characters()
    cut, count = {}, Counter()
    for i, text in docs:
        cut[i] = []
        if not text:
            continue
        raw = (" " + text).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        by_a = [bytes(alphabet[c] for c in a.id_to_token(t)) for t in ids_a]
        ids_b = b.encode(text)
        by_b = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode()
                for t in ids_b]
        if b"".join(by_a) != raw or b"".join(by_b) != raw:
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in by_a]), np.cumsum([len(x) for x in by_b])
        both = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        found = [([], []) for _ in both]
        for side, ids, ends in ((0, ids_a, ends_a), (1, ids_b, ends_b)):
            for t, e in zip(ids, ends):
                found[bisect_left(both, e)][side].append(t)
        cut[i] = found
        count.update({(x, y) for ga, gb in found for x in ga for y in gb})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = {}
    for i, found in cut.items():
        links = [(x, y) for ga, gb in found for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in found)
        out[i] = (sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found), len(links),
                  sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links), text)
    return out


def collected(frame):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in frame.collect()}


def rows():
    rng = random.Random(11)
    made = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 20))) for _ in range(200)]
    return list(enumerate(made + ["", None, " ", "x", "the word and the word " * 400] + ["copy of a text, twice"] * 30))


def test_as_the_plain_version(spark, documents, libraries, monkeypatch):
    docs = rows()
    want = plain(docs, libraries)
    assert any(w[0] for w in want.values()) and sum(not w[0] for w in want.values()) > 5
    assert collected(align(documents(docs).repartition(3), block_bytes=300)) == want
    hashed = collected(align(documents(docs), hashed=True))
    for i, w in want.items():
        assert hashed[i][:6] == w[:6]
        assert hashed[i][6] == (hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "")


def test_links_in_pieces_are_the_same(libraries, monkeypatch):
    texts = [t.encode() for _, t in rows() if t]
    args = (default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model"), False)
    whole = token_alignment._slice(texts, *args)
    monkeypatch.setattr(token_alignment, "LINKS", 3)
    pieces = token_alignment._slice(texts, *args)
    assert whole[0] == pieces[0] and (whole[1] == pieces[1]).all()


def test_long_chains_are_one_group():
    # two bytes per token, one byte apart: ends meet only at the end
    n = 5000
    len_a, len_b = np.full(n, 2), np.array([1] + [2] * (n - 1) + [1])
    a, b = groups(np.cumsum(len_a), np.cumsum(len_b), len_a, len_b)
    assert set(a) == {0} and set(b) == {0}
    assert jump(np.append(np.arange(1, 1000), 999)).tolist() == [999] * 1000


def test_edge_rows(spark, documents):
    same = collected(align(documents([(None, "a b"), (None, None)])))
    assert set(same) == {None}
    broken = spark.sql("SELECT 1L AS doc_id, cast(X'41FF42' AS string) AS text, 'x' AS BLOCK, 'y' AS groups")
    assert collected(align(broken)) == {1: (0, 0, 0, 0, 0, 0, "")}
    assert align(documents([])).count() == 0
    twice = align(documents([(1, "the word"), (1, "the word"), (2, "another word")])).collect()
    assert sorted(r.doc_id for r in twice) == [1, 1, 2]
    ones = [r for r in twice if r.doc_id == 1]
    assert ones[0] == ones[1] and ones[0].count_sum > ones[0].n_links


def test_query_over_the_whole_table(spark, libraries):
    from enclima.llm.queries import QUERIES
    base = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_token_alignment"](spark, base).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").select("doc_id", "text").collect()]
    want = plain(docs, libraries)
    assert got == {i: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[0] else "") for i, w in want.items()}

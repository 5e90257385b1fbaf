"""Decontamination, embedding near-dedup, language ID and the pipeline."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from enclima.llm.decontaminate import Part, decontaminate, index_table, split_item, word_shingles
from enclima.llm.embedding_dedup import near_duplicates
from enclima.llm.language_id import predict, train
from . import brute

SF_SMALL = "/root/testdata/sf0.001"


def items(n=40, seed=5):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(400)]
    return {i: " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(3, 70))) + ". " + rnd.choice(vocab) + " end" for i in range(n)}


def test_decontamination_finds_planted_items_only(spark, documents):
    rnd = random.Random(6)
    bench = items()
    text = lambda n: " ".join(f"v{rnd.randrange(400)}" for _ in range(n))
    docs, want = {}, {}
    for d in range(60):
        body, want[d] = text(rnd.randrange(0, 900)), set()
        if d % 3 == 0:
            i = rnd.randrange(len(bench))
            copy = bench[i].upper() if d % 2 else bench[i].replace(" ", "\n")
            body, want[d] = f"{body} {copy} {text(rnd.randrange(200))}", {i}
        docs[d] = body
    table = spark.createDataFrame(list(bench.items()) + [(100, None), (101, "")], "item_id long, text string")
    rows = documents([*docs.items(), (900, None), (901, "")])
    got = {r.doc_id: {h.item_id for h in r.hits} for r in decontaminate(rows, table).collect()}
    assert got == {**want, 900: set(), 901: set()}
    assert decontaminate(rows, table.limit(0)).where("size(hits) > 0").count() == 0
    assert decontaminate(documents([]), table).count() == 0
    with pytest.raises(ValueError):
        decontaminate(rows.withColumn("hits", F.lit(1)), table)


def test_block_max_bound_loses_no_passage(spark):
    """Every passage whose exact score reaches the threshold is a candidate."""
    rnd = np.random.default_rng(1)
    table = index_table(spark.createDataFrame(list(items(60).items()), "item_id long, text string"))
    rows = [r.asDict() for r in table.drop("part").collect()]
    part = Part(rows, 0.3)
    words = np.concatenate(part.terms)
    units = rnd.choice(words, 4000).view(np.uint64)
    lo, hi = np.array([0, 1500, 1500]), np.array([1500, 1500, 4000])
    found = {(d, a, b) for d, a, _, b in part.candidates(units, lo, hi)}
    n = 0
    for d in (0, 2):
        for a in range(lo[d], hi[d], part.half):
            seen = set(units[a:min(a + 2 * part.half, hi[d])].view(np.int64).tolist())
            for i, t in enumerate(part.terms):
                if sum(w for x, w in zip(t.tolist(), part.impact[i]) if x in seen) >= 0.3:
                    n += 1
                    assert (d, a, i // 8) in found
    assert n > 20
    assert len(word_shingles(np.arange(3, dtype=np.uint64))) == 1 and split_item("A b. C d.") == ("A b.", " C d.")


def test_question_only_copies_are_found(spark, documents):
    """A copy of the question alone is a leak, however heavy the answer's words
    are, and a passage with more of the whole item does not hide it."""
    table = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    asked = {r.item_id: split_item(r.text)[0] for r in table.collect()}
    asked = {i: q for i, q in asked.items() if len(brute.words(q)) >= 5}
    filler = " ".join(f"zz{i}" for i in range(300))
    rows = documents([(i, f"{filler} {q} {filler}") for i, q in asked.items()])
    got = {r.doc_id: {h.item_id for h in r.hits if h.question == 1} for r in decontaminate(rows, table).collect()}
    assert len(got) > 150 and all(i in found for i, found in got.items())

    question, answer = "one two three four five.", " ".join(f"a{i}" for i in range(40))
    common = " ".join(["same words again and again"] * 3 + [f"w{i}" for i in range(60)])
    own = spark.createDataFrame([(1, f"{question} {answer}"), (2, f"{common} rare{0}")] +
                                [(i, common + f" other{i}. yes") for i in range(3, 30)], "item_id long, text string")
    rows = documents([(1, f"{question} {filler} {answer} {filler}"), (2, question), (3, answer.replace("a39", "b"))])
    found = {r.doc_id: {h.item_id: h for h in r.hits} for r in decontaminate(rows, own).collect()}
    assert found[1][1].question == found[2][1].question == 1 and found[1][1].overlap >= 0.8
    assert set(found[3]) == {1}


def test_heavy_words_missing_from_a_leaked_item(spark, documents):
    """0.8 of an item's shingles occur, but less than half of its weight."""
    usual = " ".join(f"u{i}" for i in range(60))
    bench = [(0, f"{usual} h1 h2 h3 h4 h5 h6 h7 h8 h9 h10 h11")] + [(i, f"{usual} x{i}") for i in range(1, 400)]
    rows = documents([(1, usual)])
    hits = decontaminate(rows, spark.createDataFrame(bench, "item_id long, text string")).first().hits
    item = [h for h in hits if h.item_id == 0]
    assert item and item[0].overlap >= 0.8 and item[0].score < 0.5


def test_repeated_items_stay_findable(spark, documents):
    """Benchmarks of repeated items only, and one item in a third of the rows."""
    own = [b for b in items(8, seed=9).values() if len(brute.words(b)) >= 8]
    other = [b for b in items(60, seed=10).values()]
    for bench in ([own[0]] * 5, [b for b in own for _ in range(6)], [own[0]] * 30 + other,
                  [f"{b}{' ' * j}".replace(" ", "  " if j % 2 else " ") for b in own for j in range(6)]):
        table = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
        docs = dict(enumerate(sorted(set(bench))))
        got = {r.doc_id: {h.item_id for h in r.hits} for r in decontaminate(documents(docs.items()), table).collect()}
        for d, text in docs.items():
            assert {i for i, b in enumerate(bench) if brute.words(b) == brute.words(text)} <= got[d]
    # all words common, no two items equal
    words = [f"c{i}" for i in range(30)]
    bench = [" ".join(random.Random(i).sample(words, 30)) for i in range(6)]
    table = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    got = {r.doc_id: {h.item_id for h in r.hits} for r in decontaminate(documents(enumerate(bench)), table).collect()}
    assert got == {i: {i} for i in range(6)}


def test_embedding_links_match_brute_force(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(700, 24))
    base[500:640] = base[3] + 0.12 * rnd.normal(size=(140, 24))        # a group of near copies
    base[640:700] = base[7]                                             # exact copies
    rows = [(i, v.tolist()) for i, v in enumerate(base.astype(np.float32))]
    bad = [(800, None), (801, []), (802, [0.0] * 24), (803, [float("nan")] * 24), (804, [None] * 24), (805, [float("inf")] + [1.0] * 23),
           (806, [1.0, 2.0]), (None, [5.0, 5.0, 1.0])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("cid", F.lit(0))
    got = {r.vec_id: r for r in near_duplicates(table, 0.9, shard_rows=200, min_shards=3).collect()}
    u = base.astype(np.float32).astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    root = brute.union_find(range(700), zip(*(x.tolist() for x in np.nonzero(link))))
    assert [got[i].n_links for i in range(700)] == link.sum(1).tolist()
    assert [got[i].component_id for i in range(700)] == [root[i] for i in range(700)]
    assert all(got[i].kept == (got[i].component_id == i) for i in range(700))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(800, 807))
    assert near_duplicates(table.limit(0)).count() == 0


def test_embedding_group_wider_than_the_beams(spark):
    """Members of a large group are compared with their whole shards; the rows
    that a shard returns grow with its vectors, not with the group's pairs."""
    from enclima.llm.embedding_dedup import WIDEST, _Shard
    rng = np.random.default_rng(5)
    near = rng.normal(size=16) + 0.05 * rng.normal(size=(3 * WIDEST, 16))
    x = np.concatenate([near, rng.normal(size=(60, 16))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(len(x))
    cid, other, linked = _Shard(ids, np.ones(len(x), np.int64), x, 0.9).links(ids, x)
    assert len(cid) <= 2 * len(x)
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in near_duplicates(table, 0.9, min_shards=2).collect()}
    want = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert want.max() > 2 * WIDEST and got == dict(enumerate(want.tolist()))


def sphere(rng, n, dim):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def at_cosine(rng, x, cosine):
    """A vector of this cosine for every row of ``x``."""
    z = rng.normal(size=x.shape)
    z -= np.einsum("nd,nd->n", x, z)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    return cosine * x + np.sqrt(1 - cosine ** 2) * z


def test_embeddings_meet_in_regions(spark, monkeypatch):
    """Whole vectors go where a near one is, not to every shard; pairs just
    above the threshold are found, once at either end."""
    rng = np.random.default_rng(8)
    x = sphere(rng, 6000, 32)
    x[4000:5000] = at_cosine(rng, x[:1000], 0.901)
    x[5000:5060] = at_cosine(rng, np.repeat(x[1000:1001], 60, 0), 0.99)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    dealt, plain = [], type(table).repartition

    def counted(self, *args):
        if "vec" in self.columns:
            dealt.append(self.count())
        return plain(self, *args)

    monkeypatch.setattr(type(table), "repartition", counted)
    got = {r.vec_id: r for r in near_duplicates(table, 0.9).collect()}
    assert 0 < sum(dealt) < 4 * len(x)              # every vector in each of twelve shards before
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    n = np.array([got[i].n_links for i in range(len(x))])
    assert (n <= link.sum(1)).all() and n.sum() >= 0.98 * link.sum()
    alone = [i for i in range(1000) if link[i].sum() == 1 and link[4000 + i].sum() == 1]
    assert len(alone) > 900 and all(n[i] == n[4000 + i] for i in alone)
    assert n[5000:5060].tolist() == link[5000:5060].sum(1).tolist() and len({got[i].component_id for i in range(5000, 5060)}) == 1


def test_embedding_shard_counts_pairs_once(monkeypatch):
    """By graph or as a whole; pairs that an earlier region names are left out."""
    from enclima.llm import embedding_dedup as E
    rng = np.random.default_rng(9)
    x = sphere(rng, 400, 16)
    x[300:] = at_cosine(rng, x[:100], 0.96)
    ids = rng.permutation(400) * 7
    marks = [np.array([5] if i < 50 or 300 <= i < 330 else [], np.int64) for i in range(400)]
    want = x @ x.T >= 0.9
    np.fill_diagonal(want, False)
    named = np.array([len(m) > 0 for m in marks])
    for rows in (E.GRAPH_ROWS, 100):
        monkeypatch.setattr(E, "GRAPH_ROWS", rows)
        for own, kept in ((None, want), (marks, want & ~(named[:, None] & named))):
            shard = E._Shard(ids, np.full(400, 2), x, 0.9, own)
            assert (shard.graph is None) == (rows > 400)
            cid, other, linked = shard.links(ids, x, own)
            got = dict.fromkeys(ids.tolist(), 0)
            for c, n in zip(cid, linked):
                got[int(c)] += int(n)
            assert got == dict(zip(ids.tolist(), (2 * kept.sum(1)).tolist()))
            root = brute.union_find(ids.tolist(), zip([int(c) for c in cid], [int(o) for o in other]))
            full = brute.union_find(ids.tolist(), [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(kept))])
            assert root == full


def test_region_plans():
    from enclima.llm import regions
    rng = np.random.default_rng(10)
    for dim, rows, cosine in ((64, 51_282, 0.9), (64, 10 ** 8, 0.9), (33, 10 ** 5, 0.8), (2, 10 ** 4, 0.9)):
        codes, depth, least = regions.plan(dim, rows, cosine, 0.99)
        assert codes > 1
        x = sphere(rng, 3000, dim)
        a, b = (regions.rotated(v, codes) for v in (x, at_cosine(rng, x, cosine)))
        met = (regions.regions(a, codes, depth)[:, :, None] == regions.regions(b, codes, depth)[:, None]).any(axis=(1, 2))
        near = np.einsum("nd,nd->n", *(regions.opened(regions.sketches(y), dim) for y in (a, b))) >= least
        assert (met & near).mean() > 0.975
    assert regions.plan(64, 1000, 0.9, 0.99)[0] == regions.plan(1, 10 ** 6, 0.9, 0.99)[0] == regions.plan(8, 10 ** 6, -0.5, 0.99)[0] == 1


LANGS = {"aa": ["kolo", "mirta", "sven"], "bb": ["tugh", "rax", "pelto"], "cc": ["ünxe", "wöry", "çazi"]}


def test_language_id_separates_and_handles_edge_cases(spark, documents):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(LANGS[g]) for _ in range(rnd.randrange(1, 30))), g if i % 10 else None)
            for i in range(300) for g in [list(LANGS)[i % 3]]]
    rows += [(900, None, "aa"), (901, "12 + 4\0 !?", "bb"), (902, "Ω", None), (903, "x" * 50000 + " kolo" * 20000, None)]
    docs = documents(rows)
    model = train(docs.where("doc_id < 150"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in predict(docs, model, ["doc_id"]).collect()}
    assert all(got[i][0] == list(LANGS)[i % 3] for i in range(300))
    assert got[900] == ("und", 0.0) and got[901] == ("und", 0.0) and got[902][0] in LANGS and got[903][0] == "aa"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in predict(docs, train(docs.limit(0)), ["doc_id"]).collect()} == {"und"}


def test_held_out_accuracy_and_recall_on_the_tables(spark):
    from enclima.llm.queries import QUERIES
    pred = QUERIES["op10_language_id"](spark, SF_SMALL)
    truth = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "lang")
    row = pred.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert row[0] >= 0.95


def test_pipeline_stages(spark, documents):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    near = corpus_pipeline.near_duplicates(spark, docs, SF_SMALL)
    texts = {r.doc_id: r.text for r in docs.collect()}
    root = brute.op2(texts)
    assert sorted(r.doc_id for r in near.collect()) == sorted(d for d in texts if root[d][1] == d)
    clean = corpus_pipeline.decontamination(spark, near, SF_SMALL).collect()
    def leaks(text):
        s = brute.shingles(text)
        return any(len(brute.shingles(b) & s) >= 0.8 * len(brute.shingles(b)) for b in bench)
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in near.collect() if not leaks(r.text))
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert {"doc_id", "shard"} <= set(out.columns)
    odd = documents([(None, None), (1, ""), (2, "12 34"), (3, "the the and of")]).withColumns(
        {c: F.lit("k") for c in ("key", "hits", "mix_source", "pred", "share")})
    for name, stage in corpus_pipeline.STAGES:
        for rows in (odd, odd.limit(0)):
            result = stage(spark, rows, SF_SMALL)
            if name != "sharding":
                assert result.columns == odd.columns
            assert result.count() <= 4

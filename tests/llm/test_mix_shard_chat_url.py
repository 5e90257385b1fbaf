"""Mixing, sharding, chat formatting and URL filters."""
import math
from collections import defaultdict

from pyspark.sql import functions as F

from enclima.llm import chat, mixing, sharding
from enclima.llm.url_filter import url_filter

TARGETS = {"source": {"a": 0.5, "b": 0.4, "other": 0.1}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.7, "y": 0.3}}


def test_raked_marginals_and_probabilities(spark, documents):
    rows = [(i, "w " * (1 + i % 7), "en" if i % 3 else "de", "abc"[(i // 5) % 3]) for i in range(300)]
    topic = F.when(F.col("doc_id") % 4 == 0, "y").otherwise("x")
    out = mixing.mix(documents(rows), TARGETS, topic, rounds=60, trim=0.0).collect()
    assert len(out) == 300 and max(r.mix_p for r in out) == 1.0
    for dim, want in TARGETS.items():
        got = defaultdict(float)
        for r in out:
            got[r[f"mix_{dim}"]] += r.mix_tokens * r.mix_p
        total = sum(got.values())
        for value, share in want.items():
            assert math.isclose(got[value] / total, share, abs_tol=2e-3), (dim, value)
    again = {r.doc_id: r.mix_kept for r in mixing.mix(documents(rows), TARGETS, topic, rounds=60, trim=0.0).collect()}
    assert again == {r.doc_id: r.mix_kept for r in out}


def test_registered_targets_hold_with_a_hot_source(spark, documents):
    import random

    from enclima.llm.queries import MIX_ROUNDS, MIX_TARGETS
    rng = random.Random(4)
    kinds = ["note text", "word " * 300, "line\n" * 25, "a | b"]
    rows = []
    for i in range(6000):
        source = "src0" if rng.random() < 0.34 else f"src{rng.randint(1, 19)}"
        lang = rng.choices(["en", "de", "fr", "es"], [6, 2, 1, 1])[0]
        rows.append((i, rng.choices(kinds, [5, 60, 60, 20])[0], lang, source))
    docs = documents(rows)
    out = mixing.mix(docs, MIX_TARGETS, rounds=MIX_ROUNDS)
    for d, targets in MIX_TARGETS.items():
        seen = {r[0]: r[1] for r in out.groupBy(f"mix_{d}").agg(F.sum(F.col("mix_tokens") * F.col("mix_p"))).collect()}
        total, present = sum(seen.values()), sum(targets[v] for v in seen)      # shares of absent values are spread
        for v, got in seen.items():
            assert abs(got / total - targets[v] / present) < 0.005
    narrow = mixing.mix(docs, MIX_TARGETS, rounds=MIX_ROUNDS, keep_text=False)
    assert "text" not in narrow.columns
    cols = ["doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_p", "mix_kept"]
    assert sorted(narrow.select(cols).collect()) == sorted(out.select(cols).collect())


def test_scarce_cells_do_not_thin_out_the_others(spark, documents):
    """A cell of few tokens is held and the others make up for it: a larger
    draw, the same targets."""
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 1.0}}
    rows = [(i, "w " * 50, lang, source) for i, (source, lang) in enumerate(
        [("a", "en")] * 300 + [("a", "de")] * 40 + [("b", "en")] * 300 + [("b", "de")] * 400 + [("c", "en")] * 5)]
    targets["source"]["c"] = 0.02
    rows += [(9999, "w " * 50, "de", "c")]
    drawn = {}
    for trim in (0.0, mixing.TRIM):
        out = mixing.mix(documents(rows), targets, F.lit("x"), trim=trim).collect()
        assert len(out) == len(rows) and max(r.mix_p for r in out) == 1.0
        total = drawn[trim] = sum(r.mix_tokens * r.mix_p for r in out)
        for d in ("source", "lang"):
            for v, share in targets[d].items():
                got = sum(r.mix_tokens * r.mix_p for r in out if r[f"mix_{d}"] == v) / total
                assert math.isclose(got, share / sum(targets[d].values()), abs_tol=2e-3), (trim, v)
    assert mixing.TRIM > 0 and drawn[mixing.TRIM] > 1.2 * drawn[0.0]


def test_mixing_edge_cases(spark, documents):
    assert mixing.mix(documents([]), TARGETS).count() == 0
    rows = [(1, None, None, None), (1, None, None, None), (None, "a\tb\x0bc  d", "en", "zz"), (2, " \n", "xx", "a")]
    out = mixing.mix(documents(rows).withColumn("tokens", F.lit(1)), TARGETS).collect()
    assert sorted(r.mix_tokens for r in out) == [0, 0, 0, 4]
    assert {r.mix_source for r in out} == {"a", "other"} and {r.mix_lang for r in out} == {"en", "other"}


def test_shards_fit_and_cover(spark, documents):
    rows = [(i, "x" * (i % 50)) for i in range(400)] + [(999, "y" * 500)] + [(77, "z" * 40)] * 30 + [(None, None)]
    out = sharding.shard(documents(rows), 300).collect()
    assert len(out) == len(rows)
    size, names = defaultdict(int), defaultdict(set)
    for r in out:
        size[r.shard, r.page] += r.n_bytes
        names[r.doc_id].add(r.shard)
    assert all(b <= 300 or any(r.oversized for r in out if (r.shard, r.page) == k) for k, b in size.items())
    assert [r.doc_id for r in out if r.oversized] == [999]
    assert all(len(s) == 1 for s in names.values())
    plain = {s for s, _ in size}
    assert not any(a != b and b.startswith(a) for a in plain for b in plain)       # prefixes don't overlap
    assert max(r.page for r in out if r.doc_id == 77) >= 3
    one = sharding.shard(documents(rows[:3]), 10**6).collect()
    assert {(r.shard, r.page) for r in one} == {("", 0)}
    assert sharding.shard(documents([]), 10).count() == 0


def test_overflow_pages_are_filled(spark, documents):
    """Many different texts under one hash share pages."""
    rows = [(None, f"{i:04d}" + "x" * (i % 30)) for i in range(500)] + [(None, "y" * 50)] * 20 + [(None, "z" * 400), (None, "w" * 300)]
    out = sharding.shard(documents(rows), 300).collect()
    size = defaultdict(int)
    for r in out:
        size[r.shard, r.page] += r.n_bytes
    assert len(out) == len(rows) and sum(size.values()) == sum(len(t) for _, t in rows)
    assert sorted(b for b in size.values() if b > 300) == [400] and [r.n_bytes for r in out if r.oversized] == [400]
    assert len(size) <= 2 * sum(size.values()) / 300 + 2


EVENTS = "conv_id long, seq long, message long, role string, kind string, text string"


def test_fold_render_and_round_trip(spark):
    ev = [(1, 0, 10, "user", "message", "Hi <|im_end|> &lt;| & <"), (1, 1, 11, "assistant", "delta", "old"),
          (1, 2, 11, None, "regenerate", ""), (1, 3, 11, None, "delta", "new "), (1, 4, 11, None, "delta", "text<|"),
          (1, 5, 10, None, "edit", "Hello <|im_start|>assistant\nok"), (1, 6, 12, "us\ner<|", None, None),
          (2, 0, 1, None, "delta", None), (None, 3, 1, "assistant", "message", "é€😀")]
    out = {r.conv_id: r for r in chat.read_back(chat.chat_format(spark.createDataFrame(ev, EVENTS))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "Hello <|im_start|>assistant\nok"),
                                                ("assistant", "new text<|"), ("us\ner<|", "")]
    assert out[1].loss_text == "new text<|" and out[1].formatted.count(chat.START) == 3
    assert [tuple(t) for t in out[2].turns] == [("", "")] and out[2].loss_text == ""
    assert out[None].loss_text == "é€😀"
    m = out[1].loss_mask[0]
    assert out[1].formatted[m.start:m.start + m.length] == "new text&lt;|"
    assert chat.chat_format(spark.createDataFrame([], EVENTS)).count() == 0


def test_a_very_long_conversation(spark):
    import time
    n = 20_000
    ev = spark.range(2 * n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("seq"),
                                   F.floor(F.col("id") / 2).alias("message"),
                                   F.when(F.col("id") % 4 < 2, "user").otherwise("assistant").alias("role"),
                                   F.when(F.col("id") % 2 == 0, "message").otherwise("delta").alias("kind"),
                                   F.concat(F.lit("é<|"), F.col("id").cast("string")).alias("text"))
    begin = time.time()
    r = chat.read_back(chat.chat_format(ev)).first()
    text = lambda m: f"é<|{2 * m}é<|{2 * m + 1}"
    assert [tuple(t) for t in r.turns] == [("assistant" if m % 2 else "user", text(m)) for m in range(n)]
    assert r.loss_text == "".join(text(m) for m in range(1, n, 2))
    for m in r.loss_mask[::997]:
        assert r.formatted[m.start:m.start + m.length].replace("&lt;|", "<|") == text(m.turn)
    assert time.time() - begin < 60


def test_url_rules_and_aliases(spark):
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    link = '<link href="{}" REL=canonical>'.format
    rows = [(1, "http://A.example.net/en/x?y#z", ""), (2, "https://x.net", ""), (3, None, None), (4, "no-scheme", link("/q")),
            (5, "http://ok.test/p", link("http://bad.net/home")), (6, "https://ok.test/p#frag", ""),
            (7, "http://other.test/a/b", '<meta http-equiv="Refresh" content="0; url=../c">'), (8, "http://third.test/", link("//ok.test/p")),
            (9, "http://s.org/fr/1", link("http://evil.net/fr")), (10, "http://t.test/", link("http://s.org/fr/1")),
            (11, "http://x.example.com/de/", link("/en")), (12, "http://x.example.com/en", ""), (5, "http://ok.test/p", link("http://bad.net/home"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit(1))
    got = {r.page_id: r for r in url_filter(pages, rules).collect()}
    assert {k: (r.rule, r.verdict) for k, r in got.items()} == {
        1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "block"),
        6: (None, "block"), 7: (None, "allow"), 8: (None, "block"), 9: ("org/fr/", "allow"), 10: (None, "allow"),
        11: ("example.com/de/", "block"), 12: (None, "block")}
    assert (got[1].host, got[1].path) == ("a.example.net", "/en/x") and (got[3].host, got[3].path) == ("", "")
    assert url_filter(pages, rules).count() == len(rows)
    log = spark.createDataFrame([("http://other.test/a/b", "http://gone.net/")], "src string, dst string")
    assert {r.page_id: r.verdict for r in url_filter(pages, rules, log).collect()}[7] == "block"
    assert url_filter(pages.limit(0), rules).count() == 0

"""Registered queries of the training-data operators, over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


# Words of the contracts, as a regular expression of DuckDB.
WORD_SQL = r"[^\x20\x09-\x0D]+"

_OP1_SQL = f"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win)
          WHERE r > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i + o AS p FROM later, range(20) t(o)),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(lost.n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '{WORD_SQL}') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
   FROM w, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_sides AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM both_sides JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
   WHERE 100 * i >= 80 * (x.n + y.n - i)),
way AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM way UNION SELECT r.a, w.b FROM reach r JOIN way w ON r.b = w.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.low, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a) m USING (doc_id)"""

_OP3_SQL = """
WITH t AS MATERIALIZED (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
part AS MATERIALIZED (SELECT doc_id, c, substr(h, 800 * c + 1, 1198) AS p FROM t, unnest(range(0, length(h) // 800 + 1)) u(c)),
win AS (SELECT doc_id, 400 * c + j AS i, md5(substr(p, 2 * j + 1, 400)) AS k
        FROM part, unnest(range(0, least(length(p) // 2 - 199, 400))) u(j)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM win) WHERE c > 1),
edge AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM hit),
run AS (SELECT doc_id, i, sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM edge),
span AS MATERIALIZED (SELECT doc_id, r, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY doc_id, r),
rest AS (SELECT doc_id, a, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM span
         UNION ALL SELECT doc_id, length(h) // 2, coalesce(x.b, 0) FROM t LEFT JOIN (SELECT doc_id, max(b) AS b FROM span GROUP BY doc_id) x USING (doc_id)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY from_) AS k FROM rest JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(s.n, 0)::BIGINT AS n_removed, coalesce(s.c, 0) AS n_spans,
  sha256(unhex(kept.k)) AS kept_sha256
FROM t JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM span GROUP BY doc_id) s USING (doc_id)"""


@query("op1_substring_dedup", _OP1_SQL)
def op1_substring_dedup(spark, base):
    """20-word windows that start earlier, taken out of every document."""
    from .substring_dedup import substring_dedup
    return (substring_dedup(read_table(spark, base, "documents"), words=20)
            .select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))


@query("op2_ngram_jaccard_join", _OP2_SQL)
def op2_ngram_jaccard_join(spark, base):
    """Components of documents with a 5-word shingle Jaccard of 0.8 or more."""
    from .ngram_join import ngram_join
    return ngram_join(read_table(spark, base, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op3_suffix_dedup", _OP3_SQL)
def op3_suffix_dedup(spark, base):
    """200-byte strings that also start elsewhere, taken out of every document."""
    from .suffix_dedup import suffix_dedup
    return (suffix_dedup(read_table(spark, base, "documents"), length=200)
            .select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


@query("op10_language_id")
def op10_language_id(spark, base):
    """Language of every whole text; documents with remainder 2 are held out."""
    from .language_id import predict, train
    docs = read_table(spark, base, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(held_out(), F.lit(False))
    model = train(docs.where(~held))
    return (predict(docs, model, ["doc_id"])
            .select("doc_id", held.alias("held_out"), "lang_pred", F.round("score", 6).alias("score")))


# Tempered targets of the mixture (shares; a value not named falls to "other").
MIX_TARGETS = {
    "source": {"src0": 0.2, **{f"src{i}": 0.0415 for i in range(1, 20)}, "other": 0.0115},
    "lang": {"en": 0.5, "de": 0.17, "fr": 0.17, "es": 0.15, "other": 0.01},
    "topic": {"article": 0.6, "list": 0.34, "note": 0.04, "table": 0.02},
}
MIX_ROUNDS = 12
# Share of the weight held by scarce cells that are held at what they have.
MIX_TRIM = 0.1


def _mix_sql() -> str:
    def named(col, d):
        values = ", ".join(f"'{v}'" for v in sorted(MIX_TARGETS[d]))
        return f"CASE WHEN {col} IN ({values}) THEN {col} ELSE 'other' END AS mix_{d}"

    dims = ("source", "lang", "topic")
    goal = {d: "(CASE " + " ".join(f"WHEN mix_{d} = '{v}' THEN {s!r}" for v, s in sorted(MIX_TARGETS[d].items()))
            + " ELSE 0.0 END)::DOUBLE" for d in dims}
    sql, rest = "SELECT *, CAST(tokens AS DOUBLE) AS w FROM cells", "SELECT * FROM capped"
    for _ in range(MIX_ROUNDS):
        for d in dims:
            sql = (f"SELECT * EXCLUDE (w), CASE WHEN sum(w) OVER (PARTITION BY mix_{d}) > 0 THEN "
                   f"w * {goal[d]} / sum(w) OVER (PARTITION BY mix_{d}) ELSE 0 END AS w "
                   f"FROM ({sql})")
            free = f"sum(CASE WHEN held THEN 0.0::DOUBLE ELSE w END) OVER (PARTITION BY mix_{d})"
            fixed = f"sum(CASE WHEN held THEN w ELSE 0.0::DOUBLE END) OVER (PARTITION BY mix_{d})"
            rest = (f"SELECT * EXCLUDE (w), CASE WHEN held THEN w WHEN {free} > 0 THEN "
                    f"w * greatest(goal_{d} - {fixed}, 0) / {free} ELSE 0 END AS w FROM ({rest})")
    spare = ", ".join(f"sum(CASE WHEN ratio > ref THEN 0.0::DOUBLE ELSE w END) OVER (PARTITION BY mix_{d}) AS free_{d}, "
                      f"{goal[d]} AS g_{d}, sum(CASE WHEN tokens > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY mix_{d}) AS n_{d}"
                      for d in dims)
    goals = ", ".join(f"CASE WHEN all_{d} > 0 THEN g_{d} * total / all_{d} ELSE 0 END AS goal_{d}" for d in dims)
    sums = ", ".join(f"sum(CASE WHEN tokens > 0 THEN g_{d} / n_{d} END) OVER () AS all_{d}" for d in dims)
    return f"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents),
u AS (SELECT doc_id, source, lang, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS mix_tokens,
        CASE WHEN instr(t, ' | ') > 0 THEN 'table'
             WHEN length(t) - length(replace(t, chr(10), '')) >= 20 THEN 'list'
             WHEN length(t) < 1000 THEN 'note' ELSE 'article' END AS topic FROM t),
n AS (SELECT doc_id, mix_tokens, {named('source', 'source')}, {named('lang', 'lang')}, {named('topic', 'topic')} FROM u),
cells AS (SELECT mix_source, mix_lang, mix_topic, sum(mix_tokens)::BIGINT AS tokens FROM n GROUP BY ALL),
raked AS ({sql}),
ratio AS (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS ratio FROM raked),
scarce AS (SELECT *, sum(w) OVER (ORDER BY ratio DESC, mix_source, mix_lang, mix_topic
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, sum(w) OVER () AS total FROM ratio),
ref AS (SELECT *, max(CASE WHEN s > {MIX_TRIM} * total THEN ratio END) OVER () AS ref FROM scarce),
spare AS (SELECT *, {spare} FROM ref),
goals AS (SELECT *, coalesce(ratio > ref AND free_source > 0 AND free_lang > 0 AND free_topic > 0, false) AS held, {sums}
  FROM spare),
capped AS (SELECT mix_source, mix_lang, mix_topic, tokens, held, CASE WHEN held THEN tokens * ref ELSE w END AS w, {goals}
  FROM goals),
rested AS ({rest}),
ratio2 AS (SELECT *, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS ratio FROM rested),
ref2 AS (SELECT *, max(ratio) OVER () AS ref FROM ratio2),
p AS (SELECT mix_source, mix_lang, mix_topic,
        round(CASE WHEN ref > 0 THEN ratio / ref ELSE 0 END, 6) AS mix_p FROM ref2)
SELECT n.doc_id, n.mix_source, n.mix_lang, n.mix_topic, n.mix_tokens, p.mix_p,
  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 8)) AS BIGINT) / 4294967296.0 < p.mix_p
    AS mix_kept
FROM n JOIN p USING (mix_source, mix_lang, mix_topic)"""


@query("op4_source_mixing", _mix_sql())
def op4_source_mixing(spark, base):
    """Raked draw of documents by source, language and topic targets."""
    from .mixing import mix
    docs = read_table(spark, base, "documents").select("doc_id", "text", "lang", "source")
    return (mix(docs, MIX_TARGETS, rounds=MIX_ROUNDS, trim=MIX_TRIM, keep_text=False)
            .select("doc_id", "mix_source", "mix_lang", "mix_topic", "mix_tokens", "mix_p", "mix_kept"))


URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


def _url_sql() -> str:
    from .url_filter import CANONICAL_TAG, HREF, REFRESH_TAG, REFRESH_URL
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def parts(url, pre=""):
        rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
        low = "translate(regexp_extract({r}, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        tail = f"regexp_replace({rest}, '^[^/?#]*', '')"
        return (f"coalesce({low.format(r=rest)}, '') AS {pre}host, "
                f"coalesce(regexp_extract({tail}, '^[^?#]*', 0), '') AS {pre}path, "
                f"CASE WHEN coalesce({low.format(r=rest)}, '') <> '' THEN {low.format(r=rest)} || "
                f"CASE WHEN regexp_extract({tail}, '^[^#]*', 0) = '' THEN '/' ELSE regexp_extract({tail}, '^[^#]*', 0) END "
                f"END AS {pre}node")

    def rule(h, p, pick):
        order = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
        return "CASE " + " ".join(
            f"WHEN ({h} = '{a}' OR ends_with({h}, '.{a}')) AND starts_with({p}, '{b}') THEN "
            f"'{a + b if pick == 'rule' else v}'" for a, b, v in order) + " END"

    scheme = "split_part(url, '://', 1)"
    return f"""
WITH RECURSIVE pg AS (SELECT page_id, url, html, {parts('url')} FROM pages),
found AS (
  SELECT url, host, path, node, unnest([regexp_extract(regexp_extract(html, {quote(CANONICAL_TAG)}, 0), {quote(HREF)}, 1),
                     regexp_extract(regexp_extract(html, {quote(REFRESH_TAG)}, 0), {quote(REFRESH_URL)}, 1)]) AS target0
  FROM pg WHERE instr(url, '://') > 0),
target AS (SELECT *, replace(target0, '&amp;', '&') AS target FROM found WHERE target0 <> ''),
link AS (SELECT node AS src, host AS src_host, path AS src_path,
    CASE WHEN instr(target, '://') > 0 THEN target WHEN starts_with(target, '//') THEN {scheme} || ':' || target
         WHEN starts_with(target, '/') THEN {scheme} || '://' || host || target
         ELSE {scheme} || '://' || host || regexp_replace(path, '[^/]*$', '') || target END AS dst_url FROM target),
ends AS (SELECT * FROM (SELECT src, src_host, src_path, {parts('dst_url', 'dst_')} FROM link)
         WHERE src IS NOT NULL AND dst_node IS NOT NULL),
both_ways AS (SELECT src AS a, dst_node AS b FROM ends UNION SELECT dst_node, src FROM ends),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
verdicts AS (SELECT src AS node, {rule('src_host', 'src_path', 'v')} AS v FROM ends
             UNION SELECT dst_node, {rule('dst_host', 'dst_path', 'v')} FROM ends),
carried AS (SELECT r.a AS node, bool_or(coalesce(v = 'block', false)) AND NOT bool_or(coalesce(v = 'allow', false)) AS c
            FROM (SELECT a, b FROM reach UNION SELECT a, a FROM both_ways) r JOIN verdicts ON verdicts.node = r.b GROUP BY 1)
SELECT page_id, host, path, {rule('host', 'path', 'rule')} AS rule,
  coalesce({rule('host', 'path', 'v')}, CASE WHEN c THEN 'block' ELSE 'allow' END) AS verdict
FROM pg LEFT JOIN carried ON carried.node = pg.node"""


@query("op5_url_filter", _url_sql())
def op5_url_filter(spark, base):
    """Verdict of every page by rules and by its aliases."""
    from .url_filter import url_filter
    return (url_filter(read_table(spark, base, "pages"), URL_RULES)
            .select("page_id", "host", "path", "rule", "verdict"))


CONTROL = "<|im_end|><|im_start|>assistant ok"


@query("op7_chat_format", f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST,
        text NULLS FIRST) AS seq, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|'))
        + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) AS size FROM n)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size + length('<|im_start|>') + length('<|im_end|>') + 2)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""")
def op7_chat_format(spark, base):
    """Formatted conversations, read back from the formatted text."""
    from pyspark.sql import Window
    from .chat import chat_format, read_back
    rows = read_table(spark, base, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
                 F.lit(r).alias("role"), F.lit(CONTROL).alias("text"))
        for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    rows = rows.unionByName(own)
    # a row's place is its message; its log is the whole text, two deltas, a draft
    # that is edited, or a draft and a new try in deltas
    seq = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    left, right = F.substr("text", F.lit(1), half), F.substr("text", half + 1)

    def log(*steps):
        return F.array(*[F.struct(F.lit(kind).alias("kind"), text.alias("text")) for kind, text in steps])

    draft = F.lit("draft <|im_end|>")
    steps = (F.when(F.col("seq") % 4 == 0, log(("message", F.col("text"))))
             .when(F.col("seq") % 4 == 1, log(("message", F.lit("")), ("delta", left), ("delta", right)))
             .when(F.col("seq") % 4 == 2, log(("message", draft), ("edit", F.col("text"))))
             .otherwise(log(("message", draft), ("regenerate", left), ("delta", right))))
    events = (rows.withColumn("seq", seq).withColumn("text", F.coalesce("text", F.lit("")))
              .select("conv_id", "role", "seq", F.posexplode(steps).alias("step", "event"))
              .select("conv_id", (F.col("seq") * 4 + F.col("step")).alias("seq"), F.col("seq").alias("message"), "role",
                      "event.kind", "event.text"))
    back = read_back(chat_format(events))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(F.array_join(line, "").cast("binary"), 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


SHARD_BYTES = 64 << 20


@query("op8_sharding", f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
g AS (SELECT d.*, depth, h >> (60 - depth) AS prefix FROM d, generate_series(0, 40) s(depth)),
b AS (SELECT depth, prefix, sum(n_bytes) AS bytes FROM g GROUP BY ALL),
leaf AS (SELECT b.depth, b.prefix FROM b LEFT JOIN b up ON up.depth = b.depth - 1 AND up.prefix = b.prefix >> 1
         WHERE b.bytes <= {SHARD_BYTES} AND (b.depth = 0 OR up.bytes > {SHARD_BYTES}))
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard,
  0::BIGINT AS page, false AS oversized
FROM g JOIN leaf USING (depth, prefix)""")
def op8_sharding(spark, base):
    """Shard of every document: hash buckets of at most 64 MiB of text."""
    from .sharding import shard
    return shard(read_table(spark, base, "documents"), SHARD_BYTES)


_OP9_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda y: y::DOUBLE) AS e
    FROM embeddings),
good AS MATERIALIZED (SELECT r, vec_id, e, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS size FROM v
   WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda y: y IS NULL OR NOT isfinite(y))) = 0
     AND len(list_filter(e, lambda y: y <> 0)) > 0),
link AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.e) = len(b.e)
   WHERE list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.9),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT reach.a AS r, min(v.vec_id) AS low FROM reach JOIN v ON v.r = reach.b GROUP BY reach.a),
deg AS (SELECT a AS r, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(deg.n, 0) AS n_links, least(vec_id, coalesce(low.low, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(low.low, vec_id)) AS kept
FROM v LEFT JOIN low USING (r) LEFT JOIN deg USING (r)"""


@query("op9_embedding_near_dedup", _OP9_SQL)
def op9_embedding_near_dedup(spark, base):
    """Components of embeddings with cosine 0.9 or more."""
    from .embedding_dedup import near_duplicates
    return near_duplicates(read_table(spark, base, "embeddings").select("vec_id", "embedding"), threshold=0.9)


@query("op6_benchmark_decontamination")
def op6_benchmark_decontamination(spark, base):
    """Benchmark items found in every whole text."""
    from .decontaminate import decontaminate
    docs = read_table(spark, base, "documents").select("doc_id", "text")
    found = decontaminate(docs, read_table(spark, base, "benchmark"), hits="hits")
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"),
                        F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item_id"]))).alias("item_ids"),
                        F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)).alias("best_score"))


TOKEN_LIMIT = 1024


@query("op13_token_counts")
def op13_token_counts(spark, base):
    """Tokens of every whole text and the longest prefix within the limit,
    read from the stored counts of all prefixes."""
    from .token_counts import prefix_counts, truncate
    counted = prefix_counts(read_table(spark, base, "documents").select("doc_id", "text"))
    return truncate(counted, TOKEN_LIMIT).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars")


@query("op11_token_alignment")
def op11_token_alignment(spark, base):
    """Groups and links of two tokenizers' tokens for every whole text."""
    from .token_alignment import align
    found = align(read_table(spark, base, "documents").select("doc_id", "text"), hashed=True)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                        F.col("groups").alias("groups_sha256"))


CLUSTERS, CLUSTER_ROUNDS = 8, 10


def _cluster_sql() -> str:
    """Rounds as common table expressions over (vector, dimension) rows."""
    def floor_div(s, n):
        return f"(({s}) - ((({s}) % ({n})) + ({n})) % ({n})) // ({n})"

    def assign(i):
        return f"""
d{i} AS MATERIALIZED (SELECT x.r, c.c, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d
  FROM x JOIN c{i} c ON c.j = x.j GROUP BY x.r, c.c),
a{i} AS MATERIALIZED (SELECT r, c, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, c) AS k FROM d{i})
  WHERE k = 1)"""

    steps = []
    for i in range(CLUSTER_ROUNDS):
        steps.append(assign(i) + f""",
m{i} AS (SELECT a.c, x.j, sum(x.v)::BIGINT AS s, count(*) AS n FROM a{i} a JOIN x USING (r) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT c.c, c.j, CASE WHEN m.n IS NULL THEN c.v ELSE {floor_div('m.s', 'm.n')} END::BIGINT AS v
  FROM c{i} c LEFT JOIN m{i} m ON m.c = c.c AND m.j = c.j)""")
    last = CLUSTER_ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT r, generate_subscripts(embedding, 1) AS j,
                     floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS v FROM kept),
o AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS c FROM kept),
c0 AS MATERIALIZED (SELECT o.c, x.j, x.v FROM o JOIN x USING (r) WHERE o.c < {CLUSTERS}),
{",".join(steps)},{assign(last)},
h AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY j)) AS centroid_sha256 FROM c{last} GROUP BY c)
SELECT kept.vec_id, a.c::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM a{last} a JOIN kept USING (r) JOIN h USING (c)"""


@query("op12_centroid_clustering", _cluster_sql())
def op12_centroid_clustering(spark, base):
    """Integer k-means over all 64-component embeddings."""
    from .centroids import cluster, with_inertia
    assigned, centroids = cluster(read_table(spark, base, "embeddings").select("vec_id", "embedding"),
                                  k=CLUSTERS, rounds=CLUSTER_ROUNDS, dim=64, scale=1024, seed="3:")
    digest = F.lit(None).cast("string")
    for c, centroid in enumerate(centroids):
        digest = F.when(F.col("cluster") == c, F.sha2(F.lit(",".join(map(str, centroid))).cast("binary"), 256)).otherwise(digest)
    return with_inertia(assigned).withColumn("centroid_sha256", digest)

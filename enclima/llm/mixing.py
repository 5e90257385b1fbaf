"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic). The cell weights are
raked: scaled to the target marginal of each dimension in turn, again and
again. A cell's calibrated probability is its raked weight over its tokens,
scaled so that the scarcest cell is kept whole; a document is drawn by its
cell's probability with a hash of its id, so the draw is the same in every run
and all marginals are met in expectation. So that a few scarce cells don't thin
out all others, those that together hold the share ``trim`` of the raked weight
or less are held at what they have, and the other cells are raked again to what
is left of the targets: more documents, and marginals that hold. A cell is held
only if each of its values has another cell to fill its target.

Whole texts are read once for the cells and once for the result; with
``keep_text=False`` once in all, for the result is then drawn from a narrow
table of the other columns.

Only DataFrame and SQL functions are used. The targets are parameters; a value
that they don't name falls to the cell value ``other``, so the number of cells
is at most the product of (named values + 1), whatever the size of the input.
The cell table is therefore the only thing that is broadcast.

A target without tokens has no effect (its share is spread over the others). A cell
without tokens has probability 0. Edge cases: null source, language or topic
counts as ``other``; a null or empty text has 0 tokens and is drawn like any
document of its cell; repeated rows and rows that share an id share the draw;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, save

DIMS = ("source", "lang", "topic")
OTHER = "other"
ROUNDS = 12
TRIM = 0.1
SEED = "mix"


def n_tokens(text: str = "text") -> Column:
    """Words of a text: runs of bytes other than 0x20 and 0x09-0x0D."""
    t = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.when(F.trim(t) == "", F.lit(0)).otherwise(F.size(F.split(F.trim(t), " +"))).cast("long")


def topic(text: str = "text") -> Column:
    """Topic of a document by its form: table rows, list of lines, short note
    or article. Stands in where the documents have no topic column."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.length(t) - F.length(F.translate(t, "\n", ""))
    return (F.when(F.instr(t, " | ") > 0, "table").when(lines >= 20, "list")
            .when(F.length(t) < 1000, "note").otherwise("article"))


def draw(doc_id: Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of md5(doc_id, seed)."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{SEED}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def _named(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin(sorted(targets)), value).otherwise(F.lit(OTHER))


def cells_of(docs: DataFrame, targets: dict[str, dict[str, float]], topic_column: Column) -> DataFrame:
    """Adds mix_source, mix_lang, mix_topic and mix_tokens."""
    value = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": topic_column}
    return docs.withColumns({**{f"mix_{d}": _named(value[d], targets[d]) for d in DIMS}, "mix_tokens": n_tokens()})


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int = ROUNDS) -> DataFrame:
    """Raked weights of the cells (mix_source, mix_lang, mix_topic, tokens):
    adds w. Each step scales the cells of a value by its target over their
    present sum; a common factor (targets of absent values) does not matter.

    The cell table is bounded by the targets, so it is held in one partition
    and all steps are window sums in one task without a shuffle."""
    cur = cells.coalesce(1).withColumn("w", F.col("tokens").cast("double"))
    for i in range(rounds):
        if i and i % ROUNDS == 0:               # keep the plan shallow
            cur = save(cur)[0].coalesce(1)
        for d in DIMS:
            held = F.sum("w").over(Window.partitionBy(f"mix_{d}"))
            cur = cur.withColumn("w", F.when(held > 0, F.col("w") * _goal(d, targets) / held).otherwise(F.lit(0.0)))
    return cur


def _goal(d: str, targets: dict[str, dict[str, float]]) -> Column:
    goal = F.lit(0.0)
    for value, share in sorted(targets[d].items()):
        goal = F.when(F.col(f"mix_{d}") == value, F.lit(float(share))).otherwise(goal)
    return goal


def _ratio() -> Column:
    return F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(F.lit(0.0))


def hold_scarce(raked: DataFrame, targets: dict[str, dict[str, float]], trim: float) -> DataFrame:
    """Raked cells as ``held`` (weight of a scarce cell, lowered to the ratio
    of the first cell that is not; else 0), w (weight of another cell; else 0)
    and what the held cells leave of each value's goal: left_source, left_lang,
    left_topic."""
    every, cell = Window.partitionBy(), [f"mix_{d}" for d in DIMS]
    cur = (raked.withColumn("ratio", _ratio())
           .withColumn("scarce", F.sum("w").over(Window.orderBy(F.desc("ratio"), *cell)))
           .withColumn("total", F.sum("w").over(every))
           .withColumn("ref", F.max(F.when(F.col("scarce") > trim * F.col("total"), F.col("ratio"))).over(every)))
    held = F.col("ratio") > F.col("ref")
    for d in DIMS:
        same, has = Window.partitionBy(f"mix_{d}"), F.when(F.col("tokens") > 0, F.lit(1)).otherwise(F.lit(0))
        cur = (cur.withColumn(f"free_{d}", F.sum(F.when(F.col("ratio") > F.col("ref"), F.lit(0.0)).otherwise(F.col("w"))).over(same))
               .withColumn(f"n_{d}", F.sum(has).over(same)).withColumn(f"goal_{d}", _goal(d, targets))
               .withColumn(f"all_{d}", F.sum(F.when(F.col("tokens") > 0, F.col(f"goal_{d}") / F.col(f"n_{d}"))).over(every))
               .withColumn(f"goal_{d}", F.when(F.col(f"all_{d}") > 0, F.col(f"goal_{d}") * F.col("total") / F.col(f"all_{d}"))
                           .otherwise(F.lit(0.0))))
        held = held & (F.col(f"free_{d}") > 0)
    cur = cur.withColumn("is", F.coalesce(held, F.lit(False))).select(
        *cell, "tokens", *[f"goal_{d}" for d in DIMS],
        F.when(F.col("is"), F.col("tokens") * F.col("ref")).otherwise(F.lit(0.0)).alias("held"),
        F.when(F.col("is"), F.lit(0.0)).otherwise(F.col("w")).alias("w"))
    left = [F.greatest(F.col(f"goal_{d}") - F.sum("held").over(Window.partitionBy(f"mix_{d}")), F.lit(0.0)).alias(f"left_{d}")
            for d in DIMS]
    return cur.select(*cell, "tokens", "held", "w", *left)


def rake_rest(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``hold_scarce`` cells, those not held raked to what the held ones leave."""
    cur = cells.coalesce(1)
    for i in range(rounds):
        if i and i % ROUNDS == 0:               # keep the plan shallow
            cur = save(cur)[0].coalesce(1)
        for d in DIMS:
            free = F.sum("w").over(Window.partitionBy(f"mix_{d}"))
            cur = cur.withColumn("w", F.when(free > 0, F.col("w") * F.col(f"left_{d}") / free).otherwise(F.lit(0.0)))
    return cur.select(*[f"mix_{d}" for d in DIMS], "tokens", (F.col("held") + F.col("w")).alias("w"))


def _fit(named: DataFrame, targets: dict[str, dict[str, float]], rounds: int, trim: float) -> DataFrame:
    cells, path = save(named.groupBy(*(f"mix_{d}" for d in DIMS)).agg(F.sum("mix_tokens").alias("tokens")))
    raked, paths = rake(cells, targets, rounds), [path]
    if trim > 0:
        held, path = save(hold_scarce(raked, targets, trim))
        raked, paths = rake_rest(held, rounds), [*paths, path]
    out, _ = save(raked.withColumn("ratio", _ratio()).withColumn("ref", F.max("ratio").over(Window.partitionBy()))
                  .withColumn("p", F.when(F.col("ref") > 0, F.col("ratio") / F.col("ref")).otherwise(F.lit(0.0)))
                  .drop("ratio", "ref"))
    for path in paths:
        remove(named.sparkSession, path)
    return out


def fit(docs: DataFrame, targets: dict[str, dict[str, float]], topic_column: Column | None = None,
        rounds: int = ROUNDS, trim: float = TRIM) -> DataFrame:
    """Cell table: mix_source, mix_lang, mix_topic, tokens, w, p."""
    return _fit(cells_of(docs, targets, topic() if topic_column is None else topic_column), targets, rounds, trim)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]], topic_column: Column | None = None,
        rounds: int = ROUNDS, trim: float = TRIM, keep_text: bool = True) -> DataFrame:
    """``docs`` (without ``text`` unless ``keep_text``) with mix_source,
    mix_lang, mix_topic, mix_tokens, mix_p and mix_kept (drawn or not). Keep the
    rows with mix_kept for the mixture."""
    named = cells_of(docs, targets, topic() if topic_column is None else topic_column)
    if not keep_text:
        named, _ = save(named.drop("text"))
    cells = _fit(named, targets, rounds, trim)
    keys = [f"mix_{d}" for d in DIMS]
    table = F.broadcast(cells.select(*keys, F.round("p", 6).alias("mix_p")))     # bounded by the targets
    return (named.join(table, keys, "left").withColumn("mix_p", F.coalesce("mix_p", F.lit(0.0)))
            .withColumn("mix_kept", draw(F.col("doc_id")) < F.col("mix_p")))

"""Stand-in facts on the driver tables (TPC-H-like parquet).

They only give rows in the schemas the operators expect; all the work of a
query happens in the operators applied to them.

* GEN    generation fact ``(ts, sub, cat, value)`` = orders x customer x nation
         x region -> (o_orderdate, r_name, o_orderpriority, o_totalprice)
* LOAD   load fact ``(ts, sub, value, ...)`` = lineitem x supplier x nation x
         region -> (l_shipdate, r_name, l_quantity, l_extendedprice, l_tax)
* HOURLY sub-daily fact ``(ts, key, value)`` = events
* GRID   ``(date, values ARRAY<DOUBLE>)`` = embeddings, vec_id -> day

The fact-to-dimension joins are plain equi-joins: customer / lineitem /
orders-sized sides shuffle (sort-merge or AQE's choice); nation and region are
tiny files that the planner broadcasts from their own statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

# Category remap used on the GEN stand-in (plays the fuel -> class map).
PRIORITY_CLASS = {
    "1-URGENT": "HIGH",
    "2-HIGH": "HIGH",
    "4-NOT SPECIFIED": "OTHER",
    "5-LOW": "OTHER",
}

# Region -> macro region on the stand-in (plays N+NE, S+SE).
MACRO_REGION = {
    "AMERICA": "AMERICAS",
    "EUROPE": "EMEA",
    "AFRICA": "EMEA",
    "MIDDLE EAST": "EMEA",
    "ASIA": "APAC",
}

# Stand-in series -> climate index name whose sentinel marks missing months.
PRIORITY_INDEX = {
    "1-URGENT": "AMO",
    "2-HIGH": "ONI",
    "3-MEDIUM": "SOI",
    "4-NOT SPECIFIED": "PDO",
    "5-LOW": "NAO",
}

# Grid coordinates for the 64 embedding positions (lat-major 8 x 8). Raw
# longitudes are 0..360 so the wrap rule (180 -> -180, 359.75) is exercised.
GRID_LATS = [-10.0, -7.5, -5.0, -2.5, 0.0, 2.5, 5.0, 7.5]
GRID_LONS = [160.0, 170.0, 180.0, 200.0, 210.0, 240.0, 275.0, 359.75]
GRID_START = "1995-01-01"


def gen_fact(spark: SparkSession, base: str) -> DataFrame:
    o = read_table(spark, base, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    c = read_table(spark, base, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, base, "nation").select("n_nationkey", "n_regionkey")
    r = read_table(spark, base, "region").select("r_regionkey", "r_name")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .join(n, c.c_nationkey == n.n_nationkey)
             .join(r, n.n_regionkey == r.r_regionkey)
             .select(F.col("o_orderdate").alias("ts"), F.col("r_name").alias("sub"),
                     F.col("o_orderpriority").alias("cat"), F.col("o_totalprice").alias("value")))


def load_fact(spark: SparkSession, base: str) -> DataFrame:
    li = read_table(spark, base, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity",
                                                    "l_extendedprice", "l_tax")
    s = read_table(spark, base, "supplier").select("s_suppkey", "s_nationkey")
    n = read_table(spark, base, "nation").select("n_nationkey", "n_regionkey")
    r = read_table(spark, base, "region").select("r_regionkey", "r_name")
    return (li.join(s, li.l_suppkey == s.s_suppkey)
              .join(n, s.s_nationkey == n.n_nationkey)
              .join(r, n.n_regionkey == r.r_regionkey)
              .select(F.col("l_shipdate").alias("ts"), F.col("r_name").alias("sub"),
                      F.col("l_quantity").alias("value"), "l_quantity", "l_extendedprice", "l_tax"))


def hourly_fact(spark: SparkSession, base: str) -> DataFrame:
    return read_table(spark, base, "events").select("ts", F.col("event_type").alias("key"), "value")


def grid_arrays(spark: SparkSession, base: str) -> DataFrame:
    e = read_table(spark, base, "embeddings").select("vec_id", "embedding")
    return e.select(F.date_add(F.lit(GRID_START).cast("date"), F.col("vec_id").cast("int")).alias("Data"),
                    F.col("embedding").alias("values"))


# Text of the missing-month marker written in the stand-in index files.
SENTINEL_TEXT = {"AMO": "-99.990", "ONI": "-99.9", "SOI": "-99.99", "PDO": "-9.9", "NAO": "-99.9"}
FOOTER_13 = "values are monthly totals of order prices by priority for every calendar year"


def _index_monthly(spark: SparkSession, base: str) -> DataFrame:
    g = gen_fact(spark, base)
    idx = F.create_map(*[F.lit(x) for kv in PRIORITY_INDEX.items() for x in kv])[F.col("cat")]
    return (g.groupBy(idx.alias("index_name"), F.year("ts").alias("y"), F.month("ts").alias("m"))
             .agg(F.round(F.sum("value"), 2).alias("v")))


def index_text_lines(spark: SparkSession, base: str) -> DataFrame:
    """Blank-separated index files as (index_name, line): a header
    ``first last`` line, one ``year v1 .. v12`` line per year (missing months
    written as the index's sentinel), a sentinel line and two footers."""
    mo = _index_monthly(spark, base)
    sent = F.create_map(*[F.lit(x) for kv in SENTINEL_TEXT.items() for x in kv])[F.col("index_name")]
    years = mo.groupBy("index_name", "y").agg(
        *[F.first(F.when(F.col("m") == k, F.format_string("%.2f", F.col("v"))), ignorenulls=True).alias(f"m{k}")
          for k in range(1, 13)])
    data = years.select("index_name", F.concat_ws(
        " ", F.col("y").cast("string"), *[F.coalesce(F.col(f"m{k}"), sent) for k in range(1, 13)]).alias("line"))
    heads = mo.groupBy("index_name").agg(F.concat_ws(" ", F.min("y").cast("string"),
                                                     F.max("y").cast("string")).alias("line"))
    names = heads.select("index_name")
    tails = (names.select("index_name", F.concat(F.lit("  "), sent).alias("line"))
             .unionByName(names.select("index_name", F.lit(FOOTER_13).alias("line")))
             .unionByName(names.select("index_name", F.concat(F.col("index_name"), F.lit(" from orders")).alias("line"))))
    return heads.unionByName(data).unionByName(tails)


def index_semicolon_rows(spark: SparkSession, base: str) -> DataFrame:
    """``;`` layout rows (index_name, date_text, value_text): date text is three
    characters then ``ddMMMyyyy``."""
    mo = _index_monthly(spark, base)
    d = F.make_date("y", "m", F.lit(1))
    return mo.select("index_name", F.concat(F.lit("idx"), F.date_format(d, "ddMMMyyyy")).alias("date_text"),
                     F.format_string("%.2f", F.col("v")).alias("value_text"))

"""Queries: index text parsing/merge/sentinels and gridded regions
(sections 2.1, 2.2, 2.3, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dims import ENSO_REGIONS, regions_df
from ..functions import rnd
from ..operators import regions as REG
from ..sources import index_text as IT
from . import standins as S
from .registry import GEN_CTE, R, query

INDICES = ["AMO", "NAO", "ONI", "PDO", "SOI"]

_IDX_CASE = ("CASE cat WHEN '1-URGENT' THEN 'AMO' WHEN '2-HIGH' THEN 'ONI' WHEN '3-MEDIUM' THEN 'SOI' "
             "WHEN '4-NOT SPECIFIED' THEN 'PDO' ELSE 'NAO' END")
_SENT_VALUES = "('AMO','-99.990'),('ONI','-99.9'),('SOI','-99.99'),('PDO','-9.9'),('NAO','-99.9')"
_MONTHS = ", ".join(f"COALESCE(MAX(printf('%.2f', v)) FILTER (WHERE m = {k}), st)" for k in range(1, 13))

INDEX_LINES_SQL = f"""{GEN_CTE},
gm AS (SELECT {_IDX_CASE} AS index_name, year(ts) AS y, month(ts) AS m, ROUND(SUM(value), 2) AS v
       FROM gen GROUP BY ALL),
sent AS (SELECT * FROM (VALUES {_SENT_VALUES}) s(index_name, st)),
lines AS (
  SELECT index_name, CAST(y AS VARCHAR) || ' ' || concat_ws(' ', {_MONTHS}) AS line
  FROM gm JOIN sent USING (index_name) GROUP BY index_name, y, st
  UNION ALL SELECT index_name, CAST(min(y) AS VARCHAR) || ' ' || CAST(max(y) AS VARCHAR) FROM gm GROUP BY ALL
  UNION ALL SELECT index_name, '  ' || st FROM sent WHERE index_name IN (SELECT index_name FROM gm)
  UNION ALL SELECT DISTINCT index_name, '{S.FOOTER_13}' FROM gm
  UNION ALL SELECT DISTINCT index_name, index_name || ' from orders' FROM gm),
tok AS (SELECT index_name, string_split_regex(trim(line), '\\s+') AS t FROM lines),
parsed AS (
  SELECT index_name, make_date(TRY_CAST(t[1] AS INTEGER), r.i, 1) AS Data, TRY_CAST(t[r.i + 1] AS DOUBLE) AS value
  FROM tok, range(1, 13) r(i) WHERE len(t) = 13 AND TRY_CAST(t[1] AS INTEGER) IS NOT NULL)"""

SENTINEL_SQL = f"""{INDEX_LINES_SQL},
sv AS (SELECT * FROM (VALUES ('AMO', -99.99), ('ONI', -99.9), ('SOI', -99.99), ('PDO', -9.9), ('NAO', -99.9))
       s(index_name, invalid)),
clean AS (SELECT p.index_name, p.Data, CASE WHEN sv.invalid IS NULL OR p.value <> sv.invalid THEN p.value END AS value
          FROM parsed p LEFT JOIN sv USING (index_name))"""


def parsed_indices(spark, base):
    lines = S.index_text_lines(spark, base).withColumnRenamed("index_name", "index")
    return IT.parse_wide_lines(lines)


def clean_indices(spark, base):
    return IT.null_sentinels(parsed_indices(spark, base))


# --- SRC-4, RSH-1, STR-1 ----------------------------------------------------
@query("index_text_parse", sql=f"WITH {INDEX_LINES_SQL} SELECT index_name, Data, {R('value')} AS value FROM parsed")
def index_text_parse(spark, base):
    p = parsed_indices(spark, base)
    return p.select(F.col("index").alias("index_name"), "Data", rnd("value").alias("value"))


# --- SRC-5 ------------------------------------------------------------------
@query("index_semicolon_parse", sql=f"""
WITH {GEN_CTE},
gm AS (SELECT {_IDX_CASE} AS index_name, year(ts) AS y, month(ts) AS m, ROUND(SUM(value), 2) AS v
       FROM gen GROUP BY ALL),
rows AS (SELECT index_name, 'idx' || strftime(make_date(y, m, 1), '%d%b%Y') AS date_text,
                printf('%.2f', v) AS value_text FROM gm)
SELECT index_name, CAST(date_trunc('month', strptime(substr(trim(date_text), 4), '%d%b%Y')) AS DATE) AS Data,
       {R('TRY_CAST(trim(value_text) AS DOUBLE)')} AS value
FROM rows""")
def index_semicolon_parse(spark, base):
    rows = S.index_semicolon_rows(spark, base)
    p = IT.parse_semicolon_rows(rows, "index_name", "date_text", "value_text")
    return p.select(F.col("index").alias("index_name"), "Data", rnd("value").alias("value"))


# --- NUL-1 ------------------------------------------------------------------
@query("sentinel_null", sql=f"""
WITH {SENTINEL_SQL}
SELECT index_name, Data, {R('value')} AS value FROM clean""")
def sentinel_null(spark, base):
    c = clean_indices(spark, base)
    return c.select(F.col("index").alias("index_name"), "Data", rnd("value").alias("value"))


# --- JOI-1, DAT-2 -----------------------------------------------------------
@query("index_merge", sql=f"""
WITH {SENTINEL_SQL}
SELECT strftime(Data, '%Y-%m') AS Data,
  {', '.join(f"{R(f'MAX(value) FILTER (WHERE index_name = {chr(39)}{i}{chr(39)})')} AS {i}" for i in INDICES)}
FROM clean GROUP BY 1""")
def index_merge(spark, base):
    m = IT.merge_indices(clean_indices(spark, base), INDICES)
    return m.select("Data", *[rnd(i).alias(i) for i in INDICES])


# --- grid ---------------------------------------------------------------------
def grid(spark, base):
    return REG.grid_from_arrays(S.grid_arrays(spark, base), "Data", "values", S.GRID_LATS, S.GRID_LONS)


_LATS = "[" + ", ".join(str(x) for x in S.GRID_LATS) + "]"
_LONS = "[" + ", ".join(str(x) for x in S.GRID_LONS) + "]"
def grid_sql(p: str = "") -> str:
    """Grid stand-in in SQL; every CTE name is prefixed with ``p``."""
    return f"""
{p}g0 AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings),
{p}g AS (SELECT CAST(DATE '{S.GRID_START}' + CAST(vec_id AS INTEGER) AS DATE) AS Data,
             CAST({_LATS} AS DOUBLE[])[((p - 1) // 8) + 1] AS lat,
             CAST({_LONS} AS DOUBLE[])[((p - 1) % 8) + 1] AS lon_raw,
             CASE WHEN isnan(CAST(v AS DOUBLE)) THEN NULL ELSE CAST(v AS DOUBLE) END AS value FROM {p}g0),
{p}gw AS (SELECT *, (((lon_raw + 180.0) % 360.0 + 360.0) % 360.0) - 180.0 AS lon FROM {p}g),
{p}reg AS (SELECT * FROM (VALUES ('NIN 1.2', 0, -90, -10, -80, 'NIN 1.2'), ('NIN 3', 5, -150, -5, -90, 'NIN 3'),
          ('NIN 3.4', 5, -170, -5, -120, 'NIN 3.4'), ('NIN 4_1', 5, 160, -5, 180, 'NIN 4'),
          ('NIN 4_2', 5, -180, -5, -150, 'NIN 4')) r(region, north, west, south, east, parent)),
{p}cells AS (SELECT {p}gw.*, {p}reg.region, {p}reg.parent FROM {p}gw JOIN {p}reg
          ON {p}gw.lat BETWEEN {p}reg.south AND {p}reg.north AND {p}gw.lon BETWEEN {p}reg.west AND {p}reg.east)"""


GRID_SQL = grid_sql()


# --- GEO-1, AGG-12, FLT-4, JOI-8, ARR-1 -------------------------------------
@query("region_mean", sql=f"WITH {GRID_SQL} SELECT Data, region, {R('AVG(value)', 6)} AS value FROM cells GROUP BY ALL")
def region_mean(spark, base):
    r = REG.region_stat(grid(spark, base), regions_df(spark), "mean")
    return r.select("Data", "region", rnd("value", 6).alias("value"))


# --- GEO-2, AGG-13 ----------------------------------------------------------
@query("region_median", sql=f"WITH {GRID_SQL} SELECT Data, region, {R('MEDIAN(value)', 6)} AS value FROM cells GROUP BY ALL")
def region_median(spark, base):
    r = REG.region_stat(grid(spark, base), regions_df(spark), "median")
    return r.select("Data", "region", rnd("value", 6).alias("value"))


# --- JOI-8, FLT-4 (many boxes) ------------------------------------------------
# One box per customer, about its number; every seventh crosses the date line.
_BOX = ["CAST(c_custkey % 150 - 75 AS DOUBLE) AS south", "CAST(c_custkey % 150 - 75 + c_custkey % 11 AS DOUBLE) AS north",
        "CAST((c_custkey * 37) % 340 - 170 AS DOUBLE) AS west",
        "CAST((c_custkey * 37) % 340 - 170 + CASE WHEN c_custkey % 7 = 0 THEN -20 ELSE c_custkey % 10 END AS DOUBLE) AS east"]


@query("many_regions", sql=f"""
WITH {GRID_SQL},
boxes AS (SELECT c_custkey AS region, {", ".join(_BOX)} FROM customer),
cell AS (SELECT lat, lon, COUNT(value) AS n, SUM(value) AS s FROM gw GROUP BY ALL)
SELECT region, CAST(SUM(n) AS BIGINT) AS n, {R('SUM(s) / SUM(n)', 6)} AS value FROM cell JOIN boxes
  ON lat BETWEEN south AND north AND CASE WHEN west <= east THEN lon BETWEEN west AND east ELSE lon >= west OR lon <= east END
GROUP BY region""")
def many_regions(spark, base):
    """Mean of all cells in each of many boxes (one per customer)."""
    boxes = S.read_table(spark, base, "customer").selectExpr("c_custkey AS region", *_BOX)
    cells = (REG.wrap_longitudes(grid(spark, base)).groupBy("lat", "lon")
             .agg(F.count("value").alias("n"), F.sum("value").alias("s")))
    found = REG.cells_in_regions(cells, boxes)
    return found.groupBy("region").agg(F.sum("n").alias("n"), rnd(F.sum("s") / F.sum("n"), 6).alias("value"))


# --- MTH-1, RSH-5 -----------------------------------------------------------
@query("lon_wrap", sql=f"""WITH {GRID_SQL}
SELECT lat, lon_raw, lon, COUNT(*) AS n, {R('AVG(value)', 6)} AS mean_value FROM gw GROUP BY ALL""")
def lon_wrap_q(spark, base):
    g = REG.wrap_longitudes(grid(spark, base).withColumnRenamed("lon", "lon_raw"), "lon_raw", "lon")
    return g.groupBy("lat", "lon_raw", "lon").agg(F.count("*").alias("n"), rnd(F.avg("value"), 6).alias("mean_value"))


# --- GEO-3 ------------------------------------------------------------------
@query("dateline_region", sql=f"""WITH {GRID_SQL}
SELECT Data, parent AS region, {R('AVG(value)', 6)} AS value, COUNT(*) AS n_cells
FROM cells WHERE parent = 'NIN 4' GROUP BY ALL""")
def dateline_region(spark, base):
    g = REG.wrap_longitudes(grid(spark, base))
    cells = REG.cells_in_regions(g, regions_df(spark)).where(F.col("parent") == "NIN 4")
    return cells.groupBy("Data", F.col("parent").alias("region")).agg(
        rnd(F.avg("value"), 6).alias("value"), F.count("*").alias("n_cells"))


# --- PIP-5, GEO-1 wide ----------------------------------------------------------
BOXES = list(ENSO_REGIONS)


def region_table(spark, base, variable="sea_surface_temperature", stat="mean"):
    """One column per box; both halves of the box at the date line are kept."""
    from ..sources.grid import variable_label
    series = REG.region_stat(grid(spark, base), regions_df(spark), stat)
    return REG.region_wide(series, variable_label(variable), regions=BOXES)


def _region_table_sql(stat):
    cols = ", ".join(f'{R(f"MAX(v) FILTER (WHERE region = {chr(39)}{r}{chr(39)})", 6)} AS "{r}_sst"' for r in BOXES)
    return f"""WITH {GRID_SQL}, m AS (SELECT Data, region, {stat}(value) AS v FROM cells GROUP BY ALL)
SELECT Data, {cols} FROM m GROUP BY Data"""


def _region_table_rows(spark, base, stat):
    w = region_table(spark, base, stat=stat)
    return w.select("Data", *[rnd(F.col(f"`{c}`"), 6).alias(c) for c in w.columns if c != "Data"])


@query("region_table", sql=_region_table_sql("AVG"))
def region_table_q(spark, base):
    return _region_table_rows(spark, base, "mean")


@query("region_table_median", sql=_region_table_sql("MEDIAN"))
def region_table_median(spark, base):
    return _region_table_rows(spark, base, "median")

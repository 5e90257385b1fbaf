"""Small dimension tables defined as literals.

Every table here has a size fixed by this file, so broadcasting it is always
safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------------------
# Fixed values (must equal the studied project's for the same results).
# ---------------------------------------------------------------------------

# Fuel type -> plant class. Fuels not listed keep their own name.
FUEL_CLASS = {
    "Gás": "Térmica",
    "Carvão": "Térmica",
    "Óleo Combustível": "Térmica",
    "Nuclear": "Térmica",
    "Óleo Diesel": "Térmica",
    "Multi-Combustível Diesel/Óleo": "Térmica",
    "Outras Multi-Combustível": "Outras",
    "Resíduos Industriais": "Outras",
    "Biomassa": "Outras",
}

# Climate index -> value that marks a missing month in its text file.
INDEX_SENTINEL = {
    "AAO": -9999.0,
    "AMM": -99.0,
    "AMO": -99.990,
    "AO": -999.0,
    "BEST": -9.99,
    "CAR": -99.99,
    "EA": -99.9,
    "EPNP": -99.9,
    "ESPI": -999.0,
    "GMSST": 9999.0,
    "IOD": -9999.0,
    "MEI": -999.0,
    "MEI V2": -999.0,
    "NAO": -99.9,
    "NIN1+2": -99.99,
    "NIN3": -99.99,
    "NIN3.4": -99.99,
    "NIN4": -99.99,
    "NTA": -99.99,
    "NOI": -999.0,
    "ONI": -99.9,
    "PACWARM": -9999.0,
    "PDO": -9.9,
    "PNA": -99.9,
    "PWR": -9999.0,
    "QBO": -999.0,
    "SOI": -99.99,
    "TNA": -99.99,
    "TNI": -99.99,
    "TSA": -99.99,
    "WHWP": -99.99,
    "WP": -99.9,
}

# Ocean boxes as [north, west, south, east] in degrees (-180..180 longitudes).
# Niño 4 crosses the date line and is stored as two halves.
ENSO_REGIONS = {
    "NIN 1.2": [0, -90, -10, -80],
    "NIN 3": [5, -150, -5, -90],
    "NIN 3.4": [5, -170, -5, -120],
    "NIN 4_1": [5, 160, -5, 180],
    "NIN 4_2": [5, -180, -5, -150],
}

# Brazilian boxes kept alongside (same operator, more rows).
BRAZIL_REGIONS = {
    "NE": [-2, -45, -18, -34],
    "N": [5, -74, -14, -45],
    "C.O.": [-14, -60, -24, -45],
    "SE": [-18, -50, -25, -39],
    "S": [-24, -56, -33, -48],
}

# Gridded variable name -> short name used in column labels.
GRID_VARIABLES = {
    "sea_surface_temperature": "sst",
    "2m_temperature": "t2m",
    "total_precipitation": "tp",
}

# ENSO phase names, from the coldest to the warmest tick.
ENSO_PHASES = ["La Niña forte", "La Niña médio", "Neutralidade", "El Niño médio", "El Niño forte"]

# Daily rows replaced by another day's row in the generation tables.
GENERATION_PATCHES = [("2013-12-01", "2013-12-02")]

# The 14 reservoir measures of the hydrology files.
HYDROLOGY_MEASURES = [
    "val_nivelmontante", "val_niveljusante", "val_volumeutilcon", "val_vazaoafluente",
    "val_vazaoturbinada", "val_vazaovertida", "val_vazaooutrasestruturas", "val_vazaodefluente",
    "val_vazaotransferida", "val_vazaonatural", "val_vazaoartificial", "val_vazaoincremental",
    "val_vazaoevaporacaoliquida", "val_vazaousoconsuntivo",
]

# ---------------------------------------------------------------------------


def parent_region(name: str) -> str:
    """``NIN 4_1`` / ``NIN 4_2`` -> ``NIN 4``; other names unchanged."""
    base, _, tail = name.rpartition("_")
    return base if base and tail.isdigit() else name


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(float(v)) if isinstance(v, float) else str(v)


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small literal table as an inline ``VALUES`` relation: the planner
    knows its exact size (a LocalRelation), so it is broadcast without any
    job to measure it."""
    cols = [c.strip().split(" ", 1) for c in schema.split(",")]
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    names = ", ".join(f"`{n}`" for n, _ in cols)
    casts = ", ".join(f"CAST(`{n}` AS {t}) AS `{n}`" for n, t in cols)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def regions_df(spark: SparkSession, regions: dict | None = None) -> DataFrame:
    regions = ENSO_REGIONS if regions is None else regions
    rows = [(k, float(v[0]), float(v[1]), float(v[2]), float(v[3]), parent_region(k))
            for k, v in regions.items()]
    return literal_table(spark, rows, "region string, north double, west double, south double, east double, "
                                      "parent string")


def sentinels_df(spark: SparkSession, sentinels: dict | None = None) -> DataFrame:
    sentinels = INDEX_SENTINEL if sentinels is None else sentinels
    return literal_table(spark, [(k, float(v)) for k, v in sentinels.items()], "index string, invalid double")


def mapping_df(spark: SparkSession, mapping: dict, key: str = "key", value: str = "mapped") -> DataFrame:
    return literal_table(spark, list(mapping.items()), f"{key} string, {value} string")


def patches_df(spark: SparkSession, patches=None) -> DataFrame:
    patches = GENERATION_PATCHES if patches is None else patches
    return literal_table(spark, patches, "target_date string, source_date string").selectExpr(
        "to_date(target_date) AS target_date", "to_date(source_date) AS source_date")

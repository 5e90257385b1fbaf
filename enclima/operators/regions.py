"""Gridded fields reduced to regional series (GEO-1..3, FLT-4, JOI-8, AGG-12,
AGG-13, MTH-1, ARR-1, RSH-5, SRC-8 read shape).

Model: long ``(Data, lat, lon, value)``. Dense grids arriving as one array per
date are flattened with ``posexplode`` and index arithmetic (lat-major).

A handful of boxes is an array literal tested per cell, without a join; many
boxes are joined through an index of tiles. Aggregation per (date, region) is a
hash aggregate; the exact median keeps the values of one (date, region) group
together, which is bounded by the number of grid cells inside the box, not by
the data volume (``quantile.exact_quantiles`` is for groups without a bound).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lon_wrap
from ..functions.nulls import nan_to_null


def grid_from_arrays(df: DataFrame, date: str, values: str, lats: Sequence[float],
                     lons: Sequence[float]) -> DataFrame:
    """``(date, ARRAY<value>)`` with ``len(lats) * len(lons)`` lat-major cells ->
    ``(Data, lat, lon, value)``. NaN cells become NULL."""
    nlon = len(lons)
    lat_arr = F.array(*[F.lit(float(x)) for x in lats])
    lon_arr = F.array(*[F.lit(float(x)) for x in lons])
    e = df.select(F.col(date).alias("Data"), F.posexplode(values).alias("_p", "_v"))
    return e.select(
        "Data",
        F.element_at(lat_arr, (F.floor(F.col("_p") / nlon) + 1).cast("int")).alias("lat"),
        F.element_at(lon_arr, (F.pmod(F.col("_p"), F.lit(nlon)) + 1).cast("int")).alias("lon"),
        nan_to_null(F.col("_v").cast("double")).alias("value"))


def wrap_longitudes(df: DataFrame, lon: str = "lon", out: str = "lon") -> DataFrame:
    """0..360 -> -180..180 (MTH-1)."""
    return df.withColumn(out, lon_wrap(F.col(lon)))


#: Boxes up to which they are an array literal tested per cell.
FEW_BOXES = 64
#: Side of an index tile in degrees.
TILE = 5.0


def _inside(lat: Column, lon: Column, box) -> Column:
    """Inclusive bounds; a box with west > east crosses the date line."""
    west, east = box("west"), box("east")
    return ((lat >= box("south")) & (lat <= box("north"))
            & F.when(west <= east, (lon >= west) & (lon <= east)).otherwise((lon >= west) | (lon <= east)))


def _tiled(boxes: DataFrame, tile: float) -> DataFrame:
    """One row per box and tile that it covers: adds _ty, _tx."""
    def span(lo, hi):
        return F.sequence(F.floor(lo / tile), F.floor(hi / tile))

    west, east = F.col("_box.west"), F.col("_box.east")
    lons = F.when(west <= east, span(west, east)).otherwise(F.array_union(span(west, F.lit(180.0)), span(F.lit(-180.0), east)))
    return (boxes.where("_box.south <= _box.north").withColumn("_tx", F.explode(lons))
            .withColumn("_ty", F.explode(span(F.col("_box.south"), F.col("_box.north")))))


def cells_in_regions(grid: DataFrame, regions: DataFrame, lat: str = "lat", lon: str = "lon",
                     few: int = FEW_BOXES, tile: float = TILE) -> DataFrame:
    """Every (cell, region) whose box holds the cell, inclusive bounds (FLT-4).

    Up to ``few`` boxes become one array literal that is filtered per cell, so
    there is no join at all. More boxes are spread to the tiles they cover and
    equi-joined with the cells on the tile, the exact test behind it; nothing
    of them is collected. The join is by sorted shuffle: the planner's estimate
    of the tiles is that of the unspread boxes, so left to itself it would
    gather the spread ones for a broadcast. Longitudes of cells and boxes lie in [-180, 180]; a
    box with west > east crosses the date line."""
    names = [c for c in regions.columns if c not in ("north", "south", "west", "east")]
    boxes = regions.limit(few + 1).collect()
    kept = [F.col(f"`{c}`") for c in grid.columns]
    if not boxes:
        return grid.withColumns({c: F.lit(None).cast(regions.schema[c].dataType) for c in names}).where(F.lit(False))
    if len(boxes) <= few:
        literal = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in regions.columns]) for r in boxes])
        held = F.filter(literal, lambda b: _inside(F.col(lat), F.col(lon), lambda c: b[c]))
        cells = grid.withColumn("_box", F.explode(held))
    else:
        tiles = _tiled(regions.select(F.struct(*[F.col(f"`{c}`") for c in regions.columns]).alias("_box")), tile).hint("merge")
        cells = (grid.withColumns({"_ty": F.floor(F.col(lat) / tile), "_tx": F.floor(F.col(lon) / tile)})
                 .join(tiles, ["_ty", "_tx"]).where(_inside(F.col(lat), F.col(lon), lambda c: F.col(f"_box.{c}"))))
    return cells.select(*kept, *[F.col(f"_box.{c}").alias(c) for c in names])


def region_stat(grid: DataFrame, regions: DataFrame, stat: str = "mean", by: str = "region",
                date: str = "Data", wrap: bool = True) -> DataFrame:
    """Per (date, region) mean (GEO-1, unweighted, NULL cells skipped) or exact
    median (GEO-2). ``by='parent'`` merges split boxes (GEO-3)."""
    g = wrap_longitudes(grid) if wrap else grid
    cells = cells_in_regions(g, regions)
    # by='parent': the halves of a split box are disjoint after wrapping
    # (wrapped longitudes lie in [-180, 180)), so no cell is counted twice.
    agg = {"mean": F.avg("value"), "median": F.median("value")}[stat]
    return cells.groupBy(date, F.col(by).alias("region")).agg(agg.alias("value"))


def region_wide(series: DataFrame, var: str, date: str = "Data", regions: Sequence[str] | None = None) -> DataFrame:
    """Wide ``{region}_{var}`` columns (one per region)."""
    from .reshape import distinct_values, pivot_masks
    regions = distinct_values(series, "region") if regions is None else list(regions)
    masks = {f"{r}_{var}": F.col("region") == F.lit(r) for r in regions}
    return pivot_masks(series, [date], masks, "value", how="first")

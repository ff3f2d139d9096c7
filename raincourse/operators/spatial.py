"""Joins on place: grid snapping, radius, box and pair distance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raincourse.session import sized

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    dphi, dlam = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = (F.pow(F.sin(dphi / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlam / 2), 2))
    return 2 * EARTH_RADIUS_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def nearest_index(coord: Column, start: float, step: float, size: int) -> Column:
    """Index of the nearest node of a regular axis, clipped to the axis."""
    i = F.round((coord - start) / step)
    return F.least(F.greatest(i, F.lit(0)), F.lit(size - 1)).cast("int")


def ceiling_index(coord: Column, start: float, step: float, size: int) -> Column:
    """Index of the first axis node not below ``coord``, clipped to the axis."""
    i = F.ceil(F.round((coord - start) / step, 9))
    return F.least(F.greatest(i, F.lit(0)), F.lit(size - 1)).cast("int")


BLOCK = 8192  # rows of the left side that meet their neighbours in one group


def deal(left: DataFrame, right: DataFrame, keys: list[str], most: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Both sides by ``keys`` and ``_part``, spread over all shuffle partitions.

    The left rows of a key are dealt to parts of about ``most`` rows, the right rows are copied to each
    part of their key, so a crowded place is the work of many tasks. The stated number of partitions
    is not coalesced: these groups hold few bytes but much arithmetic. Left rows without a key go.
    """
    parts = sized(left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")), "parts")
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.join(parts, keys).withColumn("_part", F.pmod(F.xxhash64(*left.columns), F.col("_parts")).cast("int")).drop("_parts")
    copied = right.join(parts, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return dealt.repartition(n, *keys, "_part"), copied.repartition(n, *keys, "_part")


def _unit(lat: str, lon: str, out: str) -> dict[str, Column]:
    """Coordinates of a place on the unit sphere."""
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lon))
    return {f"{out}x": F.cos(phi) * F.cos(lam), f"{out}y": F.cos(phi) * F.sin(lam), f"{out}z": F.sin(phi)}


def radius_join(left: DataFrame, right: DataFrame, radius_km: float, max_abs_lat: float | None = None,
                lat: str = "lat", lon: str = "lon", r_lat: str = "g_lat", r_lon: str = "g_lon",
                on: list[str] | None = None, tile_km: float | None = None) -> DataFrame:
    """All pairs within ``radius_km``, with ``distance_km``.

    Both sides are cut into tiles of ``tile_km`` (default half the radius). The right
    side is copied into each tile its circle touches, so the join is an equi-join
    on tile and no pair is missed or doubled. Longitude tiles are widened for the
    highest latitude of both sides, a scalar of the data unless ``max_abs_lat``
    names a bound. Crowded tiles are dealt to several tasks. Longitudes
    run from -180 to 180; a circle that crosses 180 degrees also touches the tiles
    on the other side, and one that holds a pole touches all longitudes.

    A pair is told near by the cosine of its angle; the distance itself decides only where the
    cosine is within rounding of the limit.
    """
    tile = tile_km or radius_km / 2
    dlat = tile / KM_PER_DEGREE
    reach_lat = radius_km / KM_PER_DEGREE * 1.000001
    if max_abs_lat is None:
        highest = F.greatest(left.agg(F.max(F.abs(F.col(lat)))).scalar(), right.agg(F.max(F.abs(F.col(r_lat)))).scalar())
    else:
        highest = F.lit(float(max_abs_lat))
    # A circle around latitude L spans at most reach / cos(L + reach) degrees of longitude to each side.
    top = highest + reach_lat
    reach_lon = F.when(top < 89, F.least(reach_lat / F.cos(F.radians(top)), F.lit(180.0))).otherwise(180.0)
    dlon = dlat / F.cos(F.radians(F.least(top, F.lit(89.0))))

    def tile_of(c: Column, d: float | Column) -> Column:
        return F.floor(c / d).cast("int")

    def reached(lon_: Column) -> Column:
        return F.sequence(tile_of(lon_ - reach_lon, dlon), tile_of(lon_ + reach_lon, dlon))

    none = F.array().cast("array<int>")
    over = F.concat(reached(F.col(r_lon)),
                    F.when(F.col(r_lon) - reach_lon < -180, reached(F.col(r_lon) + 360)).otherwise(none),
                    F.when(F.col(r_lon) + reach_lon > 180, reached(F.col(r_lon) - 360)).otherwise(none))
    a = left.withColumns({"_ti": tile_of(F.col(lat), dlat), "_tj": tile_of(F.col(lon), dlon)})
    b = (right
         .withColumn("_ti", F.explode(F.sequence(tile_of(F.col(r_lat) - reach_lat, dlat),
                                                 tile_of(F.col(r_lat) + reach_lat, dlat))))
         .withColumn("_tj", F.explode(F.array_distinct(over))))
    keys = [*(on or []), "_ti", "_tj"]
    a, b = deal(a, b, keys)
    a, b = a.withColumns(_unit(lat, lon, "_a")), b.withColumns(_unit(r_lat, r_lon, "_b"))
    distance = haversine_km(F.col(lat), F.col(lon), F.col(r_lat), F.col(r_lon))
    cosine = sum((F.col(f"_a{x}") * F.col(f"_b{x}") for x in "yz"), F.col("_ax") * F.col("_bx"))
    limit = math.cos(min(radius_km / EARTH_RADIUS_KM, math.pi))
    near = (cosine >= limit - 1e-12) & (cosine < 2) & ((cosine > limit + 1e-12) | (distance <= radius_km))
    # A tile's right rows are one array, read in a row for each left row; hashed, so copies are not sent to every task.
    others = [x for x in b.columns if x not in (*keys, "_part")]
    lists = b.groupBy(*keys, "_part").agg(F.collect_list(F.struct(*others)).alias("_near"))
    return (a.join(lists.hint("shuffle_hash"), [*keys, "_part"]).select(*a.columns, F.inline("_near")).where(near)
            .drop("_ti", "_tj", "_part", *_unit(lat, lon, "_a"), *_unit(r_lat, r_lon, "_b")).withColumn("distance_km", distance))


def box_join(points: DataFrame, boxes: DataFrame, lat: str = "lat", lon: str = "lon",
             tile_deg: float = 1.0) -> DataFrame:
    """Points inside boxes (lat_min, lat_max, lon_min, lon_max), by equi-join on degree tiles."""
    def tile(c: str) -> Column:
        return F.floor(F.col(c) / tile_deg).cast("int")

    p = points.withColumns({"_ti": tile(lat), "_tj": tile(lon)})
    b = (boxes.withColumn("_ti", F.explode(F.sequence(tile("lat_min"), tile("lat_max"))))
         .withColumn("_tj", F.explode(F.sequence(tile("lon_min"), tile("lon_max")))))
    return (p.join(b, ["_ti", "_tj"])
            .filter(F.col(lat).between(F.col("lat_min"), F.col("lat_max"))
                    & F.col(lon).between(F.col("lon_min"), F.col("lon_max")))
            .drop("_ti", "_tj"))


LEVELS = 20


def _cell(lat: Column, lon: Column, level: Column | int) -> Column:
    """Key of the quadtree cell of a point: cells of level 0 are 360 degrees wide, each level halves them."""
    level = F.lit(level) if isinstance(level, int) else level
    width = 360.0 / F.pow(F.lit(2.0), level)
    return F.xxhash64(level.cast("int"), F.floor((lon + 180.0) / width), F.floor((lat + 90.0) / width))


def footprint_cells(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Keys of the at most four cells that cover a box, of the deepest level whose cells are no smaller than the box."""
    wide = F.greatest(east - west, north - south, F.lit(360.0 / 2 ** LEVELS))
    level = F.greatest(F.least(F.floor(F.log2(360.0 / wide)), F.lit(LEVELS)), F.lit(0))
    return F.array_distinct(F.array(*[_cell(lat, lon, level) for lat in (south, north) for lon in (west, east)]))


def ancestor_cells(lat: Column, lon: Column) -> Column:
    """Keys of the cells of all levels that hold a point."""
    return F.array(*[_cell(lat, lon, level) for level in range(LEVELS + 1)])


def boxes_at_points(boxes: DataFrame, points: DataFrame, box: tuple[str, str, str, str] = ("west", "south", "east", "north")) -> DataFrame:
    """Rows of ``boxes`` with each row of ``points`` (lat, lon) that they hold, by an equi-join on quadtree cells.

    A box of any size has at most four cells, a point one of each level. Boxes do not cross 180 degrees.
    """
    west, south, east, north = map(F.col, box)
    left = boxes.withColumn("_cell", F.explode(footprint_cells(west, south, east, north)))
    right = points.withColumn("_cell", F.explode(ancestor_cells(F.col("lat"), F.col("lon"))))
    return left.join(right, "_cell").where(F.col("lon").between(west, east) & F.col("lat").between(south, north)).drop("_cell")

"""Writers and text builders for results that leave as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KM_PER_DEGREE = 111.0


def _ring(west: Column, east: Column, south: Column, north: Column) -> Column:
    corners = [(west, south), (east, south), (east, north), (west, north), (west, south)]
    return F.array(F.array(*[F.array(x, y) for x, y in corners]))


def feature_json(coordinates: Column, properties: dict[str, Column]) -> Column:
    """One GeoJSON polygon feature as text."""
    return F.to_json(F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Polygon").alias("type"), coordinates.alias("coordinates")).alias("geometry"),
        F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")))


def flood_polygon_json(lon: Column, lat: Column, width_m: Column, length_km: Column,
                       properties: dict[str, Column]) -> Column:
    """Box of the flood width and length around a point."""
    w = width_m / 1000.0 / KM_PER_DEGREE / 2
    h = length_km / KM_PER_DEGREE / 2
    return feature_json(_ring(lon - w, lon + w, lat - h, lat + h), properties)


def wet_cell_json(lon: Column, lat: Column, half_deg: float, properties: dict[str, Column]) -> Column:
    """Square of one grid cell."""
    return feature_json(_ring(lon - half_deg, lon + half_deg, lat - half_deg, lat + half_deg), properties)


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append-only queue of JSON lines."""
    alerts.write.mode("append").json(path)


def stream_alerts(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (alerts.writeStream.format("json").option("path", path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def write_latest(current: DataFrame, path: str) -> None:
    """Replace the current state as a whole."""
    current.write.mode("overwrite").parquet(path)


def write_text(lines: DataFrame, column: str, path: str) -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def merged_rows(existing: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Existing rows with those of the same key replaced; the newest update of a key wins."""
    newest = (updates.groupBy(*keys).agg(F.max_by(F.struct(*updates.columns), order).alias("_u"))
              .select("_u.*"))
    return existing.join(newest.select(*keys), keys, "left_anti").unionByName(newest)


def upsert_partitions(spark, path: str, updates: DataFrame, partition: str, keys: list[str],
                      order: str) -> None:
    """Merge ``updates`` into the partitions they touch and overwrite only those.

    The merged rows are written to a new folder beside the table first, so the
    table is never read and overwritten in one job.
    """
    touched = updates.select(partition).distinct()
    existing = spark.read.parquet(path).join(touched, partition, "left_semi")
    merged = merged_rows(existing.select(*updates.columns), updates, keys, order)
    from raincourse.session import cut_lineage

    (cut_lineage(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))

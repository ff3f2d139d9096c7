"""Readers: files, feeds and tables as typed DataFrames; bad input is kept apart, not lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raincourse.session import sized
from raincourse.sources.schemas import DEFAULTS, TABLES

CORRUPT = "_corrupt_record"


def json_documents(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parsed documents and unreadable ones (as text).

    Lines are parsed by ``from_json`` so that pruned reads still see bad input.
    """
    if multi_line:
        full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        rows = spark.read.schema(full).option("multiLine", True).json(path)
        return rows.filter(F.col(CORRUPT).isNull()).drop(CORRUPT), rows.filter(F.col(CORRUPT).isNotNull()).select(CORRUPT)
    return parse_json(spark.read.text(path), "value", schema)


def parse_json(rows: DataFrame, column: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Split JSON text into typed rows and text that does not parse."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = rows.withColumn("_j", F.from_json(column, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col("_j").isNull() | F.col(f"_j.{CORRUPT}").isNotNull()
    good = parsed.filter(~bad).select(*[F.col(f"_j.{f.name}").alias(f.name) for f in schema.fields])
    return good, parsed.filter(bad).select(F.col(column).alias("text"))


def keyed_map(rows: DataFrame, column: str, value_type: str, key: str) -> DataFrame:
    """A JSON object keyed by entity -> one row per entity."""
    m = F.from_json(column, f"map<string,{value_type}>")
    return rows.select(F.explode(m).alias(key, "_v")).select(key, "_v.*")


def gauge_csv(spark: SparkSession, path: str) -> DataFrame:
    """Gauge rows of CSV files; rows with a broken number are dropped, negative rain becomes zero.

    Fields are read as text and cast with ``try_cast``: the reader's own check of
    malformed rows skips columns a query does not read.
    """
    raw = spark.read.csv(path, header=True, schema="station_id string, lat string, lon string, precip_mm_30min string")
    num = {n: F.col(n).try_cast("double") for n in ("lat", "lon", "precip_mm_30min")}
    ok = F.col("station_id").isNotNull()
    for e in num.values():
        ok = ok & e.isNotNull()
    return raw.filter(ok).select("station_id", num["lat"].alias("lat"), num["lon"].alias("lon"),
                                 F.greatest(num["precip_mm_30min"], F.lit(0.0)).alias("precip_mm"))


def moisture_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily moisture CSV -> rain sum and mean moisture per region and month."""
    raw = spark.read.csv(path, header=True, schema="region string, day date, precip_mm double, theta double")
    return raw.groupBy("region", F.trunc("day", "month").alias("month")).agg(F.sum("precip_mm").alias("precip_mm"), F.avg("theta").alias("theta"))


def feature_parquet(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files under a folder, columns merged by name."""
    return spark.read.option("mergeSchema", True).parquet(path)


def grid_table(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Long grid table partitioned by date; only the dates asked for are listed and read."""
    return spark.read.parquet(path).filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def table_rows(df: DataFrame, table: str) -> DataFrame:
    """Rows in the declared types of a relational table: defaults for missing values, one row per unique key."""
    schema, key = TABLES[table]

    def typed(f: T.StructField) -> Column:
        e = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        return (F.coalesce(e, F.lit(DEFAULTS[f.name])) if f.name in DEFAULTS else e).alias(f.name)

    rows = df.select(*[typed(f) for f in schema])
    needed = [f.name for f in schema if not f.nullable]
    return rows.dropna(subset=needed).dropDuplicates(key)


def read_database(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table over JDBC; pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


FEED_ITEM = "station_id string, station_name string, lat string, lon string, temperature string, humidity string, rainfall string, datetime string"


def station_feed(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``data[]`` of a feed as typed rows; missing numbers are 0, bad numbers go to rejects."""
    item = rows.select(F.explode(F.from_json(column, f"data array<struct<{FEED_ITEM.replace(' string', ':string')}>>")["data"]).alias("d")).select("d.*")
    lat, lon = F.coalesce("lat", F.lit("0")).try_cast("double"), F.coalesce("lon", F.lit("0")).try_cast("double")
    bad = lat.isNull() | lon.isNull()
    good = item.filter(~bad).select(F.coalesce("station_id", F.lit("")).alias("station_id"), lat.alias("lat"), lon.alias("lon"),
                                    F.col("temperature").try_cast("double").alias("temperature_c"), F.col("humidity").try_cast("double").alias("humidity_pct"),
                                    F.col("rainfall").try_cast("double").alias("rainfall_mm"))
    return good, item.filter(bad)


ENTRY = "id:string,time_start:string,granule_size:double,cloud_cover:double,links:array<struct<rel:string,href:string>>"
DATA_LINK = "http://esipfed.org/ns/fedsearch/1.1/data#"  # Fixed value: relation of a data link in the catalogue.


def granule_feed(rows: DataFrame, column: str) -> DataFrame:
    """Catalogue entries with their first data link and rounded size."""
    e = rows.select(F.explode(F.from_json(column, f"feed struct<entry:array<struct<{ENTRY}>>>")["feed"]["entry"]).alias("e")).select("e.*")
    url = F.get(F.filter("links", lambda x: x.rel == DATA_LINK), F.lit(0))["href"]
    return e.select("id", F.coalesce("time_start", F.lit("2000-01-01T00:00:00Z")).cast("timestamp").alias("time_start"),
                    F.coalesce(url, F.lit("")).alias("url"), F.round(F.coalesce("granule_size", F.lit(0.0)), 2).alias("size_mb"), "cloud_cover")


def index_text(spark: SparkSession, path: str, keys: list[str], n: int) -> DataFrame:
    """Climate index text (key.. year month .. value): header and bad rows skipped, newest n months per key."""
    part = F.split(F.trim("value"), r"\s+")
    k = len(keys)
    t = spark.read.text(path).select(*[F.get(part, F.lit(i)).alias(n_) for i, n_ in enumerate(keys)],
                                     F.get(part, F.lit(k)).try_cast("int").alias("year"), F.get(part, F.lit(k + 1)).try_cast("int").alias("month"),
                                     F.element_at(part, -1).try_cast("double").alias("index_value"))
    t = t.dropna(subset=["year", "month", "index_value"])
    newest = Window.partitionBy(*keys).orderBy(F.desc("year"), F.desc("month"), F.desc("index_value"))
    return t.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= n).select(*keys, "year", "month", "index_value")


def rain_quality(value: Column) -> Column:
    """2 missing or out of range, 1 suspect, 0 good."""
    return F.when((value < 0) | (value > 200), 2).when(value > 100, 1).otherwise(0)


def newest_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(entity, stamp, path): of each entity the newest file below ``folder``, found by listing and without reading any.

    ``pattern`` gives entity and stamp from a path in two groups; files that do not match are left
    out. Equal stamps go by the time of change, then by name.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    found = listed.select("path", "modificationTime", F.regexp_extract("path", pattern, 1).alias("entity"), F.regexp_extract("path", pattern, 2).alias("stamp")).where("entity != ''")
    best = F.max_by(F.struct("stamp", "path"), F.struct("stamp", "modificationTime", "path"))
    return found.groupBy("entity").agg(best.alias("best")).select("entity", "best.stamp", "best.path")


def rows_of_files(spark: SparkSession, folder: str, files: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of the JSON ``files`` (entity, stamp, path) below ``folder``, with entity and stamp."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").json(folder).select("*", F.col("_metadata.file_path").alias("path"))
    return rows.join(sized(files, "files"), "path").drop("path")


def log_lines(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Log lines -> events and dead letters: level in lower case, ISO time, health checks dropped."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("log_type", "level", "timestamp", "request", "message")])
    good, dead = parse_json(rows, column, schema)
    events = good.select("log_type", F.lower("level").alias("level"), F.col("timestamp").try_cast("timestamp").alias("ts"), "request", "message")
    return events.filter(~F.coalesce(F.col("request").contains("/health"), F.lit(False))), dead

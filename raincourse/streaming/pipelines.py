"""Structured Streaming jobs: windows with watermarks and exact per-key state."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from raincourse.session import cut_lineage, new_path, sized

# A table is replayed with its files in any order; rows may then be this much out of order.
REPLAY = "366 days"
CLOSED = "2200-01-01"  # within the range of pandas times
BLOCK = 256  # keys that are carried together


def read_bus(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Kafka topic as a stream; ``parse_bus`` turns its values into rows."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).option("startingOffsets", "earliest").load())


def parse_bus(messages: DataFrame, schema: str) -> DataFrame:
    return messages.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path in any store that Spark reads is a folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def table_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream: all files below ``{folder}/{name}.parquet``, or that one file, so many a micro-batch."""
    path = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    if is_folder(spark, path):
        return stream.option("recursiveFileLookup", "true").parquet(path)
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def _drain(stream: DataFrame, path: str) -> None:
    query = (stream.writeStream.format("parquet").option("path", f"{path}/table")
             .option("checkpointLocation", f"{path}/checkpoint").outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Process all input that is available into a Parquet table in the shared folder and read it."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    _drain(stream, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/table")


def run_to_end(rows: DataFrame, ts: str, job: Callable[[DataFrame], DataFrame], name: str, late: str = REPLAY) -> DataFrame:
    """``job`` over all of the stream ``rows``, then closed: what it still holds back comes out too.

    Rows may come in any order within ``late``. After the input a row with the last possible time
    and nothing else is read, which moves the watermark past everything; the job starts again from its
    checkpoint for that, as it would after a failure.
    """
    spark = rows.sparkSession
    path = new_path(spark, name)
    end = spark.range(1).select(*[(F.lit(CLOSED) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema])
    end.where("false").write.parquet(f"{path}/end")
    ends = spark.readStream.schema(rows.schema).parquet(f"{path}/end")
    result = job(rows.unionByName(ends).withWatermark(ts, late))
    _drain(result, path)
    end.write.mode("append").parquet(f"{path}/end")
    _drain(result, path)
    return spark.read.schema(result.schema).parquet(f"{path}/table")


def windowed_rain(readings: DataFrame, key: str, ts: str, value: str, size: str = "30 minutes",
                  slide: str | None = None, late: str = "35 minutes") -> DataFrame:
    """Rain per key and event-time window; a window closes when the watermark passes its end."""
    rows = readings.withWatermark(ts, late) if readings.isStreaming else readings
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (rows.groupBy(w.alias("w"), key).agg(F.sum(value).alias("rain"))
            .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "rain"))


def _keyed(rows: DataFrame, key: str, ts: str, id_column: str, x: Column, step, out: str, expires: Callable | None = None) -> DataFrame:
    """Run ``step(last, us, id, x) -> (last, row or None)`` over each key in order of time and id.

    ``rows`` is a stream with a watermark on ``ts``. Rows wait in the key's state until the watermark
    has passed them, so nothing earlier can come any more, whatever the micro-batches held. The
    state is what waits and ``last``; ``expires(last)`` gives the time in microseconds from which a
    key's ``last`` makes no difference, and then the state goes.
    """
    names = ["key", "id", *[p.split()[0] for p in out.split(", ")]]

    def run(k, batches, held: GroupState):
        last, waiting = pickle.loads(held.get[0]) if held.exists else (None, [])
        if not held.hasTimedOut:
            for b in batches:
                if not pd.isna(k[0]):
                    waiting += zip(b["us"].tolist(), b["id"].tolist(), b["x"].tolist(), strict=True)
        mark = held.getCurrentWatermarkMs()
        ready, waiting = sorted((r for r in waiting if r[0] < mark * 1000), key=lambda r: r[:2]), [r for r in waiting if r[0] >= mark * 1000]
        found = []
        for us, i, value in ready:
            last, row = step(last, us, i, value)
            if row is not None:
                found.append((k[0], i, *row))
        wake = min((r[0] for r in waiting), default=None)
        if wake is None and last is not None and expires is not None:
            wake = expires(last)
            if wake < mark * 1000:
                last = wake = None
        if last is None and not waiting:
            if held.exists:
                held.remove()
        else:
            held.update((pickle.dumps((last, waiting)),))
            if wake is not None:
                held.setTimeoutTimestamp(max(mark, int(wake // 1000)) + 1)
        yield pd.DataFrame(found, columns=names)

    shaped = rows.select(F.col(key).alias("key"), F.unix_micros(ts).alias("us"), F.col(ts).alias("at"), F.col(id_column).alias("id"), x.alias("x"))
    applied = shaped.groupBy("key").applyInPandasWithState(
        run, f"key long, id long, {out}", "held binary", "append", GroupStateTimeout.EventTimeTimeout)
    if id_column == key:  # one row a key and time: the key is the id
        return applied.drop("id").withColumnRenamed("key", key)
    return applied.withColumnsRenamed({"key": key, "id": id_column})


def suppress_stream(alerts: DataFrame, key: str, ts: str, id_column: str, ttl_s: float) -> DataFrame:
    """Alerts at least ``ttl_s`` after the last SENT alert of their key (the state, until that time is over)."""
    def step(last, us, _id, _x):
        if last is None or us - last >= ttl_s * 1e6:
            return int(us), (int(us),)
        return last, None

    return _keyed(alerts, key, ts, id_column, F.lit(0), step, "sent_us long", lambda last: last + int(ttl_s * 1e6))


def lifecycle_stream(readings: DataFrame, key: str, ts: str, id_column: str, level: Column, normal: str) -> DataFrame:
    """A row when the level of a key changes: create on a new level, resolve on return to normal."""
    def step(last, _us, _id, now):
        if now == (normal if last is None else last):
            return last, None
        return (None if now == normal else now), (now, "resolve" if now == normal else "create")

    return _keyed(readings, key, ts, id_column, level, step, "level string, action string")


def last_good_stream(readings: DataFrame, key: str, ts: str, id_column: str, value: Column) -> DataFrame:
    """Each reading with its value, or the last good one of the key when it failed, and the source."""
    def step(last, _us, _id, now):
        if not pd.isna(now):
            return float(now), (float(now), "live")
        return last, (last, "missing" if last is None else "fallback")

    return _keyed(readings, key, ts, id_column, value, step, "value double, source string")


def _timed(step, last, us, i, x):
    """A step whose row also has its time."""
    last, row = step(last, us, i, x)
    return last, (int(us), *row)


def beside(events: DataFrame, table: DataFrame, link: str, key: str, most: int = BLOCK) -> DataFrame:
    """The stream ``events`` (link, ...) dealt to the blocks of keys it acts on, and ``table`` (link, key, ...) itself.

    The keys of a link are dealt to blocks (``_part``) of about ``most``, and an event goes once to each block of its
    link: events are not multiplied by keys. The rows of ``table`` come whole in the first micro-batch; they
    have no time, and events have no key. A key has one link. Rows of ``table`` without link or key, and events of no key, go.
    """
    spark = events.sparkSession
    known = table.dropna(subset=[link, key])
    parts = sized(known.groupBy(link).agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")), "parts")
    path = new_path(spark, "keys")
    known.join(parts, link).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).drop("_parts").write.parquet(path)
    keys = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    blocks = parts.select(link, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return events.join(blocks, link).unionByName(keys, allowMissingColumns=True)


def storage_stream(rows: DataFrame, link: str, key: str, ts: str, supply: Column, share: Column, outflow: float, capacity: Column, dead: Column, hours: float, start_fraction: float) -> DataFrame:
    """Storage of each key after each step, clamped between dead and full storage: (key, us, storage).

    ``rows`` are those of ``beside``, with a watermark on ``ts``: events have a ``supply``, keys a ``share`` of
    it (the inflow is their product), a ``capacity`` and ``dead`` storage. The state of a block is its keys and their storage
    as arrays, and the events that the watermark has not passed, once for all of its keys. An event is one step of all keys
    of the block; a key that is given twice steps twice. Events without a time go.
    """
    floats, out = ["share", "full", "least"], f"{key} long, us long, storage double"

    def moved(ids, level, given, times, flows):
        """Steps all keys through the events, a bounded number of rows at a time; ``level`` is changed, NaN in ``given`` stays."""
        at = np.searchsorted(ids, given[0])
        order = np.argsort(at, kind="stable")
        copy = np.arange(len(at)) - np.searchsorted(at[order], at[order])
        passes = [order[copy == n] for n in range(copy.max(initial=-1) + 1)]
        who = np.concatenate([given[0][p] for p in passes]) if passes else given[0]
        sets = [(at[p], *(x[p] for x in given[1:])) for p in passes]
        stretch = max(1, 100_000 // max(1, len(who)))
        for low in range(0, len(times) if len(who) else 0, stretch):
            found = []
            for flow in flows[low:low + stretch]:
                for to, part, full, least in sets:
                    new = level[to] + (part * flow - outflow) * hours * 3600.0
                    new = np.where(full + least < new, full + least, new)
                    level[to] = new = np.where(least > new, least, new)
                    found.append(new)
            some = times[low:low + stretch]
            yield pd.DataFrame({key: np.tile(who, len(some)), "us": np.repeat(some, len(who)), "storage": np.concatenate(found)})

    def run(k, batches, held: GroupState):
        given, ids, level, times, flows = pickle.loads(held.get[0]) if held.exists else (
            [np.zeros(0, np.int64), *(np.zeros(0) for _ in floats)], np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
        if not held.hasTimedOut:
            for b in batches:
                if pd.isna(k[0]):
                    continue
                own, event = b[b["given"]], b[~b["given"]]
                given = [np.concatenate([old, own[name].to_numpy()]) for old, name in zip(given, ["key", *floats], strict=True)]
                times, flows = np.concatenate([times, event["us"].to_numpy()]), np.concatenate([flows, event["flow"].to_numpy()])
        first, at = np.unique(given[0], return_index=True)
        new = given[2][at] * start_fraction  # where no step was made yet
        new[np.searchsorted(first, ids)] = level
        ids, level = first, new
        mark = held.getCurrentWatermarkMs()
        ready = times < mark * 1000
        order = np.argsort(times[ready], kind="stable")
        yield from moved(ids, level, given, times[ready][order], flows[ready][order])
        times, flows = times[~ready], flows[~ready]
        if len(given[0]) or len(times):
            held.update((pickle.dumps((given, ids, level, times, flows)),))
            if len(times):
                held.setTimeoutTimestamp(max(mark, int(times.min() // 1000)) + 1)

    shaped = rows.select(
        link, "_part", F.col(ts).alias("at"), F.col(key).isNotNull().alias("given"), F.coalesce(F.col(key), F.lit(0)).cast("long").alias("key"), F.coalesce(F.unix_micros(ts), F.lit(0)).alias("us"),
        *[x.cast("double").alias(name) for x, name in ((supply, "flow"), (share, "share"), (capacity, "full"), (dead, "least"))]).where("given OR at IS NOT NULL")
    return shaped.groupBy(link, "_part").applyInPandasWithState(run, out, "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def ratio_filter_stream(rows: DataFrame, key: str, ts: str, ratio: Column, process_noise: float, observation_noise: float, start: float = 1.0) -> DataFrame:
    """Scalar Kalman filter of a ratio after each step; state and variance are kept. A ratio of 1 is no observation."""
    def step(last, _us, _id, r):
        x, p = last or (start, 1.0)
        p += process_noise
        if abs(r - 1.0) > 1e-8 + 1e-5:
            gain = p / (p + observation_noise)
            x, p = x + gain * (r - x), (1 - gain) * p
        return (x, p), (x, p)

    return _keyed(rows, key, ts, key, ratio, lambda last, us, i, x: _timed(step, last, us, i, x), "us long, state double, variance double")


def split_stream(rows: DataFrame, event_ts: str, limit_s: int, path: str, arrival_ts: str | None = None, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All of the stream ``rows`` into two tables under ``path``: rows in time, and late ones.

    With ``arrival_ts`` a row is late when it arrived more than ``limit_s`` after its event. Without, it
    is late when its event lies more than ``limit_s`` before the newest event of the earlier micro-batches;
    that mark is carried from batch to batch in a table of its own. Each batch
    writes folders named by its number, so a batch that is run again replaces what it wrote.
    """
    spark = rows.sparkSession
    kinds, schema = ("in_time", "late", "mark"), rows.schema
    event = F.unix_micros(event_ts)
    spark.range(1).select(F.lit(None).cast("long").alias("newest")).write.mode("overwrite").parquet(f"{path}/mark/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        marks = batch.sparkSession.read.parquet(f"{path}/mark").where(F.col("batch") < number)
        newest = marks.agg(F.max("newest")).first()[0]
        if arrival_ts:
            late = F.unix_micros(arrival_ts) - event > limit_s * 1_000_000
        else:
            late = F.lit(False) if newest is None else event < newest - limit_s * 1_000_000
        late = F.coalesce(late, F.lit(False))
        held = batch.withColumn("_late", late).persist()
        for kind, part in (("in_time", held.where("NOT _late").drop("_late")), ("late", held.where("_late").drop("_late")), ("mark", held.agg(F.max(event).alias("newest")))):
            part.write.mode("overwrite").parquet(f"{path}/{kind}/batch={number}")
        held.unpersist()

    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return tuple(spark.read.schema(schema).parquet(f"{path}/{kind}/batch=*") for kind in kinds[:2])


def upsert_stream(rows: DataFrame, keys: list[str], order: str, path: str, buckets: int = 16, checkpoint: str | None = None) -> DataFrame:
    """All of the stream ``rows`` merged into a table under ``path``: of each key the row that is newest by ``order``.

    The table is partitioned by a hash of the keys; a batch reads and replaces the partitions it
    touches. Old and new rows are compared by ``order`` alone, so batches may come in any order and a
    batch that is run again changes nothing.
    """
    spark = rows.sparkSession
    part = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    names, shape = rows.columns, StructType([*rows.schema.fields, StructField("part", IntegerType())])

    def write(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("part", part)
        old = batch.sparkSession.read.schema(shape).parquet(f"{path}/table").join(new.select("part").distinct(), "part", "left_semi")
        newest = old.select(*names, "part").unionByName(new).groupBy("part", *keys).agg(F.max_by(F.struct(*names), order).alias("row")).select("row.*", "part")
        cut_lineage(newest).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/table")

    spark.createDataFrame([], shape).write.partitionBy("part").mode("ignore").parquet(f"{path}/table")
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint or f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(shape).parquet(f"{path}/table").select(*names)

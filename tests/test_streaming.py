"""Streams fed in several files give the batch result, whatever the split."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from raincourse.session import new_path
from raincourse.streaming import pipelines as P
from raincourse.streaming import state as ST

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def readings(spark):
    rows = [(i, i % 4 if i % 3 else 0, T0 + dt.timedelta(minutes=i * 4 + (i * 7) % 5), float((i * 37) % 200)) for i in range(600)]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, value double").cache()


def files(spark, df, parts, shuffled=False):
    """Write the rows as ``parts`` files, one micro-batch each, in time order or in any order."""
    path = new_path(spark, "in")
    n = df.count()
    order = list(range(parts))
    if shuffled:
        random.Random(parts).shuffle(order)
    for k in order:
        lo, hi = n * k // parts, n * (k + 1) // parts
        df.filter(F.col("event_id").between(lo, hi - 1)).coalesce(1).write.parquet(f"{path}/part={k}")
    return spark.readStream.schema("event_id long, user_id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("parts", [1, 7, 150])
def test_suppression(spark, readings, parts):
    want, last = [], {}
    for r in sorted(readings.collect(), key=lambda r: (r.ts, r.event_id)):
        if r.user_id not in last or (r.ts - last[r.user_id]).total_seconds() >= 1800:
            last[r.user_id] = r.ts
            want.append((r.user_id, r.event_id))
    batch = ST.suppress_repeats(readings, "user_id", "ts", "event_id", 1800, width_s=3600)
    stream = P.run_to_end(files(spark, readings, parts, True), "ts", lambda r: P.suppress_stream(r, "user_id", "ts", "event_id", 1800), "sent")
    assert rows(batch, "user_id", "event_id") == rows(stream, "user_id", "event_id") == sorted(want)


@pytest.mark.parametrize("parts", [1, 7])
def test_lifecycle(spark, readings, parts):
    level = F.when(F.col("value") > 120, "high").otherwise("none")
    batch = ST.level_changes(readings, "user_id", "ts", "event_id", level, "none", 1800.0)
    stream = P.run_to_end(files(spark, readings, parts, True), "ts", lambda r: P.lifecycle_stream(r, "user_id", "ts", "event_id", level, "none"), "life")
    got = rows(stream, "user_id", "event_id", "level", "action")
    assert rows(batch, "user_id", "event_id", "level", "action") == got and got


@pytest.mark.parametrize("parts", [1, 7])
def test_last_good(spark, readings, parts):
    good = F.when(F.col("value") > 60, F.col("value"))
    stream = P.run_to_end(files(spark, readings, parts, True), "ts", lambda r: P.last_good_stream(r, "user_id", "ts", "event_id", good), "good").collect()
    last, want = {}, {}
    for r in sorted(readings.collect(), key=lambda r: (r.ts, r.event_id)):
        last[r.user_id] = r.value if r.value > 60 else last.get(r.user_id)
        want[r.event_id] = last[r.user_id]
    assert {r.event_id: r.value for r in stream} == want
    assert {r.source for r in stream} >= {"live", "fallback"}


def test_rows_within_the_watermark_wait_and_older_ones_are_dropped(spark, readings):
    """In time order with a short watermark the answer is that of the batch; a row far behind it changes nothing."""
    late = spark.createDataFrame([(600, 1, T0 - dt.timedelta(days=1), 199.0)], readings.schema)
    good = F.when(F.col("value") > 60, F.col("value"))
    job = lambda r: P.last_good_stream(r, "user_id", "ts", "event_id", good)
    short = P.run_to_end(files(spark, readings.unionByName(late), 7), "ts", job, "good", "2 hours")
    whole = P.run_to_end(files(spark, readings, 1), "ts", job, "good")
    assert rows(short, "user_id", "event_id", "value", "source") == rows(whole, "user_id", "event_id", "value", "source")


@pytest.mark.parametrize("parts", [1, 6])
def test_a_stream_with_a_late_sink_keeps_every_row(spark, readings, parts):
    path = new_path(spark, "late")
    given = files(spark, readings, parts, True)
    in_time, late = P.split_stream(given, "ts", 3600, path)
    found, behind = rows(in_time, "event_id"), rows(late, "event_id")
    assert sorted(found + behind) == rows(readings, "event_id") and bool(behind) == (parts > 1)
    again = P.split_stream(given, "ts", 3600, path, checkpoint=new_path(spark, "again"))  # all batches once more
    assert [rows(t, "event_id") for t in again] == [found, behind]


def test_a_replayed_batch_changes_no_merged_row(spark, readings):
    path = new_path(spark, "merged")
    old = readings.where("event_id < 300").withColumns({"value": F.lit(-1.0), "ts": F.col("ts") - F.expr("INTERVAL 1 DAY")})
    sent = readings.withColumn("event_id", F.col("event_id") % 300)
    given = files(spark, old.unionByName(sent), 5, True)
    first = rows(P.upsert_stream(given, ["event_id"], "ts", path), "event_id", "value")
    assert first == rows(readings.where("event_id >= 300").withColumn("event_id", F.col("event_id") - 300), "event_id", "value")
    assert rows(P.upsert_stream(given, ["event_id"], "ts", path, checkpoint=new_path(spark, "again")), "event_id", "value") == first


def test_closed_windows_equal_batch_and_late_rows_are_left_out(spark, readings):
    late = spark.createDataFrame([(600, 0, T0, 999.0)], readings.schema)
    both = readings.unionByName(late)
    stream = P.run_to_table(P.windowed_rain(files(spark, both, 6).withColumn("ts", F.col("ts")), "user_id", "ts", "value"), "rain")
    batch = P.windowed_rain(readings, "user_id", "ts", "value")
    end = readings.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=35)
    assert rows(stream, "user_id", "start", "rain") == rows(batch.filter(F.col("end") <= F.lit(end)), "user_id", "start", "rain")


def test_every_row_is_in_time_or_late(readings):
    arrived = readings.withColumn("arrived", F.timestamp_micros(F.unix_micros("ts") + F.col("event_id") % 90 * 60_000_000))
    a, b = ST.split_late(arrived, "ts", "arrived", 35 * 60)
    assert a.count() + b.count() == readings.count() and b.count() > 0


def test_test_extension(spark):
    tests = spark.createDataFrame([(1, 14, 0), (2, 28, 2), (3, 14, 1), (4, 14, 0)], "test_id long, window_days int, extensions int")
    results = spark.createDataFrame([(1, "INCONCLUSIVE"), (2, "INCONCLUSIVE"), (3, "PROMOTE")], "test_id long, decision string")
    assert rows(ST.extend_tests(tests, results), "test_id", "window_days", "extensions", "status") == [
        (1, 21, 1, "ACTIVE"), (2, 28, 2, "CONCLUDED"), (3, 14, 1, "CONCLUDED"), (4, 14, 0, "ACTIVE")]


def test_storage_stays_in_its_bounds(spark):
    d = spark.createDataFrame([(1, 1e6, 5e4, i, 4000.0 if i % 3 else 0.0) for i in range(60)], "r long, cap double, dead double, day int, q double")
    f = ST.fold_storage(ST.series_of(d, ["r", "cap", "dead"], "day", "q"), F.col("cap"), F.col("dead"), lambda x: x.q, F.lit(900.0), 24.0, 0.65).first()
    assert f.steps == 60 and f.low_m3 >= 5e4 and f.high_m3 <= 1.05e6


def test_a_stream_does_not_depend_on_file_layout(spark, folder, tmp_path):
    from raincourse.plans import load_all
    from raincourse.registry import QUERIES

    load_all()
    events = spark.read.parquet(f"{folder}/events.parquet")
    layouts = {"one": 1, "six": 6, "many": 150}
    for name, parts in layouts.items():
        events.repartition(parts).write.parquet(f"{tmp_path}/{name}/events.parquet")
        events.limit(5).write.parquet(f"{tmp_path}/{name}/events_old.parquet")
    for query in ("t01_half_hour_stream", "t03_alert_suppression_stream"):
        want = sorted(map(str, QUERIES[query](spark, folder).collect()))
        assert want
        for name in layouts:
            assert sorted(map(str, QUERIES[query](spark, f"{tmp_path}/{name}").collect())) == want, (query, name)


def test_reservoirs_are_spread_over_tasks(spark, tmp_path):
    from raincourse.plans import load_all
    from raincourse.registry import QUERIES

    load_all()
    k = F.col("id")
    spark.range(20_000).coalesce(1).select(k.alias("s_suppkey"), F.sha2(k.cast("string"), 256).alias("s_name"), (k % 25).cast("int").alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(100).select(k.alias("o_orderkey"), (k % 25).alias("o_custkey"), F.timestamp_seconds(k * 86400).alias("o_orderdate"), (k * 1000.0).alias("o_totalprice")).write.parquet(f"{tmp_path}/orders.parquet")
    found = QUERIES["t05_storage_series"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and found.count() == 20_000


@pytest.mark.parametrize("late", ["2 hours", "366 days"])
def test_storage_of_a_block_of_reservoirs_equals_a_loop(spark, late):
    """Events reach a block once, however many reservoirs it holds; a reservoir given twice steps twice, null times and keys go."""
    flows = [(r, T0 + dt.timedelta(hours=h), float((h * 37 + r * 11) % 700)) for h in range(60) for r in (1, 2)] + [(1, None, 5.0), (None, T0, 5.0), (3, T0, 5.0)]
    reservoirs = [(k % 2 + 1, k, 0.5 + k % 3, 1e6 * (k + 1), 5e4) for k in range(40)] + [(1, 2, 2.5, 3e6, 5e4), (None, 90, 1.0, 1e6, 5e4), (1, None, 1.0, 1e6, 5e4), (1, 92, 1.0, None, 5e4)]
    path = new_path(spark, "flows")
    for part in range(3):
        spark.createDataFrame(flows[part * 41:part * 41 + 41], "river int, ts timestamp, q double").coalesce(1).write.parquet(f"{path}/part={part}")
    stream = spark.readStream.schema("river int, ts timestamp, q double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    table = spark.createDataFrame(reservoirs, "river int, k long, factor double, cap double, dead double")
    both = P.beside(stream, table, "river", "k", most=8)
    assert P.run_to_table(both, "both").where("k IS NULL").count() == 61 * 3 + 60 * 3  # 22 and 20 reservoirs in blocks of 8
    job = lambda x: P.storage_stream(x, "river", "k", "ts", F.col("q") + 1.0, F.col("factor"), 240.0, F.col("cap"), F.col("dead"), 1.0, 0.65)
    found = rows(P.run_to_end(both, "ts", job, "storage", late).fillna(-1.0), "k", "us", "storage")
    want, last = [], {}
    for river, ts, q in sorted((f for f in flows if None not in f), key=lambda f: f[1]):
        for r, k, factor, cap, dead in reservoirs:
            if r == river and k is not None:
                new = None
                if cap is not None:
                    new = last[k] = max(min(last.get(k, cap * 0.65) + (factor * (q + 1.0) - 240.0) * 1.0 * 3600.0, cap + dead), dead)
                want.append((k, int((ts - dt.datetime(1970, 1, 1)).total_seconds() * 1e6), -1.0 if new is None else new))
    assert found == sorted(want)

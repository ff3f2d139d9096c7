"""Chunked window helpers against plain windows, with chunks small enough to cut every key."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from raincourse.operators.ordered import drop_halo, last_known, number_rows, rolling_rows, time_blocks
from raincourse.operators.quality import page, page_index
from raincourse.operators.ranking import cumulative_counts, quantiles
from raincourse.session import new_path


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        key = 0 if rng.random() < 0.6 else rng.randrange(1, 9)  # one key holds most rows
        data.append((i, key, rng.randrange(0, 5000), None if rng.random() < 0.4 else float(rng.randrange(50))))
    return spark.createDataFrame(data, "id long, k long, t long, x double").cache()


def plain():
    return Window.partitionBy("k").orderBy("t", "id")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_number_rows(rows):
    same(number_rows(rows, ["k"], ["t", "id"], 97).select("id", "_rn"), rows.select("id", F.row_number().over(plain()).cast("long")))


def test_rolling_rows(rows):
    got = rolling_rows(rows, ["k"], ["t", "id"], 6, 97, lambda w: {"m": F.sum("x").over(w.rowsBetween(-6, 0)), "l": F.lag("x", 5).over(w)}, size=10)
    want = rows.select("id", F.sum("x").over(plain().rowsBetween(-6, 0)), F.lag("x", 5).over(plain()))
    same(got.select("id", "m", "l"), want)


def test_rolling_rows_halo_wider_than_block(rows):
    got = rolling_rows(rows, ["k"], ["t", "id"], 6, 97, lambda w: {"m": F.count("*").over(w.rowsBetween(-6, 0))}, size=2)
    same(got.select("id", "m"), rows.select("id", F.count("*").over(plain().rowsBetween(-6, 0))))


def test_last_known(rows):
    want = rows.select("id", F.last("x", ignorenulls=True).over(plain().rowsBetween(Window.unboundedPreceding, 0)))
    same(last_known(rows, ["k"], ["t", "id"], "x", "f", 113).select("id", "f"), want)


def test_time_blocks(rows):
    one = rows.groupBy("k", "t").agg(F.sum("x").alias("x"))
    w = Window.partitionBy("k").orderBy("t").rangeBetween(-300, 0)
    wb = Window.partitionBy("k", "_block").orderBy("t").rangeBetween(-300, 0)
    same(drop_halo(time_blocks(one, "t", 300, 70).withColumn("s", F.sum("x").over(wb))).select("k", "t", "s"), one.select("k", "t", F.sum("x").over(w)))


def test_quantiles_match_numpy(rows):
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    got = {r.k: r for r in quantiles(rows, ["k"], "x", probs, accuracy=100).collect()}
    data = rows.toPandas()
    for k, g in data.groupby("k"):
        for n, p in probs.items():
            assert got[k][n] == pytest.approx(np.quantile(g.x.dropna(), p))


def test_quantiles_without_key(rows):
    got = quantiles(rows, [], "x", {"m": 0.5}).first().m
    assert got == pytest.approx(np.median(rows.toPandas().x.dropna()))


def test_cumulative_counts_with_a_hot_value(spark):
    df = spark.createDataFrame([(1, 5.0)] * 400 + [(1, float(i)) for i in range(100)], "k int, x double")
    rows = {r.x: (r.n, r.n_before, r.n_total) for r in cumulative_counts(df, ["k"], "x", buckets=4).collect()}
    assert rows[5.0] == (401, 5, 500) and rows[99.0] == (1, 499, 500)


def test_a_deep_page_reads_one_range(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), F.lit("row").alias("y"))
    index = page_index(frame.repartition(5), ["x"], new_path(spark, "pages"), 8)
    want = sorted(r.x for r in frame.collect())
    for number in (1, 7, 40, 50, 51):
        found = page(index, ["x"], number, 100).collect()
        assert [r.x for r in found] == want[(number - 1) * 100:number * 100]
        assert all(r.total == 5000 and r.has_next == (number < 50) for r in found)
    deep = page(index, ["x"], 40, 100)
    deep.collect()
    files = {r.f for r in deep.select(F.input_file_name().alias("f")).collect()}
    assert len(files) <= 2 < index.select("_range").distinct().count()


def test_no_pages(spark):
    index = page_index(spark.createDataFrame([(1,)], "x int").where("false"), ["x"], new_path(spark, "pages"))
    assert page(index, ["x"], 1, 10).collect() == []

"""Stateful steps in batch form: exact folds over bounded series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raincourse.operators.ordered import drop_halo, rolling_rows, running_total, time_blocks


def series_of(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """One row per key with its ordered series as ``series`` (one value per time step)."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("series"))


def fold_storage(df: DataFrame, capacity: Column, dead: Column, inflow, outflow: Column, hours: float,
                 start_fraction: float) -> DataFrame:
    """Storage carried through ``series`` with clamps at each step: steps, last, lowest, highest.

    ``inflow`` maps an element of the series to m3/s. A series has one value per
    time step, so its length is bounded by the calendar, not by the row count.
    """
    start = F.struct((capacity * start_fraction).alias("v"), F.lit(float("inf")).alias("lo"), F.lit(float("-inf")).alias("hi"))

    def step(a: Column, x: Column) -> Column:
        new = F.greatest(F.least(a.v + (inflow(x) - outflow) * hours * 3600.0, capacity + dead), dead)
        return F.struct(new.alias("v"), F.least(a.lo, new).alias("lo"), F.greatest(a.hi, new).alias("hi"))

    return (df.withColumn("_r", F.aggregate("series", start, step))
            .withColumns({"steps": F.size("series").cast("long"), "last_m3": F.col("_r.v"),
                          "low_m3": F.col("_r.lo"), "high_m3": F.col("_r.hi")}).drop("_r", "series"))


def suppress_repeats(alerts: DataFrame, key: str, ts: str, id_column: str, ttl_s: int, width_s: int = 86_400) -> DataFrame:
    """Alerts at least ``ttl_s`` after the last SENT alert of their key: (key, id, sent_us).

    An alert after a quiet time of ``ttl_s`` is always sent, so the series of a
    key is cut there and the pieces are spread over tasks. Inside a piece the
    scan keeps one number (the last sent time) while sorted batches stream by.
    """
    us = F.unix_micros(ts)
    one = alerts.groupBy(key, us.alias("us")).agg(F.min(id_column).alias(id_column))
    one = one.withColumn("_s", F.col("us") / 1e6)
    near = Window.partitionBy(key, "_block").orderBy("us").rangeBetween(-(ttl_s * 1_000_000) + 1, -1)
    starts = drop_halo(time_blocks(one, "_s", ttl_s, width_s).withColumn("_first", F.count("us").over(near) == 0))
    pieces = running_total(starts, [key], ["_s", "us"], F.col("_first").cast("long"), "_piece", float(width_s))
    sorted_rows = (pieces.select(key, "_piece", "us", id_column).repartition(key, "_piece")
                   .sortWithinPartitions(key, "_piece", "us"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last = None, 0
        for b in batches:
            keep = np.zeros(len(b), dtype=bool)
            pairs = list(zip(b[key], b["_piece"]))
            times = b["us"].to_numpy()
            for i, (g, t) in enumerate(zip(pairs, times)):
                if g != group or t - last >= ttl_s * 1_000_000:
                    group, last, keep[i] = g, t, True
            yield b.loc[keep, [key, id_column, "us"]].rename(columns={"us": "sent_us"})

    return sorted_rows.mapInPandas(scan, f"{key} long, {id_column} long, sent_us long")


def level_changes(readings: DataFrame, key: str, ts: str, id_column: str, level: Column, normal: str, width_s: float = 86_400.0) -> DataFrame:
    """Batch form of the alert lifecycle: the level of a row against the row before it."""
    rows = readings.select(key, ts, id_column, level.alias("level"))
    prev = rolling_rows(rows, [key], [ts, id_column], 1, width_s, lambda w: {"_prev": F.lag("level", 1, normal).over(w)})
    return prev.filter(F.col("level") != F.col("_prev")).select(
        key, id_column, "level", F.when(F.col("level") == normal, "resolve").otherwise("create").alias("action"))


def split_late(rows: DataFrame, event_ts: str, arrival_ts: str, limit_s: int) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows that arrived more than ``limit_s`` after their event."""
    lag = F.col(arrival_ts).cast("double") - F.col(event_ts).cast("double")
    return rows.filter(lag <= limit_s), rows.filter(lag > limit_s)


def extend_tests(tests: DataFrame, results: DataFrame, days: int = 7, most: int = 2) -> DataFrame:
    """Tests after a round of results: open ones get more days at most ``most`` times, others end."""
    j = tests.join(results, "test_id", "full_outer")
    open_ = F.col("decision") == "INCONCLUSIVE"
    more = open_ & (F.col("extensions") < most)
    return j.select("test_id", (F.col("window_days") + F.when(more, days).otherwise(0)).alias("window_days"),
                    (F.col("extensions") + F.when(more, 1).otherwise(0)).alias("extensions"),
                    F.when(F.col("decision").isNull() | more, "ACTIVE").otherwise("CONCLUDED").alias("status"))

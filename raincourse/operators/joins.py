"""Lookups, as-of joins and text-key joins, all as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raincourse.operators.ordered import last_known
from raincourse.operators.rollup import first_available


def lookup(rows: DataFrame, dim: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join on ``key`` with defaults for missing entries. The planner broadcasts
    the dimension when its size allows."""
    joined = rows.join(dim, key, "left")
    return joined.withColumns({n: F.coalesce(F.col(n), F.lit(d)) for n, d in defaults.items()})


def with_fallback(df: DataFrame, keys: list[str], chain: list[tuple[str, str]], value: str, source: str) -> DataFrame:
    """First non-null column of ``chain`` [(column, label)] and its label."""
    return df.select(*keys, *first_available([(F.col(n), label) for n, label in chain], value, source))


def overlay(base: DataFrame, features: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Feature values replace registry defaults column by column."""
    f = features.select(key, *[F.col(n).alias(f"_{n}") for n in columns])
    joined = base.join(f, key, "left")
    return joined.withColumns({n: F.coalesce(f"_{n}", n) for n in columns}).drop(*[f"_{n}" for n in columns])


def dominant(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_n"), F.col(value))).alias(value))


def as_of(rows: DataFrame, features: DataFrame, keys: list[str], ts: str, values: list[str],
          width_s: float, tie: str) -> DataFrame:
    """For each row the newest feature values at or before its time.

    Both sides are stacked and the last values carried forward in time chunks,
    so a key that holds most rows is spread over tasks. ``tie`` orders rows of
    equal time; features sort before rows.
    """
    left = rows.withColumns({"_side": F.lit(1), "_tie": F.col(tie).cast("string"),
                             "_f": F.lit(None).cast(features.select(F.struct(*values)).schema[0].dataType)})
    right = features.select(*keys, ts, F.lit(0).alias("_side"), F.lit("").alias("_tie"), F.struct(*values).alias("_f"))
    both = left.unionByName(right, allowMissingColumns=True)
    carried = last_known(both, keys, [ts, "_side", "_tie"], "_f", "_known", width_s)
    return carried.filter("_side = 1").select(*rows.columns, *[F.col(f"_known.{n}").alias(n) for n in values])


def substring_join(rows: DataFrame, text: str, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose text contains ``key`` of the dimension, keys of any length from 1.

    Each text is cut into its distinct substrings of the lengths between the shortest and the
    longest key, read from the dimension first, so the match is an equi-join.
    """
    low, high = dim.where(F.length(key) > 0).agg(F.min(F.length(key)), F.max(F.length(key))).first()
    low, high = low or 1, high or 1
    cuts = F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(low), F.lit(high)),
        lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1),
                                                          lambda i: F.substring(F.col(text), i, n))).otherwise(F.array().cast("array<string>")))))
    return rows.withColumn(key, F.explode(cuts)).join(dim, key)


def prefix_join(rows: DataFrame, text: str, dim: DataFrame, key: str) -> DataFrame:
    """Rows whose text starts with ``key``: every prefix of the text is matched by equality."""
    prefixes = F.transform(F.sequence(F.lit(1), F.length(text)), lambda n: F.substring(F.col(text), F.lit(1), n))
    return rows.withColumn(key, F.explode(prefixes)).join(dim, key)

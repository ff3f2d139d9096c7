"""Order-dependent work that stays parallel when one key holds most rows.

A plain window over ``partitionBy(key)`` sends a whole key to one task. Here
time is cut into chunks of fixed width: rows are sorted inside (key, chunk) and
only one small row per (key, chunk) travels across chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunk_of(order: Column, width: float) -> Column:
    """Chunk number of a timestamp (width in seconds) or of a number."""
    return F.floor(order.cast("double") / width).cast("long")


def running_total(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str,
                  width: float) -> DataFrame:
    """Running sum of ``value`` per key in the given order (``order[0]`` is cut into chunks)."""
    base = df.withColumn("_c", chunk_of(F.col(order[0]), width)).withColumn("_v", value)
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = (base.groupBy(*keys, "_c").agg(F.sum("_v").alias("_s"))
              .withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
              .drop("_s"))
    inside = (Window.partitionBy(*keys, "_c").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (base.join(totals, [*keys, "_c"])
            .withColumn(out, F.col("_before") + F.sum("_v").over(inside))
            .drop("_c", "_v", "_before"))


def number_rows(df: DataFrame, keys: list[str], order: list[str], width: float,
                out: str = "_rn") -> DataFrame:
    """Dense row number 1..n per key. ``order`` must be a total order."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out, width)


def row_blocks(df: DataFrame, halo: int, size: int = 100_000, rn: str = "_rn") -> DataFrame:
    """Cut numbered rows into blocks; each block also gets the ``halo`` rows before it.

    Windows over (key, ``_block``) then see every row a frame of up to ``halo``
    preceding rows needs. Drop ``_halo`` rows after the window.
    """
    size = max(size, halo)
    block = F.floor((F.col(rn) - 1) / size).cast("long")
    last = (F.col(rn) - 1) % size >= size - halo
    return (df.withColumn("_own", block)
            .withColumn("_block", F.explode(F.when(last, F.array("_own", F.col("_own") + 1))
                                            .otherwise(F.array("_own"))))
            .withColumn("_halo", F.col("_block") != F.col("_own")).drop("_own"))


def time_blocks(df: DataFrame, ts: str, lookback_s: int, width_s: int) -> DataFrame:
    """Cut rows into time blocks; each block also gets the rows up to ``lookback_s`` before it."""
    t = F.col(ts).cast("double")
    own = F.floor(t / width_s).cast("long")
    reach = F.floor((t + lookback_s) / width_s).cast("long")
    return (df.withColumn("_own", own)
            .withColumn("_block", F.explode(F.sequence("_own", reach)))
            .withColumn("_halo", F.col("_block") != F.col("_own")).drop("_own"))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("_halo")).drop("_halo", "_block")


def rolling_rows(df: DataFrame, keys: list[str], order: list[str], halo: int, width: float,
                 make, size: int = 100_000) -> DataFrame:
    """Apply ``make(window)`` -> {name: column} where frames reach at most ``halo`` rows back."""
    blocks = row_blocks(number_rows(df, keys, order, width), halo, size)
    w = Window.partitionBy(*keys, "_block").orderBy("_rn")
    cols = make(w)
    return drop_halo(blocks.withColumns(cols)).drop("_rn")


def last_known(df: DataFrame, keys: list[str], order: list[str], value: str, out: str,
               width: float) -> DataFrame:
    """Newest non-null ``value`` at or before each row (forward fill)."""
    base = df.withColumn("_c", chunk_of(F.col(order[0]), width))
    marker = F.when(F.col(value).isNotNull(), F.struct(*order))
    before = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = (base.groupBy(*keys, "_c").agg(F.max_by(F.col(value), marker).alias("_l"))
               .withColumn("_carry", F.last("_l", ignorenulls=True).over(before)).drop("_l"))
    inside = (Window.partitionBy(*keys, "_c").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (base.join(carried, [*keys, "_c"])
            .withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carry"))
            .drop("_c", "_carry"))

"""Exact order statistics without gathering a column in one task.

Equal values are counted first, so a value held by a third of all rows is one
row. The distinct values are then cut into buckets at approximate quantiles
(a bounded sketch); sorting happens inside a bucket and only bucket totals are
added up across buckets. Edges steer the split, never the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raincourse.session import sized


def cumulative_counts(df: DataFrame, keys: list[str], value: str, weights: dict | None = None,
                      buckets: int = 128) -> DataFrame:
    """One row per (key, distinct value): each weight, its sum before the value and its total.

    ``weights`` maps a name to the column counted under it (default ``n``: rows).
    Output columns per weight w: ``w``, ``w_before``, ``w_total``.
    """
    weights = weights or {"n": F.lit(1).cast("long")}
    df = df.filter(F.col(value).isNotNull())
    steps = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    edges = df.groupBy(*keys).agg(F.percentile_approx(value, steps, F.lit(1000)).alias("_e"))
    counts = df.groupBy(*keys, value).agg(*[F.sum(c).alias(w) for w, c in weights.items()])
    split = counts.join(sized(edges, "edges"), keys) if keys else counts.withColumn("_e", edges.scalar())
    placed = split.withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(value)))).drop("_e")
    order = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    totals = placed.groupBy(*keys, "_b").agg(*[F.sum(w).alias(f"_{w}") for w in weights])
    totals = totals.select(
        *keys, "_b",
        *[F.coalesce(F.sum(f"_{w}").over(order), F.lit(0)).alias(f"_{w}_offset") for w in weights],
        *[F.sum(f"_{w}").over(whole).alias(f"{w}_total") for w in weights])
    inside = (Window.partitionBy(*keys, "_b").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    out = placed.join(totals, [*keys, "_b"])
    for w in weights:
        out = out.withColumn(f"{w}_before",
                             F.col(f"_{w}_offset") + F.coalesce(F.sum(w).over(inside), F.lit(0)))
    return out.drop("_b", *[f"_{w}_offset" for w in weights])


ACCURACY = 10_000  # of the sketch: it misses a rank by at most one part in so many of all rows


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], accuracy: int = ACCURACY) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per entry of ``probs``, by selection.

    A sketch brackets each wanted position between two values. One pass then counts rows: those
    outside all brackets only by the stretch they lie in, a few rows per task and key, those
    inside by their value. So one row in some thousands is shuffled and sorted, not the column. A key of at most
    ``accuracy`` rows is one bracket. Should a position lie outside its bracket, the query fails and says so.
    """
    df = df.filter(F.col(value).isNotNull()).select(*keys, value)
    x, slack = F.col(value), 4 / accuracy
    cuts = [min(max(p + side * slack, 0.0), 1.0) for p in probs.values() for side in (-1, 1)]
    edges = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*map(F.lit, cuts)), F.lit(accuracy)).alias("_e"), F.count(F.lit(1)).alias("_few"))
    edges = edges.select(*keys, F.struct("_e", (F.col("_few") <= accuracy).alias("_few")).alias("_b"))
    rows = df.join(sized(edges, "edges"), keys) if keys else df.withColumn("_b", edges.scalar())
    rows = rows.select(*keys, value, "_b.*")
    on_edge = F.array_contains("_e", x)
    inside = on_edge | F.col("_few")
    for i in range(len(probs)):
        inside = inside | ((x > F.col("_e")[2 * i]) & (x < F.col("_e")[2 * i + 1]))
    # Stretches between neighbouring edges are even, the edges themselves odd.
    stretch = 2 * F.size(F.filter("_e", lambda e: e < x)) + on_edge.cast("int")
    counts = rows.groupBy(*keys, stretch.alias("_s"), F.when(inside, x).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*keys, "_s").agg(F.sum("_n").alias("_t")).select(
        *keys, "_s", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"), F.sum("_t").over(Window.partitionBy(*keys)).alias("_total"))
    within = Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(totals, [*keys, "_s"]).withColumn("_end", F.col("_before") + F.sum("_n").over(within))
    aggs, out = [], []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_total") - 1)
        first = lambda pos: F.min(F.when(F.col("_end") > pos, F.struct("_s", "_v")))
        aggs += [first(F.floor(at)).alias(f"_lo_{name}"), first(F.ceil(at)).alias(f"_hi_{name}"), F.max(at - F.floor(at)).alias(f"_f_{name}")]
        low, high = (F.coalesce(F.col(f"_{side}_{name}")["_v"], F.raise_error(F.lit("a quantile lies outside the bracket of its sketch"))) for side in ("lo", "hi"))
        out.append((low + (high - low) * F.col(f"_f_{name}")).alias(name))
    result = placed.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("_rows"))
    return result.where("_rows > 0").select(*keys, *out)


def midranks(df: DataFrame, keys: list[str], value: str, weights: dict, buckets: int = 128) -> DataFrame:
    """Cumulative counts plus ``n`` over all weights and the average rank of each tie group."""
    weights = {"n": F.lit(1).cast("long"), **weights}
    return (cumulative_counts(df, keys, value, weights, buckets)
            .withColumn("midrank", F.col("n_before") + (F.col("n") + 1) / 2))

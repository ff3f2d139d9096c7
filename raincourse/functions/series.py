"""Window expressions over regular series and small shapes built on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from raincourse.operators.ordered import number_rows


def lags(value: Column, offsets: list[int], w: WindowSpec) -> dict[int, Column]:
    return {n: F.lag(value, n).over(w) for n in offsets}


def rolling(value: Column, n: int, w: WindowSpec, full: bool) -> dict[str, Column]:
    """Mean, max and sample deviation of the last n rows; null before n rows when ``full``."""
    frame = w.rowsBetween(1 - n, 0)
    stats = {"mean": F.avg(value).over(frame), "max": F.max(value).over(frame), "std": F.stddev_samp(value).over(frame)}
    if full:
        stats = {k: F.when(F.count(F.lit(1)).over(frame) == n, e) for k, e in stats.items()}
    return stats


def weighted_lags(value: Column, weights: list[float], w: WindowSpec) -> Column:
    """Weighted mean of the newest rows; at the start the weights present are renormalised."""
    parts = [F.coalesce(F.lag(value, i).over(w) if i else value, F.lit(0.0)) * x for i, x in enumerate(weights)]
    present = [F.when(F.row_number().over(w) > i, x).otherwise(0.0) for i, x in enumerate(weights)]
    return reduce(lambda a, b: a + b, parts) / reduce(lambda a, b: a + b, present)


def regime(nino: Column, nina: Column, dmi: Column, limit: float = 0.4) -> Column:
    """Compound regimes first, then the ocean signal, then the dipole."""
    return (F.when(nino & (dmi >= limit), "SEVERE_DRY").when(nina & (dmi <= -limit), "SEVERE_WET")
            .when(nino, "EL_NINO").when(nina, "LA_NINA").when(dmi >= limit, "POSITIVE_IOD")
            .when(dmi <= -limit, "NEGATIVE_IOD").otherwise("NEUTRAL"))


# Rain multiplier and temperature offset by regime.
REGIME_FACTORS = {"EL_NINO": (0.72, 0.4), "LA_NINA": (1.35, -0.2), "NEUTRAL": (1.00, 0.0), "POSITIVE_IOD": (0.85, 0.1),
                  "NEGATIVE_IOD": (1.20, -0.1), "SEVERE_DRY": (0.55, 0.6), "SEVERE_WET": (1.60, -0.3)}


def regime_factors(name: Column) -> tuple[Column, Column]:
    """Rain multiplier and temperature offset; unknown names count as neutral."""
    out = []
    for i in (0, 1):
        chain = F.when(name == "NEUTRAL", REGIME_FACTORS["NEUTRAL"][i])
        for key, pair in REGIME_FACTORS.items():
            chain = chain.when(name == key, pair[i])
        out.append(chain.otherwise(REGIME_FACTORS["NEUTRAL"][i]))
    return out[0], out[1]


def run_length(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """Position of each row in its run of equal values (gaps and islands)."""
    a = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    b = F.row_number().over(Window.partitionBy(*keys, value).orderBy(order))
    run = Window.partitionBy(*keys, value, "_g").orderBy(order)
    return df.withColumn("_g", a - b).withColumn(out, F.row_number().over(run)).drop("_g")


def chronological_split(df: DataFrame, ts: str, train: float, val: float, width: float) -> DataFrame:
    """Train, val and test by position among the distinct time steps."""
    steps = df.select(ts).distinct().withColumn("_k", F.lit(0))
    total = steps.agg(F.count("*")).scalar()
    n = number_rows(steps, ["_k"], [ts], width)
    split = (F.when(F.col("_rn") <= F.floor(total * train), "train")
             .when(F.col("_rn") <= F.floor(total * (train + val)), "val").otherwise("test"))
    return df.join(n.select(ts, split.alias("split")), ts)


def sequences(df: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    """The n values before each row as ``sequence``; rows without n predecessors are left out."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn("sequence", F.collect_list(value).over(w)).filter(F.size("sequence") == n)


def stack(parts: list[DataFrame]) -> DataFrame:
    """Rows of all parts under the union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

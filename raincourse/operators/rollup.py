"""Small reusable shapes: worst level, newest row, ordered limits, source precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rank_of(level: Column, order: list[str]) -> Column:
    """Position of a level in ``order`` (lowest first); unknown levels rank 0."""
    return reduce(lambda acc, i: acc.when(level == order[i], i), range(1, len(order)),
                  F.when(level == order[0], 0)).otherwise(0)


def level_of(rank: Column, order: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in order]), (rank + 1).cast("int"))


def worst(level: Column, order: list[str]) -> Column:
    """Aggregate: the highest level of a group."""
    return level_of(F.max(rank_of(level, order)), order)


def classify(value: Column, limits: list[tuple[float, str]], default: str | None, op: str = ">=") -> Column:
    """First label whose limit holds, tested in the given order."""
    tests = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b,
             "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
    chain = None
    for limit, label in limits:
        cond = tests[op](value, F.lit(limit))
        chain = F.when(cond, label) if chain is None else chain.when(cond, label)
    return chain.otherwise(default)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key by map-side combined ``max_by``: no sort, no hot task."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
            .select(*keys, "_row.*"))


def first_available(sources: list[tuple[Column, str]], value: str, source: str) -> list[Column]:
    """Value of the first non-null source and the label of that source."""
    label = reduce(lambda acc, s: acc.when(s[0].isNotNull(), s[1]), sources[1:],
                   F.when(sources[0][0].isNotNull(), sources[0][1]))
    return [F.coalesce(*[s[0] for s in sources]).alias(value), label.alias(source)]

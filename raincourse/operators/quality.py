"""Row constraints, column expectations, ingest rules and service measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from raincourse.operators.ordered import rolling_rows


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejected rows; rejects carry the names of the rules they break."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), name) for name, ok in rules.items()]))
    marked = df.withColumn("violations", broken)
    return marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0)


def first_failure(checks: list[tuple[str, Column]], ok: str = "ok") -> Column:
    """Name of the first check that fails."""
    return reduce(lambda acc, x: acc.when(x[1], x[0]), checks[1:], F.when(checks[0][1], checks[0][0])).otherwise(ok)


def ingest_once(rows: DataFrame, key: str) -> DataFrame:
    return rows.dropDuplicates([key])


def resolve(alerts: DataFrame, resolutions: DataFrame, key: str) -> DataFrame:
    """Alerts with ``is_active`` false where a resolution exists."""
    done = resolutions.select(key).distinct().withColumn("_done", F.lit(True))
    return (alerts.join(done, key, "left")
            .withColumn("is_active", F.col("is_active") & F.col("_done").isNull()).drop("_done"))


def page_index(df: DataFrame, order: list[str], path: str, ranges: int | None = None) -> DataFrame:
    """``df`` written for ``page``: ranges of ``order``, one folder each, with every row's place in its range.

    Without ``ranges`` the planner sizes them.
    """
    ranged = df.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    # The lower 33 bits of this id count the rows of a partition from 0.
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = ranged.select("*", place.alias("_place"), F.spark_partition_id().alias("_range"))
    rows.write.partitionBy("_range").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


def page(index: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of a page index, in order, with total and has_next.

    The counts of the ranges, one row each, say which ranges hold the page; only those are read, however deep the page.
    """
    ranges = sorted(tuple(r) for r in index.groupBy("_range").count().collect())
    low, high, before, wanted = (number - 1) * size, number * size, 0, F.lit(False)
    for name, count in ranges:
        if before < high and before + count > low:
            wanted = wanted | ((F.col("_range") == name) & F.col("_place").between(low - before, high - before - 1))
        before += count
    return index.where(wanted).orderBy(*order).drop("_range", "_place").withColumns({"total": F.lit(before).cast("long"), "has_next": F.lit(high < before)})


def without_patterns(df: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    return df.select(*[n for n in df.columns if not any(p in n.lower() for p in patterns)])


def dense_columns(df: DataFrame, share: float) -> DataFrame:
    """Columns with at least ``share`` non-null values (one counting pass, one row to the driver)."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(n).alias(n) for n in df.columns]).first()
    return df.select(*[n for n in df.columns if row[n] >= share * row["_n"]])


def _as_rows(agg: DataFrame, names: list[str], out: str) -> DataFrame:
    return agg.unpivot([], names, "column_name", out)


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    return _as_rows(df.agg(*[F.avg(F.col(n).isNull().cast("double")).alias(n) for n in columns]), columns, "null_rate")


def violation_rates(df: DataFrame, bad: dict[str, Column]) -> DataFrame:
    """Share of non-null values that break a rule, per column."""
    return _as_rows(df.agg(*[(F.count_if(b) / F.count(n)).alias(n) for n, b in bad.items()]), list(bad), "violation_rate")


def negative_gaps(df: DataFrame, order: list[str], ts: str, width: float) -> DataFrame:
    """Count of rows earlier than the row before them in ingest order, and of rows without a time."""
    rows = df.withColumn("_k", F.lit(0))
    lagged = rolling_rows(rows, ["_k"], order, 1, width, lambda w: {"_prev": F.lag(ts).over(w)})
    return lagged.agg(F.count_if(F.col(ts) < F.col("_prev")).alias("negative_gaps"), F.count_if(F.col(ts).isNull()).alias("missing_times"), F.count("*").alias("n"))


# Name patterns, bounds and severity of the column expectations.
RANGE_RULES = [(("precip", "rain"), 0.0, 500.0, "critical"), (("t2m", "temperature_2m"), -5.0, 45.0, "critical"),
               (("rh", "humidity"), 0.0, 100.0, "critical"), (("wind_speed", "wind_spd"), 0.0, 80.0, "warning"),
               (("soil_moisture", "smap", "sm_"), 0.0, 1.0, "critical")]
NON_NEGATIVE = ("streamflow", "discharge", "cms", "runoff")
MAX_NULL_RATE = 0.05


def run_suite(df: DataFrame, order: list[str], ts: str, skip: tuple[str, ...], width: float) -> DataFrame:
    """Failed expectations (column_name, expectation, severity, rate) of all columns.

    All column checks share one aggregation; the time check is the only one that needs order.
    """
    columns = [n for n in df.columns if n not in skip and n != ts]
    checks: list[tuple[str, str, str, Column]] = []
    for n in columns:
        for patterns, lo, hi, severity in RANGE_RULES:
            if any(p in n.lower() for p in patterns):
                checks.append((n, "range_check", severity, F.count_if(~F.col(n).between(lo, hi)) / F.count(n)))
        if any(p in n.lower() for p in NON_NEGATIVE):
            checks.append((n, "non_negative", "critical", F.count_if(F.col(n) < 0) / F.count(n)))
        rate = F.avg(F.col(n).isNull().cast("double"))
        checks.append((n, "null_rate", "critical", F.when(rate > MAX_NULL_RATE, rate).otherwise(0.0)))
    rows = F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(e).alias("expectation"), F.lit(s).alias("severity"),
                              F.col(f"_{i}").alias("rate")) for i, (n, e, s, _) in enumerate(checks)])
    found = df.agg(*[x[3].cast("double").alias(f"_{i}") for i, x in enumerate(checks)]).select(F.inline(rows))
    times = F.array(*[F.struct(F.lit(ts).alias("column_name"), F.lit(e).alias("expectation"), F.lit("critical").alias("severity"), (F.col(k) / F.col("n")).alias("rate"))
                      for e, k in (("monotone_timestamp", "negative_gaps"), ("readable_timestamp", "missing_times"))])
    gaps = negative_gaps(df, order, ts, width).select(F.inline(times))
    return found.unionByName(gaps).filter("rate > 0")


def require_no_critical(failures: DataFrame) -> None:
    """Stop a run when any critical expectation failed."""
    row = failures.filter("severity = 'critical'").first()
    if row:
        raise ValueError(f"critical expectation failed: {row.column_name} {row.expectation} rate={row.rate:.4f}")


def bucket_quantile(df: DataFrame, keys: list[Column], value: Column, bounds: list[float], q: float) -> DataFrame:
    """Quantile from cumulative buckets, linear inside the bucket that holds it.

    The bucket counts of a group are columns of one aggregation.
    """
    a = df.groupBy(*keys).agg(*[F.count_if(value <= b).alias(f"_{i}") for i, b in enumerate(bounds)])
    target = q * F.col(f"_{len(bounds) - 1}")
    out = None
    for i, b in enumerate(bounds):
        lo, n0 = (bounds[i - 1], F.col(f"_{i - 1}")) if i else (0.0, F.lit(0))
        inside = lo + (b - lo) * (target - n0) / F.nullif(F.col(f"_{i}") - n0, F.lit(0))
        cond = F.col(f"_{i}") >= target
        out = F.when(cond, inside) if out is None else out.when(cond, inside)
    names = [n for n in a.columns if not n.startswith("_")]
    return a.select(*names, out.alias("q"))

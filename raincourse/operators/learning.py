"""Feature scaling and selection, ensembles, gates and decisions over metric tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raincourse.operators.ranking import cumulative_counts, quantiles
from raincourse.operators.rollup import clip
from raincourse.operators.statistics import bin_of, coverage, width_edges
from raincourse.session import sized

COVERAGE_TARGET, COVERAGE_FLOOR = 0.90, 0.89


# --- columns and scaling ---------------------------------------------------

def column_kinds(df: DataFrame, limit: int = 20) -> DataFrame:
    """(col, n, kind): categorical when text or at most ``limit`` distinct values.

    Columns become rows first, so one value held by many rows is one row after
    the map-side combine and no task holds a whole column.
    """
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(x).alias("col"), F.col(x).cast("string").alias("v")) for x in df.columns])).alias("s")).select("s.*")
    counts = long.groupBy("col", "v").agg(F.count("*").alias("k")).groupBy("col").agg(F.count("v").alias("n"))
    return counts.withColumn("kind", F.when(F.col("col").isin(text) | (F.col("n") <= limit), "categorical").otherwise("continuous"))


def standardise(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.greatest(F.stddev_samp(value), F.lit(1e-8)).alias("_s"))
    return df.join(sized(stats, "stats"), keys).withColumn(out, (F.col(value) - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def robust_scale(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(x - median) / interquartile range."""
    q = quantiles(df, keys, value, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    scaled = (F.col(value) - F.col("_q2")) / F.nullif(F.col("_q3") - F.col("_q1"), F.lit(0.0))
    return df.join(sized(q, "quartiles"), keys).withColumn(out, scaled).drop("_q1", "_q2", "_q3")


def frequency_encoding(df: DataFrame, category: str, ts: str, days: int) -> DataFrame:
    """Share of each category in the newest ``days`` of the data."""
    last = df.agg(F.max(ts)).scalar()
    recent = df.filter(F.col(ts) >= last - F.make_dt_interval(F.lit(days)))
    counts = recent.groupBy(category).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.select(category, F.round(F.col("_n") / total, 8).alias("freq"))


def knot_position(x: Column, edges: Column) -> Column:
    """Position of x between quantile knots, 0 to 1, interpolated inside a step."""
    steps = F.size(edges) - 1
    b = F.size(F.filter(edges, lambda e: e <= x))
    low = F.element_at(edges, F.greatest(b, F.lit(1)))
    high = F.element_at(edges, F.least(b + 1, steps + 1))
    return (F.when(x <= F.element_at(edges, 1), 0.0).when(x >= F.element_at(edges, -1), 1.0)
            .otherwise((b - 1 + (x - low) / F.nullif(high - low, F.lit(0.0))) / steps))


def binned_mutual_information(df: DataFrame, keys: list[str], value: str, target: str, bins: int = 10) -> DataFrame:
    """Mutual information of equal-width bins and a discrete target.

    The rows are counted once by (key, bin, target); all else runs on the counts.
    """
    placed = df.join(sized(width_edges(df, keys, value, bins), "edges"), keys).withColumn("_b", bin_of(F.col(value), F.col("edges")))
    n = placed.groupBy(*keys, "_b", target).agg(F.count("*").cast("double").alias("_n"))
    total = [F.sum("_n").over(Window.partitionBy(*keys, *extra)) for extra in (["_b"], [target], [])]
    x = n.withColumns({"_nx": total[0], "_ny": total[1], "_t": total[2]})
    return x.groupBy(*keys).agg(F.sum(F.col("_n") / F.col("_t") * F.ln(F.col("_n") * F.col("_t") / (F.col("_nx") * F.col("_ny")))).alias("mi"))


# --- attribution -----------------------------------------------------------

def attribution(contributions: DataFrame, feature: str, value: str, top: int) -> DataFrame:
    m = contributions.groupBy(feature).agg(F.avg(F.abs(value)).alias("m"))
    return m.orderBy(F.round("m", 9).desc(), feature).limit(top).select(feature, F.round("m", 8).alias("mean_abs"))


def pair_interactions(contributions: DataFrame, row: str, feature: str, value: str, top: int) -> DataFrame:
    """Mean absolute product of two contributions of a row, for f1 < f2.

    A row has one contribution per feature, so pairs are bounded by schema width.
    """
    s = contributions.groupBy(row).agg(F.array_sort(F.collect_list(F.struct(feature, value))).alias("s"))
    p = (s.select(F.posexplode("s").alias("i", "a"), "s")
         .select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")))
    e = p.groupBy(F.col(f"a.{feature}").alias("f1"), F.col(f"b.{feature}").alias("f2")).agg(
        F.avg(F.abs(F.col(f"a.{value}") * F.col(f"b.{value}"))).alias("e"))
    return e.orderBy(F.round("e", 12).desc(), "f1", "f2").limit(top).select("f1", "f2", F.round("e", 10).alias("effect"))


def partial_dependence(df: DataFrame, row: str, feature: str, value: str, weight: Column,
                       grid: int) -> DataFrame:
    """Partial dependence of a linear score on an even grid of each feature."""
    score = df.groupBy(row).agg(F.sum(F.col(value) * weight).alias("_score"))
    x = df.join(score, row)
    # the score is linear: the mean without the feature is taken once, the grid is added to one row per feature
    rest = x.groupBy(feature).agg(F.avg(F.col("_score") - weight * F.col(value)).alias("_rest"),
                                  F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    g = rest.withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    at = F.col("_lo") + F.col("grid") * (F.col("_hi") - F.col("_lo")) / (grid - 1)
    return g.select(feature, "grid", F.round(F.col("_rest") + weight * at, 8).alias("mean_prediction"))


# --- ensembles and intervals -----------------------------------------------

def inverse_error_weights(errors: DataFrame) -> DataFrame:
    """(model_id, weight) from (model_id, e): inverse error, summing to one."""
    inv = 1 / F.greatest("e", F.lit(1e-6))
    total = errors.agg(F.sum(inv)).scalar()
    return errors.select("model_id", (inv / (total + 1e-12)).alias("weight"))


def ensemble(members: DataFrame, keys: list[str], x: Column, w: Column, scores: Column | None = None) -> DataFrame:
    """Weighted mean, spread and 90 % bounds; members of one target are few.

    ``scores`` is a nonconformity quantile of the group, when known; else the bounds are normal.
    """
    known = F.lit(None).cast("double") if scores is None else F.max(scores)
    s = members.filter(x.isNotNull()).groupBy(*keys).agg(F.collect_list(F.struct(w.alias("w"), x.alias("x"))).alias("m"), known.alias("_q"))
    sw = F.aggregate("m", F.lit(0.0), lambda a, e: a + e.w)
    s = s.withColumn("mean", F.aggregate("m", F.lit(0.0), lambda a, e: a + e.w * e.x) / sw)
    var = F.aggregate("m", F.lit(0.0), lambda a, e: a + e.w * F.pow(e.x - F.col("mean"), 2)) / sw
    s = s.withColumn("std", F.sqrt(var))
    margin = F.coalesce("_q", 1.645 * F.greatest("std", F.lit(1e-6)))
    return s.select(*keys, "mean", "std", (F.col("mean") - margin).alias("lower"), (F.col("mean") + margin).alias("upper"))


def split_conformal(df: DataFrame, keys: list[str], score: str, level: float) -> DataFrame:
    """Order statistic ceil((n+1)*level) of the scores, at most the largest."""
    c = cumulative_counts(df, keys, score)
    k = F.least(F.ceil((F.col("n_total") + 1) * level), F.col("n_total"))
    return c.filter(F.col("n_before") < k).groupBy(*keys).agg(F.max(score).alias("split_conformal"))


def interval_scale(df: DataFrame, keys: list[str], method: str = "isotonic") -> DataFrame:
    """Factor that moves interval coverage to the target: ``isotonic`` never shrinks below it
    (0.5 to 3), ``platt`` is the plain ratio (0.5 to 2)."""
    p = df.groupBy(*keys).agg(coverage(F.col("y_true"), F.col("q_lo"), F.col("q_hi")).alias("_p"))
    factor = (F.when(F.col("_p") < COVERAGE_FLOOR, COVERAGE_TARGET / F.greatest("_p", F.lit(0.01)))
              .otherwise(COVERAGE_TARGET / F.greatest("_p", F.lit(COVERAGE_TARGET))))
    if method == "platt":
        scale = clip(COVERAGE_TARGET / F.greatest("_p", F.lit(0.01)), 0.5, 2.0)
    else:
        scale = clip(factor, 0.5, 3.0)
    return sized(p.select(*keys, scale.alias("scale")), "scale")


def apply_interval_scale(df: DataFrame) -> DataFrame:
    mid, half = (F.col("q_lo") + F.col("q_hi")) / 2, (F.col("q_hi") - F.col("q_lo")) / 2 * F.col("scale")
    return df.withColumns({"lo": mid - half, "hi": mid + half})


def tempered(logit: Column, temperature: Column) -> Column:
    return 1 / (1 + F.exp(-logit / temperature))


def _nll(positive: Column, logit: Column, t: Column) -> Column:
    p = tempered(logit, t)
    return F.avg(F.when(positive, -F.ln(p + 1e-9)).otherwise(-F.ln(1 - p + 1e-9)))


def fit_temperature(df: DataFrame, keys: list[str], positive: Column, logit: Column) -> DataFrame:
    """Temperature with the least NLL: a coarse grid, then a fine one around its best point.

    Each grid is one aggregation with a column per grid point, so rows are not multiplied.
    """
    def best(frame: DataFrame, points: list[Column]) -> DataFrame:
        a = frame.groupBy(*keys).agg(*[F.struct(_nll(positive, logit, p).alias("nll"), F.min(p).alias("t")).alias(f"_{i}")
                                       for i, p in enumerate(points)])
        return a.select(*keys, F.array_min(F.array(*[F.col(f"_{i}") for i in range(len(points))])).alias("_b"))

    coarse = best(df, [F.lit(0.1) + k * ((10.0 - 0.1) / 33) for k in range(34)])
    around = df.join(sized(coarse.select(*keys, F.col("_b.t").alias("_t0")), "coarse"), keys)
    fine = best(around, [F.greatest(F.col("_t0") - 0.3 + k * 0.02, F.lit(0.1)) for k in range(31)])
    return fine.select(*keys, F.col("_b.t").alias("temperature"), F.col("_b.nll").alias("nll"))


def brier(positive: Column, pred: Column, largest: Column) -> Column:
    p = clip(pred / (largest + 1e-8) * 0.5 + 0.5, 0, 1)
    return F.avg(F.pow(p - positive.cast("double"), 2))


def gaussian_nll(y: Column, mu: Column, lo: Column, hi: Column) -> Column:
    var = F.pow(F.greatest((hi - lo) / 4, F.lit(1e-4)), 2)
    return F.avg(0.5 * F.ln(2 * math.pi * var) + F.pow(y - mu, 2) / (2 * var))


def interval_score(y: Column, lo: Column, hi: Column, alpha: float) -> Column:
    zero = F.lit(0.0)
    return F.avg(hi - lo + 2 / alpha * F.greatest(lo - y, zero) + 2 / alpha * F.greatest(y - hi, zero))


# --- skill and trend -------------------------------------------------------

def class_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """F1 per class, macro F1 and accuracy from one confusion count."""
    m = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    by = (m.select(F.explode(F.array(F.struct(F.col("t").alias("cls"), F.lit(True).alias("is_t")),
                                     F.struct(F.col("p").alias("cls"), F.lit(False).alias("is_t")))).alias("s"), "t", "p", "n")
          .groupBy("s.cls").agg(F.sum(F.when(F.col("s.is_t") & (F.col("t") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"),
                                F.sum("n").alias("both")))
    # truths plus predictions of a class are 2*tp + fp + fn
    f1 = 2.0 * F.col("tp") / F.col("both")
    acc = m.agg(F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)) / F.sum("n")).scalar()
    macro = by.agg(F.avg(f1)).scalar()
    return by.select("cls", F.round(f1, 6).alias("f1"), F.round(macro, 6).alias("macro_f1"), F.round(acc, 6).alias("accuracy"))


def holdout_mape(df: DataFrame, key: str, day: str, value: str, days: int) -> DataFrame:
    """MAPE of the training mean on the last ``days`` of each series."""
    cut = df.groupBy(key).agg(F.date_sub(F.max(day), days).alias("_cut"))
    x = df.join(cut, key)
    mean = x.filter(F.col(day) <= F.col("_cut")).groupBy(key).agg(F.avg(value).alias("_m"))
    err = F.abs((F.col(value) - F.col("_m")) / (F.abs(value) + 1e-8))
    return (x.filter(F.col(day) > F.col("_cut")).join(mean, key).groupBy(key)
            .agg(F.count("*").alias("n"), F.round(F.avg(err), 6).alias("mape")))


def linear_trend(df: DataFrame, keys: list[str], value: str, t: str, min_points: int = 4) -> DataFrame:
    """Slope, r2 and F statistic per key; at least ``min_points`` values."""
    a = df.groupBy(*keys).agg(F.count(value).alias("n"), F.regr_slope(value, t).alias("slope"), F.regr_r2(value, t).alias("r2"))
    return a.filter(F.col("n") >= min_points).withColumn("f", F.col("r2") / F.nullif(1 - F.col("r2"), F.lit(0.0)) * (F.col("n") - 2))


# --- decisions -------------------------------------------------------------

def drift_strategy(psi: Column, ks_p: Column, js: Column) -> Column:
    return (F.when(psi >= 0.25, "feature_substitution").when(ks_p < 0.01, "quantile_recalibration")
            .when(js >= 0.15, "encoding_rebuild").otherwise("none"))


def arm_decision(champion: Column, challenger: Column, days: Column, p: Column, effect: Column, stable: Column,
                 window_days: int = 14) -> Column:
    """Rollback at 10 % worse; wait for the window; promote only when all four gates hold."""
    better = (challenger - champion) / (champion + 1e-8) <= -0.05
    return (F.when(challenger > champion * 1.10, "ROLLBACK").when(days < window_days, "INCONCLUSIVE")
            .when(better & (p < 0.05) & (F.abs(effect) >= 0.20) & stable, "PROMOTE").otherwise("RETAIN_CHAMPION"))


def gain_gate(gain_pct: Column, latency_ratio: Column) -> Column:
    return (F.when((gain_pct > 5) & (latency_ratio <= 1.2), "GAIN_AND_LATENCY_OK")
            .when(gain_pct > 5, "GAIN_OK").otherwise("NO_GAIN"))


def update_verdict(delta: Column, nse: Column, needs_nse: Column) -> Column:
    passes = (delta < 0) & (~needs_nse | (nse >= 0.60))
    return F.when(~passes, "ROLLBACK").when(delta <= -0.10, "FLAG_FOR_AB_TEST").otherwise("SWAP")


def performance_change(df: DataFrame, key: str, value: str, is_baseline: Column, higher: Column) -> DataFrame:
    """Current mean against baseline: a ratio when lower is better, else a relative drop."""
    a = df.groupBy(key).agg(F.avg(F.when(is_baseline, F.col(value))).alias("b"), F.avg(F.when(~is_baseline, F.col(value))).alias("k"))
    b, k = F.col("b"), F.col("k")
    change = F.when(higher, (b - k) / (F.abs(b) + 1e-8)).otherwise(k / (b + 1e-8))
    x = a.withColumns({"direction": F.when(higher, "higher").otherwise("lower"), "change": change})
    hard, soft = F.when(higher, 0.30).otherwise(1.30), F.when(higher, 0.15).otherwise(1.15)
    status = F.when(F.col("change") > hard, "critical").when(F.col("change") > soft, "degraded").otherwise("ok")
    return x.select(key, "direction", F.round("change", 6).alias("change"), status.alias("status"))


def promotion_gates(metrics: DataFrame) -> DataFrame:
    """Gates over (model_id, metric, champion, challenger) in one grouped pass."""
    def at(name: str, side: str) -> Column:
        return F.max(F.when(F.col("metric") == name, F.col(side)))

    a, b = F.col("champion"), F.col("challenger")
    region = F.when(F.col("metric").startswith("region") & (a > 0), (b - a) / F.nullif(a, F.lit(0.0)) <= 0.05).otherwise(True)
    return metrics.groupBy("model_id").agg(
        (at("mae", "challenger") < 0.97 * at("mae", "champion")).alias("mae_gate"), F.bool_and(region).alias("region_gate"),
        (at("mape", "challenger") < 0.98 * at("mape", "champion")).alias("mape_gate"))


def stable_bucket(key: Column, buckets: int) -> Column:
    """Bucket of a key from its MD5, the same on every engine and run."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % buckets


def traffic_arm(key: Column, challenger_pct: int) -> Column:
    return F.when(stable_bucket(key, 100) < challenger_pct, "challenger").otherwise("champion")

"""Drift, two-sample tests, calibration and skill as grouped aggregations.

Every statistic is a mergeable aggregation or built on the exact distributed
ranks of ``ranking``; per group only one small row is left for final arithmetic.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raincourse.session import sized
from raincourse.operators.ranking import cumulative_counts, midranks, quantiles


# --- tails -----------------------------------------------------------------

def normal_upper_tail(z: Column) -> Column:
    """P(Z > z) by the error function series (absolute error below 1e-12 for |z| < 8)."""
    x = F.least(F.abs(z), F.lit(8.0)) / math.sqrt(2)
    start = F.struct(x.alias("t"), x.alias("s"))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(200)), start,
        lambda a, n: F.struct((a.t * 2 * x * x / (2 * n + 1)).alias("t"),
                              (a.s + a.t * 2 * x * x / (2 * n + 1)).alias("s")),
        lambda a: a.s)
    half = 2 / math.sqrt(math.pi) * F.exp(-x * x) * series / 2
    return F.when(z >= 0, F.greatest(0.5 - half, F.lit(0.0))).otherwise(0.5 + half)


def kolmogorov_tail(z: Column) -> Column:
    """Asymptotic two-sample KS p-value for z = d*sqrt(nm/(n+m))."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
                        lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * z * z))
    return F.when(z < 0.2, 1.0).otherwise(F.least(F.greatest(2 * total, F.lit(0.0)), F.lit(1.0)))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series eight steps further on."""
    far, shift = x + 8, F.ln(x)
    for k in range(1, 8):
        shift = shift + F.ln(x + k)
    inverse = 1 / far
    square = inverse * inverse
    series = inverse * (1 / 12 - square * (1 / 360 - square * (1 / 1260 - square * (1 / 1680 - square / 1188))))
    return (far - 0.5) * F.ln(far) - far + 0.5 * math.log(2 * math.pi) + series - shift


def beta_tail(x: Column, a: Column, b: Column, terms: int = 200) -> Column:
    """Regularised incomplete beta by its continued fraction (modified Lentz), of the end that converges fast."""
    turn = x > (a + 1) / (a + b + 2)
    x, a, b = F.when(turn, 1 - x).otherwise(x), F.when(turn, b).otherwise(a), F.when(turn, a).otherwise(b)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x)) / a
    d = 1 / (1 - (a + b) * x / (a + 1))

    def step(s: Column, m: Column) -> Column:
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / (1 + even * s.d), 1 + even / s.c
        d2, c2 = 1 / (1 + odd * d1), 1 + odd / c1
        return F.struct(c2.alias("c"), d2.alias("d"), (s.v * c1 * d1 * c2 * d2).alias("v"))

    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("v"))
    value = front * F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda m: m.cast("double")), start, step, lambda s: s.v)
    tail = F.when(turn, 1 - value).otherwise(value)
    return F.when(x <= 0, F.when(turn, 1.0).otherwise(0.0)).otherwise(tail)


def f_upper_tail(f: Column, d1: Column, d2: Column) -> Column:
    """P(F > f)."""
    return beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def t_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|)."""
    return beta_tail(df / (df + t * t), df / 2, F.lit(0.5))


# --- drift -----------------------------------------------------------------

def quantile_edges(df: DataFrame, keys: list[str], value: str, bins: int = 10, widen: float = 0.0,
                   distinct: bool = False) -> DataFrame:
    """Edges at exact quantiles of the reference rows."""
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    q = quantiles(df, keys, value, names)
    cols = [F.col(n) for n in names]
    edges = F.array(cols[0] - widen, *cols[1:-1], cols[-1] + widen)
    return q.select(*keys, (F.array_distinct(edges) if distinct else edges).alias("edges"))


def width_edges(df: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    lo, hi = F.col("_lo"), F.col("_hi")
    return (df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
            .select(*keys, F.array(*[lo + i * ((hi - lo) / bins) for i in range(bins)], hi).alias("edges")))


def bin_of(x: Column, edges: Column, open_ends: bool = False, closed_top: bool = True) -> Column:
    """1-based bin of x; null outside unless the ends are open."""
    size = F.size(edges)
    b = F.size(F.filter(edges, lambda e: e <= x))
    if open_ends:
        return F.least(F.greatest(b, F.lit(1)), size - 1)
    if closed_top:
        b = F.when(x == F.element_at(edges, -1), size - 1).otherwise(b)
    return F.when((b >= 1) & (b <= size - 1), b)


def two_histograms(df: DataFrame, keys: list[str], value: str, is_ref: Column, edges: DataFrame,
                   bins: int = 10, open_ends: bool = False) -> DataFrame:
    """Bin counts of reference and current rows as arrays, in one aggregation."""
    placed = (df.filter(F.col(value).isNotNull()).join(sized(edges, "edges"), keys)
              .withColumn("_b", bin_of(F.col(value), F.col("edges"), open_ends)).withColumn("_r", is_ref))
    sums = [F.count_if((F.col("_b") == i) & F.col("_r") if side else (F.col("_b") == i) & ~F.col("_r"))
            for side in (True, False) for i in range(1, bins + 1)]
    return placed.groupBy(*keys, F.size("edges").alias("n_edges")).agg(
        F.array(*sums[:bins]).alias("ref"), F.array(*sums[bins:]).alias("cur"),
        F.count_if("_r").alias("n_ref"), F.count_if(~F.col("_r")).alias("n_cur"))


def _shares(counts: str, share) -> Column:
    return F.transform(counts, lambda x: share(x, F.col(f"n_{counts}")))


def _divergence(r: Column, c: Column) -> Column:
    return F.aggregate(F.zip_with(r, c, lambda a, b: (b - a) * F.ln(b / a)), F.lit(0.0), lambda s, x: s + x)


def psi_quantile(df: DataFrame, keys: list[str], value: str, is_ref: Column, bins: int = 10) -> DataFrame:
    """PSI on quantile bins of the reference with widened ends; 1e-6 added to each share."""
    h = two_histograms(df, keys, value, is_ref, quantile_edges(df.filter(is_ref), keys, value, bins, 1e-9), bins)
    share = [_shares(n, lambda x, total: x / total + 1e-6) for n in ("ref", "cur")]
    return h.select(*keys, _divergence(*share).alias("psi"))


def psi_width(df: DataFrame, keys: list[str], value: str, is_ref: Column, bins: int = 10) -> DataFrame:
    """PSI on equal-width bins of the reference with open ends; shares floored at 1e-8."""
    h = two_histograms(df, keys, value, is_ref, width_edges(df.filter(is_ref), keys, value, bins), bins, True)
    share = [_shares(n, lambda x, total: F.greatest(x / (total + 1e-8), F.lit(1e-8))) for n in ("ref", "cur")]
    return h.select(*keys, _divergence(*share).alias("psi"))


def psi_distinct(df: DataFrame, keys: list[str], value: str, is_ref: Column, bins: int = 10) -> DataFrame:
    """PSI on distinct quantile edges; rows outside the edges do not count."""
    edges = quantile_edges(df.filter(is_ref), keys, value, bins, distinct=True)
    h = two_histograms(df, keys, value, is_ref, edges, bins)
    h = h.withColumns({n: F.slice(n, F.lit(1), F.greatest(F.col("n_edges") - 1, F.lit(0))) for n in ("ref", "cur")})
    h = h.withColumns({f"n_{n}": F.aggregate(n, F.lit(0).cast("long"), lambda s, y: s + y) for n in ("ref", "cur")})
    share = [_shares(n, lambda x, total: (x + 1e-6) / total) for n in ("ref", "cur")]
    return h.select(*keys, F.when(F.col("n_edges") < 2, 0.0).otherwise(_divergence(*share)).alias("psi"))


def ks_two_sample(df: DataFrame, keys: list[str], value: str, is_ref: Column) -> DataFrame:
    """KS statistic and asymptotic p-value per key."""
    c = cumulative_counts(df, keys, value, {"r": is_ref.cast("long"), "u": (~is_ref).cast("long")})
    gap = F.abs((F.col("r_before") + F.col("r")) / F.col("r_total") - (F.col("u_before") + F.col("u")) / F.col("u_total"))
    n, m = F.col("_n").cast("double"), F.col("_m").cast("double")
    return (c.groupBy(*keys).agg(F.max(gap).alias("ks"), F.max("r_total").alias("_n"), F.max("u_total").alias("_m"))
            .select(*keys, "ks", kolmogorov_tail(F.col("ks") * F.sqrt(n * m / (n + m))).alias("p_value")))


def js_divergence(counts: DataFrame, keys: list[str], ref: str, cur: str) -> DataFrame:
    """Jensen-Shannon divergence of category counts (one row per category).

    Two aggregations: totals per key, then the sum over categories.
    """
    totals = counts.groupBy(*keys).agg(F.sum(ref).alias("_rt"), F.sum(cur).alias("_ct"))
    p = (F.col(ref) + 1e-9) / (F.col("_rt") + 1e-9)
    q = (F.col(cur) + 1e-9) / (F.col("_ct") + 1e-9)
    m = 0.5 * (p + q)
    return counts.join(totals, keys).groupBy(*keys).agg(
        (0.5 * F.sum(p * F.ln(p / m)) + 0.5 * F.sum(q * F.ln(q / m))).alias("js"))


# --- two arms --------------------------------------------------------------

def arm_moments(df: DataFrame, keys: list[str], value: Column, is_a: Column) -> DataFrame:
    """Count, mean and sample variance of both arms in one pass (no self join)."""
    a, b = F.when(is_a, value), F.when(~is_a, value)
    return df.groupBy(*keys).agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
        F.var_samp(a).alias("var_a"), F.var_samp(b).alias("var_b"))


def welch(moments: DataFrame) -> DataFrame:
    """Welch t and degrees of freedom from ``arm_moments``."""
    ea, eb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    return moments.withColumns({
        "t": (F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt(ea + eb), F.lit(0.0)),
        "df": F.pow(ea + eb, 2) / F.nullif(F.pow(ea, 2) / (F.col("n_a") - 1) + F.pow(eb, 2) / (F.col("n_b") - 1), F.lit(0.0))})


def cohens_d() -> Column:
    """Effect size from the columns of ``arm_moments``."""
    c = F.col
    pooled = F.sqrt(((c("n_a") - 1) * c("var_a") + (c("n_b") - 1) * c("var_b")) / (c("n_a") + c("n_b") - 2))
    return F.when(pooled < 1e-10, 0.0).otherwise((c("mean_a") - c("mean_b")) / F.nullif(pooled, F.lit(0.0)))


def mann_whitney(df: DataFrame, keys: list[str], value: str, is_a: Column) -> DataFrame:
    """U of arm a and the one-sided (a greater) tie-corrected normal p-value."""
    r = midranks(df, keys, value, {"a": is_a.cast("long")})
    t = F.col("n").cast("double")
    s = r.groupBy(*keys).agg(F.sum(F.col("a") * F.col("midrank")).alias("_ra"), F.sum(t * t * t - t).alias("_ties"),
                             F.max("a_total").cast("double").alias("n_a"), F.max("n_total").cast("double").alias("_n"))
    n, a = F.col("_n"), F.col("n_a")
    b = n - a
    u = F.col("_ra") - a * (a + 1) / 2
    sd = F.sqrt(a * b / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    return (s.withColumn("u", u).withColumn("z", (F.col("u") - a * b / 2 - 0.5) / F.nullif(sd, F.lit(0.0)))
            .select(*keys, "u", "z", normal_upper_tail(F.col("z")).alias("p_value")))


# --- calibration and skill -------------------------------------------------

def calibration_bins(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Means of truth and prediction per equal-width prediction bin; the top edge is open."""
    edges = width_edges(df, keys, "y_pred", bins)
    placed = df.join(sized(edges, "edges"), keys).withColumn("bin", bin_of(F.col("y_pred"), F.col("edges"), closed_top=False))
    mid = (F.element_at("edges", F.col("bin")) + F.element_at("edges", F.col("bin") + 1)) / 2
    return (placed.filter(F.col("bin").isNotNull()).withColumn("midpoint", mid).groupBy(*keys, "bin")
            .agg(F.min("midpoint").alias("midpoint"), F.avg("y_true").alias("truth"),
                 F.avg("y_pred").alias("predicted"), F.count("*").alias("n")))


def calibration_error(df: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """ECE and MCE: weighted mean and maximum of the relative bin bias, capped at 1."""
    total = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    bias = F.abs(F.col("truth") - F.col("predicted")) / (F.abs("predicted") + 1e-8)
    return (calibration_bins(df, keys, bins).join(total, keys).groupBy(*keys)
            .agg(F.least(F.sum(F.col("n") / F.col("_n") * bias), F.lit(1.0)).alias("ece"),
                 F.least(F.max(bias), F.lit(1.0)).alias("mce")))


def coverage(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(((y >= lo) & (y <= hi)).cast("double"))


def mean_width(y: Column, lo: Column, hi: Column) -> Column:
    return F.avg(hi - lo) / (F.max(y) - F.min(y) + 1e-8)


def skill(obs: Column, sim: Column) -> dict[str, Column]:
    """NSE, KGE, PBIAS, RMSE, MAE and R2 as aggregates of one pass."""
    o, s = F.when(sim.isNotNull(), obs), F.when(obs.isNotNull(), sim)
    err2 = F.avg(F.pow(s - o, 2))
    spread = F.var_pop(o) * F.count(o) + 1e-9
    r = F.corr(o, s)
    alpha = F.stddev_pop(s) / (F.stddev_pop(o) + 1e-9)
    beta = F.avg(s) / (F.avg(o) + 1e-9)
    return {"nse": 1 - F.sum(F.pow(s - o, 2)) / spread, "kge": 1 - F.sqrt(F.pow(r - 1, 2) + F.pow(alpha - 1, 2) + F.pow(beta - 1, 2)),
            "pbias": 100 * F.sum(s - o) / (F.sum(o) + 1e-9), "rmse": F.sqrt(err2), "mae": F.avg(F.abs(s - o)), "r2": r * r}

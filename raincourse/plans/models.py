"""Drift, two-arm tests, calibration, skill and the decisions built on them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raincourse.operators import learning as L
from raincourse.operators import statistics as S
from raincourse.operators.ordered import rolling_rows
from raincourse.operators.ranking import cumulative_counts, quantiles
from raincourse.operators.rollup import clip, latest_per_key, level_of, rank_of, worst
from raincourse.registry import query
from raincourse.views import SQL_VIEWS, Views

c = F.col


def ref():
    return c("is_ref")


DAY = 86400.0

# --- drift -----------------------------------------------------------------
SQL_VIEWS["q_edges"] = """SELECT idx, quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS e FROM feature WHERE is_ref GROUP BY 1"""
SQL_VIEWS["q_bins"] = """SELECT f.idx, is_ref, CASE WHEN x = w[11] THEN 10 ELSE len(list_filter(w, lambda q: q <= x)) END AS b
    FROM feature f JOIN (SELECT idx, [e[1] - 1e-9] || e[2:10] || [e[11] + 1e-9] AS w FROM q_edges) USING (idx)"""
SQL_VIEWS["w_bins"] = """SELECT f.idx, is_ref, least(greatest(len(list_filter(w, lambda q: q <= x)), 1), 10) AS b FROM feature f JOIN (
    SELECT idx, list_transform(range(0, 10), lambda k: lo + k * ((hi - lo) / 10)) || [hi] AS w FROM (SELECT idx, min(x) AS lo, max(x) AS hi FROM feature WHERE is_ref GROUP BY 1)) USING (idx)"""
SQL_VIEWS["psi_q"] = """SELECT idx, sum((cs - rs) * ln(cs / rs)) AS psi FROM (SELECT idx, k, count(*) FILTER (WHERE b = k AND is_ref) / count(*) FILTER (WHERE is_ref) + 1e-6 AS rs,
    count(*) FILTER (WHERE b = k AND NOT is_ref) / count(*) FILTER (WHERE NOT is_ref) + 1e-6 AS cs FROM q_bins CROSS JOIN range(1, 11) t(k) GROUP BY 1, 2) GROUP BY 1"""
SQL_VIEWS["psi_d"] = """SELECT idx, sum((cs - rs) * ln(cs / rs)) AS psi FROM (SELECT idx, k, (r + 1e-6) / sum(r) OVER (PARTITION BY idx) AS rs, (u + 1e-6) / sum(u) OVER (PARTITION BY idx) AS cs FROM (
    SELECT idx, k, count(*) FILTER (WHERE b = k AND is_ref) AS r, count(*) FILTER (WHERE b = k AND NOT is_ref) AS u FROM (
      SELECT f.idx, is_ref, CASE WHEN x = e[11] THEN 10 ELSE len(list_filter(e, lambda q: q <= x)) END AS b FROM feature f JOIN q_edges USING (idx)) CROSS JOIN range(1, 11) t(k) GROUP BY 1, 2)) GROUP BY 1"""
SQL_VIEWS["ks"] = """SELECT idx, ks, CASE WHEN z < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * z * z))), 0.0), 1.0) END AS p
    FROM (SELECT idx, ks, ks * sqrt(n * m / (n + m)) AS z FROM (SELECT idx, max(abs(f1 - f2)) AS ks, max(n)::DOUBLE AS n, max(m)::DOUBLE AS m FROM (
      SELECT idx, sum(is_ref::INT) OVER w / sum(is_ref::INT) OVER a AS f1, sum((NOT is_ref)::INT) OVER w / sum((NOT is_ref)::INT) OVER a AS f2, sum(is_ref::INT) OVER a AS n, sum((NOT is_ref)::INT) OVER a AS m
      FROM feature WINDOW w AS (PARTITION BY idx ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY idx)) GROUP BY 1))"""


def tail_sql(rows: str, keys: str, value: str, extra: str = "") -> str:
    """SQL that ends with ``SELECT keys, value`` where ``p`` is the incomplete beta of x, a, b in ``rows``."""
    return f"""WITH RECURSIVE src AS ({rows}),
    ends AS (SELECT *, x0 > (a0 + 1) / (a0 + b0 + 2) AS turn FROM src),
    arg AS (SELECT *, CASE WHEN turn THEN 1 - x0 ELSE x0 END AS x, CASE WHEN turn THEN b0 ELSE a0 END AS a, CASE WHEN turn THEN a0 ELSE b0 END AS b FROM ends),
    f AS (SELECT {keys}, 0 AS m, 1.0::DOUBLE AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS v, x, a, b, turn FROM arg
      UNION ALL SELECT {keys}, m, c2, d2, v * c1 * d1 * c2 * d2, x, a, b, turn FROM (SELECT *, 1 / (1 + odd * d1) AS d2, 1 + odd / c1 AS c2 FROM (SELECT *, 1 / (1 + even * d) AS d1, 1 + even / c AS c1 FROM (
        SELECT {keys}, m + 1 AS m, c, d, v, x, a, b, turn, (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)) AS even, -(a + m + 1) * (a + b + m + 1) * x / ((a + 2 * m + 2) * (a + 2 * m + 3)) AS odd FROM f WHERE m < 200))))
    SELECT {keys}, {value}{extra} FROM (SELECT {keys}, CASE WHEN turn THEN 1 - q ELSE q END AS p FROM (SELECT *, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) / a * v AS q FROM f WHERE m = 200))"""


@query("a31_psi_quantile", "SELECT idx, round(psi, 6) AS psi FROM psi_q")
def a31(v):
    return S.psi_quantile(v.feature, ["idx"], "x", ref()).select("idx", F.round("psi", 6).alias("psi"))


@query("a32_psi_width", """SELECT idx, round(sum((cs - rs) * ln(cs / rs)), 6) AS psi FROM (SELECT idx, k, greatest(count(*) FILTER (WHERE b = k AND is_ref) / (count(*) FILTER (WHERE is_ref) + 1e-8), 1e-8) AS rs,
    greatest(count(*) FILTER (WHERE b = k AND NOT is_ref) / (count(*) FILTER (WHERE NOT is_ref) + 1e-8), 1e-8) AS cs FROM w_bins CROSS JOIN range(1, 11) t(k) GROUP BY 1, 2) GROUP BY 1""")
def a32(v):
    return S.psi_width(v.feature, ["idx"], "x", ref()).select("idx", F.round("psi", 6).alias("psi"))


@query("a33_psi_distinct_edges", "SELECT idx, round(psi, 6) AS psi FROM psi_d")
def a33(v):
    return S.psi_distinct(v.feature, ["idx"], "x", ref()).select("idx", F.round("psi", 6).alias("psi"))


@query("a34_ks_two_sample", "SELECT idx, round(ks, 6) AS ks, round(p, 6) AS p_value FROM ks")
def a34(v):
    return S.ks_two_sample(v.feature, ["idx"], "x", ref()).select("idx", F.round("ks", 6).alias("ks"), F.round("p_value", 6).alias("p_value"))


CUT = "2024-01-24"
SQL_VIEWS["cats"] = f"""SELECT station_id % 10 AS feature, variable AS category, count(*) FILTER (WHERE ts < TIMESTAMP '{CUT}') AS ref, count(*) FILTER (WHERE ts >= TIMESTAMP '{CUT}') AS cur FROM obs GROUP BY 1, 2"""
SQL_VIEWS["js"] = """SELECT feature, 0.5 * sum(p * ln(p / (0.5 * (p + q)))) + 0.5 * sum(q * ln(q / (0.5 * (p + q)))) AS js FROM (
    SELECT feature, (ref + 1e-9) / (sum(ref) OVER w + 1e-9) AS p, (cur + 1e-9) / (sum(cur) OVER w + 1e-9) AS q FROM cats WINDOW w AS (PARTITION BY feature)) GROUP BY 1"""


def cats(v: Views) -> DataFrame:
    """Category counts before and after the cut, by conditional aggregation."""
    old = c("ts") < F.lit(CUT).cast("timestamp")
    return v.obs.groupBy((c("station_id") % 10).alias("feature"), c("variable").alias("category")).agg(
        F.count_if(old).alias("ref"), F.count_if(~old).alias("cur"))


@query("a35_js_divergence", "SELECT feature, round(js, 8) AS js FROM js")
def a35(v):
    return S.js_divergence(cats(v), ["feature"], "ref", "cur").select("feature", F.round("js", 8).alias("js"))


@query("j20_category_outer_merge", f"""SELECT coalesce(r.k, u.k) AS category, coalesce(r.n, 0) AS ref, coalesce(u.n, 0) AS cur FROM (SELECT variable || '_' || station_id AS k, count(*) AS n FROM obs WHERE ts < TIMESTAMP '{CUT}' GROUP BY 1) r
    FULL OUTER JOIN (SELECT variable || '_' || station_id AS k, count(*) AS n FROM obs WHERE ts >= TIMESTAMP '{CUT}' GROUP BY 1) u ON r.k = u.k""")
def j20(v):
    """Counts of both windows by category; a category missing on one side counts zero."""
    name = F.concat_ws("_", "variable", "station_id").alias("category")
    r = v.obs.filter(c("ts") < F.lit(CUT).cast("timestamp")).groupBy(name).agg(F.count("*").alias("ref"))
    u = v.obs.filter(c("ts") >= F.lit(CUT).cast("timestamp")).groupBy(name).agg(F.count("*").alias("cur"))
    return r.join(u, "category", "full_outer").select("category", F.coalesce("ref", F.lit(0)).alias("ref"), F.coalesce("cur", F.lit(0)).alias("cur"))


@query("u04_category_union", f"""SELECT variable || '_' || station_id AS category FROM obs WHERE ts < TIMESTAMP '{CUT}' UNION SELECT variable || '_' || station_id FROM obs WHERE ts >= TIMESTAMP '{CUT}'""")
def u04(v):
    o = v.obs.select("ts", F.concat_ws("_", "variable", "station_id").alias("category"))
    return (o.filter(c("ts") < F.lit(CUT).cast("timestamp")).select("category")
            .union(o.filter(c("ts") >= F.lit(CUT).cast("timestamp")).select("category")).distinct())


SQL_VIEWS["drift"] = """SELECT idx, psi, p, CASE WHEN psi >= 0.25 THEN 'critical' WHEN psi >= 0.2 OR p < 0.05 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT idx, round(psi, 6) AS psi, round(p, 6) AS p FROM psi_d JOIN ks USING (idx))"""
DRIFT_LEVELS = ["ok", "warning", "degraded", "critical"]


def drift(v: Views) -> DataFrame:
    """PSI and KS per feature with status ok, warning or critical."""
    psi = S.psi_distinct(v.feature, ["idx"], "x", ref()).select("idx", F.round("psi", 6).alias("psi"))
    ks = S.ks_two_sample(v.feature, ["idx"], "x", ref()).select("idx", F.round("p_value", 6).alias("p"))
    status = F.when(c("psi") >= 0.25, "critical").when((c("psi") >= 0.2) | (c("p") < 0.05), "warning").otherwise("ok")
    return psi.join(ks, "idx").withColumn("status", status)


@query("a36_drift_status", """SELECT idx % 4 AS model, ['ok','warning','degraded','critical'][max(list_position(['ok','warning','degraded','critical'], status))] AS overall, count(*) FILTER (WHERE status <> 'ok') AS drifted,
    coalesce(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx) FILTER (WHERE status <> 'ok'), '') AS features FROM drift GROUP BY 1""")
def a36(v):
    listed = F.array_sort(F.collect_list(F.when(c("status") != "ok", c("idx"))))
    return drift(v).groupBy((c("idx") % 4).alias("model")).agg(
        worst(c("status"), DRIFT_LEVELS).alias("overall"), F.count_if(c("status") != "ok").alias("drifted"),
        F.array_join(listed, ",").alias("features"))


@query("a37_type_choice", """SELECT col, n, CASE WHEN is_text OR n <= 20 THEN 'categorical' ELSE 'continuous' END AS kind FROM (SELECT unnest(['variable','station_id','value','aux']) AS col, unnest([count(DISTINCT variable), count(DISTINCT station_id), count(DISTINCT value), count(DISTINCT aux)]) AS n, unnest([true, false, false, false]) AS is_text FROM obs)""")
def a37(v):
    return L.column_kinds(v.obs.select("variable", "station_id", "value", "aux"))


@query("a66_max_psi_retrain", "SELECT idx % 4 AS model, round(max(psi), 6) AS max_psi FROM psi_q GROUP BY 1 HAVING max(psi) > 0.2")
def a66(v):
    """Report per model as a map feature -> PSI; the map is exploded and its maximum tested."""
    p = S.psi_quantile(v.feature, ["idx"], "x", ref())
    report = p.groupBy((c("idx") % 4).alias("model")).agg(F.map_from_entries(F.collect_list(F.struct("idx", "psi"))).alias("features"))
    return (report.select("model", F.explode("features").alias("f", "psi")).groupBy("model")
            .agg(F.max("psi").alias("m")).filter("m > 0.2").select("model", F.round("m", 6).alias("max_psi")))


@query("g16_retraining_decision", """SELECT count(*) FILTER (WHERE psi > 0.2) AS psi_drifted, count(*) FILTER (WHERE p < 0.05) AS ks_drifted, round(max(psi), 6) AS max_psi, count(*) FILTER (WHERE psi > 0.2 OR p < 0.05) > 0 AS should_retrain,
    CASE WHEN max(psi) > 0.5 THEN 'critical' WHEN max(psi) > 0.2 THEN 'moderate' ELSE 'none' END AS severity FROM psi_q JOIN ks USING (idx)""")
def g16(v):
    j = S.psi_quantile(v.feature, ["idx"], "x", ref()).join(S.ks_two_sample(v.feature, ["idx"], "x", ref()), "idx")
    top = F.max("psi")
    return j.agg(F.count_if(c("psi") > 0.2).alias("psi_drifted"), F.count_if(c("p_value") < 0.05).alias("ks_drifted"),
                 F.round(top, 6).alias("max_psi"), (F.count_if((c("psi") > 0.2) | (c("p_value") < 0.05)) > 0).alias("should_retrain"),
                 F.when(top > 0.5, "critical").when(top > 0.2, "moderate").otherwise("none").alias("severity"))


SQL_VIEWS["plan"] = """SELECT idx, psi, p, CASE WHEN psi >= 0.25 THEN 'feature_substitution' WHEN p < 0.01 THEN 'quantile_recalibration' ELSE 'none' END AS strategy FROM drift WHERE status <> 'ok'"""


@query("g15_drift_response_plan", "SELECT idx, psi, p, strategy FROM plan")
def g15(v):
    return drift(v).filter("status <> 'ok'").select("idx", "psi", "p", L.drift_strategy(c("psi"), c("p"), F.lit(None).cast("double")).alias("strategy"))


@query("k03_drifted_feature_order", "SELECT row_number() OVER (ORDER BY -coalesce(psi, 0), coalesce(p, 1.0), idx) AS pos, idx, psi, p FROM drift WHERE status <> 'ok'")
def k03(v):
    """One row per feature: the window holds schema width, not data."""
    w = Window.orderBy(-F.coalesce("psi", F.lit(0.0)), F.coalesce("p", F.lit(1.0)), "idx")
    return drift(v).filter("status <> 'ok'").select(F.row_number().over(w).cast("long").alias("pos"), "idx", "psi", "p")


@query("a67_worst_urgency", """SELECT model_id, CASE max(CASE WHEN m > 260 THEN 2 WHEN m > 200 THEN 1 ELSE 0 END) WHEN 2 THEN 'CRITICAL' WHEN 1 THEN 'WARNING' ELSE 'NOMINAL' END AS urgency FROM (
    SELECT model_id, CAST(ts AS DATE) AS day, max(error) AS m FROM err GROUP BY 1, 2) WHERE day >= (SELECT CAST(max(ts) AS DATE) FROM err) - 7 GROUP BY 1""")
def a67(v):
    """Daily reports of the last 7 days (cut at the newest day of the data)."""
    e = v.err
    last = e.agg(F.max(F.to_date("ts"))).scalar()
    daily = e.filter(F.to_date("ts") >= F.date_sub(last, 7)).groupBy("model_id", F.to_date("ts").alias("day")).agg(F.max("error").alias("m"))
    level = F.when(c("m") > 260, "CRITICAL").when(c("m") > 200, "WARNING").otherwise("NOMINAL")
    return daily.groupBy("model_id").agg(worst(level, ["NOMINAL", "WARNING", "CRITICAL"]).alias("urgency"))


@query("a68_frequency_encoding", "SELECT variable, round(count(*) / (SELECT count(*) FROM obs WHERE ts >= (SELECT max(ts) FROM obs) - INTERVAL 20 DAY), 8) AS freq FROM obs WHERE ts >= (SELECT max(ts) FROM obs) - INTERVAL 20 DAY GROUP BY 1")
def a68(v):
    return L.frequency_encoding(v.obs, "variable", "ts", 20)


@query("g14_quantile_recalibration", """SELECT vec_id, f.idx, round(CASE WHEN x <= e[1] THEN 0.0 WHEN x >= e[11] THEN 1.0 ELSE (b - 1 + (x - e[b]) / nullif(e[b + 1] - e[b], 0)) / 10 END, 6) AS p
    FROM (SELECT f.*, e, CAST(len(list_filter(e, lambda q: q <= x)) AS INTEGER) AS b FROM feature f JOIN q_edges USING (idx)) f""")
def g14(v):
    edges = S.quantile_edges(v.feature.filter(ref()), ["idx"], "x", 10)
    return v.feature.join(edges, "idx").select("vec_id", "idx", F.round(L.knot_position(c("x"), c("edges")), 6).alias("p"))


# --- two arms --------------------------------------------------------------
SQL_VIEWS["arms"] = """SELECT model_id, count(*) FILTER (WHERE role = 'champion') AS na, count(*) FILTER (WHERE role <> 'champion') AS nb, avg(error) FILTER (WHERE role = 'champion') AS ma, avg(error) FILTER (WHERE role <> 'champion') AS mb,
    var_samp(error) FILTER (WHERE role = 'champion') AS va, var_samp(error) FILTER (WHERE role <> 'champion') AS vb, sqrt(avg(error * error) FILTER (WHERE role = 'champion')) AS ra, sqrt(avg(error * error) FILTER (WHERE role <> 'champion')) AS rb FROM err GROUP BY 1"""
SQL_VIEWS["sq_arms"] = """SELECT model_id, count(*) FILTER (WHERE role = 'champion') AS na, count(*) FILTER (WHERE role <> 'champion') AS nb, avg(error * error) FILTER (WHERE role = 'champion') AS ma, avg(error * error) FILTER (WHERE role <> 'champion') AS mb,
    var_samp(error * error) FILTER (WHERE role = 'champion') AS va, var_samp(error * error) FILTER (WHERE role <> 'champion') AS vb FROM err GROUP BY 1"""


def champ():
    return c("role") == "champion"


@query("j16_arm_pairing", "SELECT model_id, na AS n_champion, nb AS n_challenger, round(ma, 6) AS champion_mae, round(mb, 6) AS challenger_mae, round((mb - ma) / (ma + 1e-8) * 100, 6) AS delta_pct FROM arms")
def j16(v):
    m = S.arm_moments(v.err, ["model_id"], c("error"), champ())
    return m.select("model_id", c("n_a").alias("n_champion"), c("n_b").alias("n_challenger"), F.round("mean_a", 6).alias("champion_mae"),
                    F.round("mean_b", 6).alias("challenger_mae"), F.round((c("mean_b") - c("mean_a")) / (c("mean_a") + 1e-8) * 100, 6).alias("delta_pct"))


@query("a40_welch_test", """SELECT model_id, round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df,
    round((sqrt(ma) - sqrt(mb)) / (sqrt(ma) + 1e-8) * 100, 6) AS rmse_gain_pct, na >= 100 AND nb >= 100 AS enough FROM sq_arms""")
def a40(v):
    w = S.welch(S.arm_moments(v.err, ["model_id"], c("error") * c("error"), champ()))
    gain = (F.sqrt("mean_a") - F.sqrt("mean_b")) / (F.sqrt("mean_a") + 1e-8) * 100
    return w.select("model_id", F.round("t", 6).alias("t"), F.round("df", 4).alias("df"), F.round(gain, 6).alias("rmse_gain_pct"),
                    ((c("n_a") >= 100) & (c("n_b") >= 100)).alias("enough"))


@query("a40_welch_p_value", tail_sql("""SELECT model_id, df / (df + t * t) AS x0, df / 2 AS a0, 0.5 AS b0 FROM (SELECT model_id, (ma - mb) / sqrt(va / na + vb / nb) AS t, pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)) AS df FROM sq_arms)""", "model_id", "round(p, 6) AS p_value"))
def a40p(v):
    """Two-sided p of the Welch test."""
    w = S.welch(S.arm_moments(v.err, ["model_id"], c("error") * c("error"), champ()))
    return w.select("model_id", F.round(S.t_two_sided(c("t"), c("df")), 6).alias("p_value"))


SQL_VIEWS["mwu"] = """SELECT model_id, u, (u - na * nb / 2 - 0.5) / sqrt(na * nb / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM (
    SELECT model_id, ra - na * (na + 1) / 2 AS u, na, n - na AS nb, n, ties FROM (
    SELECT model_id, sum(champ * mid) AS ra, sum(champ)::DOUBLE AS na, sum(k)::DOUBLE AS n, sum(k * k * k - k) AS ties FROM (
      SELECT model_id, champ, k, sum(k) OVER (PARTITION BY model_id ORDER BY error ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k + (k + 1) / 2 AS mid FROM (
        SELECT model_id, error, count(*) FILTER (WHERE role = 'champion') AS champ, count(*)::DOUBLE AS k FROM err GROUP BY 1, 2)) GROUP BY 1))"""
# the error function series in closed form: sum 2^n x^(2n+1) / (2n+1)!!
SQL_ERF_HALF = """(1 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(0, 201), lambda n: exp(n * ln(2.0) + (2 * n + 1) * ln(greatest(abs(z), 1e-300) / sqrt(2.0)) - (lgamma(2.0 * n + 2) - n * ln(2.0) - lgamma(n + 1.0))))))"""


@query("a41_mann_whitney", f"SELECT model_id, u, round(z, 6) AS z, round(CASE WHEN z >= 0 THEN greatest(0.5 - {SQL_ERF_HALF}, 0.0) ELSE 0.5 + {SQL_ERF_HALF} END, 6) AS p_value FROM mwu")
def a41(v):
    return S.mann_whitney(v.err, ["model_id"], "error", champ()).select(
        "model_id", "u", F.round("z", 6).alias("z"), F.round("p_value", 6).alias("p_value"))


SQL_VIEWS["cohen"] = "SELECT model_id, (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM arms"


@query("a42_cohens_d", "SELECT model_id, round(d, 6) AS d FROM cohen")
def a42(v):
    return S.arm_moments(v.err, ["model_id"], c("error"), champ()).select("model_id", F.round(S.cohens_d(), 6).alias("d"))


LAT = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query("a43_latency_quantiles", """SELECT model_id, role, round(q[1], 6) AS p50, round(q[2], 6) AS p95, round(q[3], 6) AS p99, n FROM (SELECT model_id, role, quantile_cont(error, [0.5, 0.95, 0.99]) AS q, count(*) AS n FROM err GROUP BY 1, 2)""")
def a43(v):
    q = quantiles(v.err, ["model_id", "role"], "error", LAT)
    n = v.err.groupBy("model_id", "role").agg(F.count("*").alias("n"))
    return q.join(n, ["model_id", "role"]).select("model_id", "role", *[F.round(p, 6).alias(p) for p in LAT], "n")


SQL_VIEWS["stability"] = """SELECT model_id, role, stddev_pop(m) AS s FROM (SELECT model_id, role, avg(error) OVER (PARTITION BY model_id, role ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS m FROM err) GROUP BY 1, 2"""


def stability(v: Views) -> DataFrame:
    """Spread of rolling 7-row means; an arm is cut into blocks of rows."""
    r = rolling_rows(v.err, ["model_id", "role"], ["ts", "event_id"], 6, DAY,
                     lambda w: {"m": F.avg("error").over(w.rowsBetween(-6, 0))})
    return r.groupBy("model_id", "role").agg(F.stddev_pop("m").alias("s"))


@query("w16_rolling_stability", """SELECT model_id, round(max(s) FILTER (WHERE role = 'champion'), 6) AS champion_std, round(max(s) FILTER (WHERE role <> 'champion'), 6) AS challenger_std,
    max(s) FILTER (WHERE role <> 'champion') < 1.2 * max(s) FILTER (WHERE role = 'champion') AS stable FROM stability GROUP BY 1""")
def w16(v):
    a, b = F.max(F.when(champ(), c("s"))), F.max(F.when(~champ(), c("s")))
    return stability(v).groupBy("model_id").agg(F.round(a, 6).alias("champion_std"), F.round(b, 6).alias("challenger_std"), (b < 1.2 * a).alias("stable"))


@query("a44_promotion_decision", f"""SELECT model_id, CASE WHEN mb > ma * 1.10 THEN 'ROLLBACK' WHEN days < 14 THEN 'INCONCLUSIVE' WHEN (mb - ma) / (ma + 1e-8) <= -0.05 AND p < 0.05 AND abs(d) >= 0.20 AND st THEN 'PROMOTE' ELSE 'RETAIN_CHAMPION' END AS decision,
    CASE WHEN gain > 5 AND lat <= 1.2 THEN 'GAIN_AND_LATENCY_OK' WHEN gain > 5 THEN 'GAIN_OK' ELSE 'NO_GAIN' END AS gate
    FROM (SELECT a.*, m.p, cohen.d, s.st, t.days, l.lat, (ra - rb) / (ra + 1e-8) * 100 AS gain FROM arms a JOIN cohen USING (model_id)
      JOIN (SELECT model_id, CASE WHEN z >= 0 THEN greatest(0.5 - {SQL_ERF_HALF}, 0.0) ELSE 0.5 + {SQL_ERF_HALF} END AS p FROM mwu) m USING (model_id)
      JOIN (SELECT model_id, max(s) FILTER (WHERE role <> 'champion') < 1.2 * max(s) FILTER (WHERE role = 'champion') AS st FROM stability GROUP BY 1) s USING (model_id)
      JOIN (SELECT model_id, CAST(max(ts) AS DATE) - CAST(min(ts) AS DATE) AS days FROM err GROUP BY 1) t USING (model_id)
      JOIN (SELECT model_id, quantile_cont(error, 0.99) FILTER (WHERE role <> 'champion') / (quantile_cont(error, 0.99) FILTER (WHERE role = 'champion') + 1e-3) AS lat FROM err GROUP BY 1) l USING (model_id))""")
def a44(v):
    e = v.err
    m = S.arm_moments(e, ["model_id"], c("error"), champ()).withColumn("d", S.cohens_d())
    rms = e.groupBy("model_id").agg(F.sqrt(F.avg(F.when(champ(), c("error") * c("error")))).alias("ra"), F.sqrt(F.avg(F.when(~champ(), c("error") * c("error")))).alias("rb"),
                                    F.datediff(F.max("ts"), F.min("ts")).alias("days"))
    st = stability(v).groupBy("model_id").agg((F.max(F.when(~champ(), c("s"))) < 1.2 * F.max(F.when(champ(), c("s")))).alias("stable"))
    lat = quantiles(e, ["model_id", "role"], "error", {"p99": 0.99}).groupBy("model_id").agg(
        (F.max(F.when(~champ(), c("p99"))) / (F.max(F.when(champ(), c("p99"))) + 1e-3)).alias("lat"))
    j = reduce(lambda x, y: x.join(y, "model_id"), [m, rms, st, lat, S.mann_whitney(e, ["model_id"], "error", champ())])
    return j.select("model_id", L.arm_decision(c("mean_a"), c("mean_b"), c("days"), c("p_value"), c("d"), c("stable")).alias("decision"),
                    L.gain_gate((c("ra") - c("rb")) / (c("ra") + 1e-8) * 100, c("lat")).alias("gate"))


SQL_VIEWS["rounds"] = """SELECT model_id, CAST(ts AS DATE) AS day, avg(error) FILTER (WHERE role = 'champion') AS a, avg(error) FILTER (WHERE role <> 'champion') AS b FROM err GROUP BY 1, 2"""


def rounds(v: Views) -> DataFrame:
    return v.err.groupBy("model_id", F.to_date("ts").alias("day")).agg(
        F.avg(F.when(champ(), c("error"))).alias("a"), F.avg(F.when(~champ(), c("error"))).alias("b"))


@query("a45_win_rate", "SELECT model_id, round(avg(CASE WHEN b < a THEN 1.0 ELSE 0.0 END), 6) AS win_rate, avg(CASE WHEN b < a THEN 1.0 ELSE 0.0 END) >= 0.6 AS promote FROM rounds WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def a45(v):
    rate = F.avg((c("b") < c("a")).cast("double"))
    return rounds(v).filter("a is not null and b is not null").groupBy("model_id").agg(F.round(rate, 6).alias("win_rate"), (rate >= 0.6).alias("promote"))


@query("a74_ab_day_summary", """SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS tests, count(*) FILTER (WHERE b > a * 1.1) AS rollbacks, count(*) FILTER (WHERE b <= a * 0.95) AS promotions, count(*) FILTER (WHERE NOT (b > a * 1.1) AND NOT (b <= a * 0.95)) AS inconclusive, sum(n)::BIGINT AS errors
    FROM rounds JOIN (SELECT model_id, CAST(ts AS DATE) AS day, count(*) AS n FROM err GROUP BY 1, 2) USING (model_id, day) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def a74(v):
    """Tests per decision and day; the role means arrive as a map and are exploded by role."""
    day = F.to_date("ts").alias("day")
    r = rounds(v).filter("a is not null and b is not null")
    n = v.err.groupBy("model_id", day).agg(F.count("*").alias("n"))
    d = F.when(c("b") > c("a") * 1.1, "ROLLBACK").when(c("b") <= c("a") * 0.95, "PROMOTE").otherwise("INCONCLUSIVE")
    j = r.join(n, ["model_id", "day"]).withColumn("decision", d)
    return j.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("tests"), F.count_if(c("decision") == "ROLLBACK").alias("rollbacks"), F.count_if(c("decision") == "PROMOTE").alias("promotions"),
        F.count_if(c("decision") == "INCONCLUSIVE").alias("inconclusive"), F.sum("n").alias("errors"))


@query("a26_error_by_region", """SELECT model_id, coalesce(CAST(region_id AS VARCHAR), 'all') AS region, round(avg(abs(error)) FILTER (WHERE role = 'champion'), 6) AS champion, round(avg(abs(error)) FILTER (WHERE role <> 'champion'), 6) AS challenger
    FROM err GROUP BY GROUPING SETS ((model_id, region_id), (model_id))""")
def a26(v):
    e = v.err
    return e.groupingSets([["model_id", "region_id"], ["model_id"]], "model_id", "region_id").agg(
        F.round(F.avg(F.when(champ(), F.abs("error"))), 6).alias("champion"), F.round(F.avg(F.when(~champ(), F.abs("error"))), 6).alias("challenger")).select(
        "model_id", F.coalesce(c("region_id").cast("string"), F.lit("all")).alias("region"), "champion", "challenger")


@query("a27_fairness_gate", """SELECT model_id, max(g) < max(k) * 0.97 AS mae_gate, bool_and((r - k) / k <= 0.05) AS fair, max(g) < max(k) * 0.97 AND bool_and((r - k) / k <= 0.05) AS promoted FROM (
    SELECT model_id, region_id, avg(abs(error)) AS r, any_value(k) AS k, any_value(g) AS g FROM err JOIN (SELECT model_id, avg(abs(error)) FILTER (WHERE role = 'champion') AS k, avg(abs(error)) FILTER (WHERE role <> 'champion') AS g FROM err GROUP BY 1) USING (model_id)
    WHERE role <> 'champion' GROUP BY 1, 2) GROUP BY 1""")
def a27(v):
    """Sums and counts per (model, region) are enough for both levels: one shuffle of the errors."""
    s = v.err.groupBy("model_id", "region_id").agg(
        *[f(F.when(k, F.abs("error"))).alias(n) for k, t in ((champ(), "a"), (~champ(), "b")) for f, n in ((F.sum, f"s{t}"), (F.count, f"n{t}"))])
    w = Window.partitionBy("model_id")
    x = s.withColumns({"k": F.sum("sa").over(w) / F.sum("na").over(w), "g": F.sum("sb").over(w) / F.sum("nb").over(w)}).filter("nb > 0")
    gate, fair = F.max("g") < F.max("k") * 0.97, F.bool_and((c("sb") / c("nb") - c("k")) / c("k") <= 0.05)
    return x.groupBy("model_id").agg(gate.alias("mae_gate"), fair.alias("fair"), (gate & fair).alias("promoted"))


@query("a38_performance_change", """SELECT model_id, direction, round(change, 6) AS change, CASE WHEN direction = 'lower' THEN CASE WHEN change > 1.30 THEN 'critical' WHEN change > 1.15 THEN 'degraded' ELSE 'ok' END ELSE CASE WHEN change > 0.30 THEN 'critical' WHEN change > 0.15 THEN 'degraded' ELSE 'ok' END END AS status FROM (
    SELECT model_id, CASE WHEN model_id IN ('view', 'click') THEN 'higher' ELSE 'lower' END AS direction, CASE WHEN model_id IN ('view', 'click') THEN (b - k) / (abs(b) + 1e-8) ELSE k / (b + 1e-8) END AS change FROM (
      SELECT model_id, avg(error) FILTER (WHERE ts < TIMESTAMP '2024-01-24') AS b, avg(error) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS k FROM err GROUP BY 1))""")
def a38(v):
    return L.performance_change(v.err, "model_id", "error", c("ts") < F.lit(CUT).cast("timestamp"), c("model_id").isin("view", "click"))


SQL_VIEWS["perf"] = """SELECT model_id, CASE WHEN k > 1.30 * b THEN 'critical' WHEN k > 1.15 * b THEN 'degraded' ELSE 'ok' END AS perf, CASE WHEN abs(k - b) > 0.1 * b THEN 'warning' ELSE 'ok' END AS drift FROM (
    SELECT entity_id % 40 AS model_id, avg(error) FILTER (WHERE ts < TIMESTAMP '2024-01-24') AS b, avg(error) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS k FROM err GROUP BY 1) WHERE b IS NOT NULL AND k IS NOT NULL"""


def perf(v: Views) -> DataFrame:
    old = c("ts") < F.lit(CUT).cast("timestamp")
    x = v.err.groupBy((c("entity_id") % 40).alias("model_id")).agg(F.avg(F.when(old, c("error"))).alias("b"), F.avg(F.when(~old, c("error"))).alias("k"))
    return x.filter("b is not null and k is not null").select(
        "model_id", F.when(c("k") > 1.30 * c("b"), "critical").when(c("k") > 1.15 * c("b"), "degraded").otherwise("ok").alias("perf"),
        F.when(F.abs(c("k") - c("b")) > 0.1 * c("b"), "warning").otherwise("ok").alias("drift"))


@query("a73_overall_status", "SELECT model_id, ['ok','warning','degraded','critical'][greatest(list_position(['ok','warning','degraded','critical'], perf), list_position(['ok','warning','degraded','critical'], drift))] AS overall FROM perf")
def a73(v):
    rank = F.greatest(rank_of(c("perf"), DRIFT_LEVELS), rank_of(c("drift"), DRIFT_LEVELS))
    return perf(v).select("model_id", level_of(rank, DRIFT_LEVELS).alias("overall"))


@query("a39_monitor_summary", """SELECT s.status, count(*) AS models, coalesce(max(t.top3), '') AS top3 FROM (SELECT idx % 4 AS model, ['ok','warning','degraded','critical'][max(list_position(['ok','warning','degraded','critical'], status))] AS status FROM drift GROUP BY 1) s
    JOIN (SELECT idx % 4 AS model, coalesce(array_to_string(list(idx ORDER BY idx) FILTER (WHERE status <> 'ok')[1:3], ','), '') AS top3 FROM drift GROUP BY 1) t USING (model) GROUP BY 1""")
def a39(v):
    listed = F.slice(F.array_sort(F.collect_list(F.when(c("status") != "ok", c("idx")))), 1, 3)
    m = drift(v).groupBy((c("idx") % 4).alias("model")).agg(worst(c("status"), DRIFT_LEVELS).alias("status"), F.array_join(listed, ",").alias("top3"))
    return m.groupBy("status").agg(F.count("*").alias("models"), F.max("top3").alias("top3"))


@query("a70_promotion_gates", """SELECT model_id, max(b) FILTER (WHERE metric = 'mae') < 0.97 * max(a) FILTER (WHERE metric = 'mae') AS mae_gate, bool_and(CASE WHEN metric LIKE 'region%' AND a > 0 THEN (b - a) / a <= 0.05 ELSE true END) AS region_gate,
    max(b) FILTER (WHERE metric = 'mape') < 0.98 * max(a) FILTER (WHERE metric = 'mape') AS mape_gate FROM (
    SELECT model_id, 'mae' AS metric, avg(error) FILTER (WHERE role = 'champion') AS a, avg(error) FILTER (WHERE role <> 'champion') AS b FROM err GROUP BY 1
    UNION ALL SELECT model_id, 'region_' || region_id, avg(error) FILTER (WHERE role = 'champion'), avg(error) FILTER (WHERE role <> 'champion') FROM err GROUP BY 1, region_id
    UNION ALL SELECT model_id, 'mape', avg(error / (error + 50)) FILTER (WHERE role = 'champion'), avg(error / (error + 50)) FILTER (WHERE role <> 'champion') FROM err GROUP BY 1) GROUP BY 1""")
def a70(v):
    e = v.err
    def both(keys, name, x):
        return e.groupBy(*keys).agg(F.avg(F.when(champ(), x)).alias("champion"), F.avg(F.when(~champ(), x)).alias("challenger")).select("model_id", name.alias("metric"), "champion", "challenger")
    m = (both(["model_id"], F.lit("mae"), c("error")).unionByName(both(["model_id", "region_id"], F.concat(F.lit("region_"), c("region_id").cast("string")), c("error")))
         .unionByName(both(["model_id"], F.lit("mape"), c("error") / (c("error") + 50))))
    return L.promotion_gates(m)


# --- calibration -----------------------------------------------------------
SQL_VIEWS["cal_bins"] = """SELECT model_id, b, min(mid) AS mid, avg(y_true) AS truth, avg(y_pred) AS pred, count(*) AS n FROM (
    SELECT *, (w[b] + w[b + 1]) / 2 AS mid FROM (SELECT q.*, w, CAST(len(list_filter(w, lambda e: e <= y_pred)) AS INTEGER) AS b FROM calib q JOIN (
      SELECT model_id, list_transform(range(0, 10), lambda k: lo + k * ((hi - lo) / 10)) || [hi] AS w FROM (SELECT model_id, min(y_pred) AS lo, max(y_pred) AS hi FROM calib GROUP BY 1)) USING (model_id))) WHERE b BETWEEN 1 AND 10 GROUP BY 1, 2"""
SQL_VIEWS["ece"] = """SELECT model_id, least(sum(n / total * bias), 1.0) AS ece, least(max(bias), 1.0) AS mce FROM (SELECT model_id, n, total, abs(truth - pred) / (abs(pred) + 1e-8) AS bias FROM cal_bins JOIN (SELECT model_id, count(*) AS total FROM calib GROUP BY 1) USING (model_id)) GROUP BY 1"""
SQL_VIEWS["picp"] = """SELECT model_id, avg(CASE WHEN y_true BETWEEN q_lo AND q_hi THEN 1.0 ELSE 0.0 END) AS picp, avg(q_hi - q_lo) / (max(y_true) - min(y_true) + 1e-8) AS pinaw, count(*) AS n FROM calib GROUP BY 1"""
SQL_VIEWS["scale"] = "SELECT model_id, picp, least(greatest(CASE WHEN picp < 0.89 THEN 0.90 / greatest(picp, 0.01) ELSE 0.90 / greatest(picp, 0.90) END, 0.5), 3.0) AS s FROM picp"


@query("a46_calibration_error", "SELECT model_id, round(ece, 6) AS ece, round(mce, 6) AS mce FROM ece")
def a46(v):
    return S.calibration_error(v.calib, ["model_id"]).select("model_id", F.round("ece", 6).alias("ece"), F.round("mce", 6).alias("mce"))


@query("a47_reliability_rows", "SELECT model_id, b AS bin, round(mid, 6) AS midpoint, round(truth, 6) AS truth, round(pred, 6) AS predicted, n FROM cal_bins")
def a47(v):
    return S.calibration_bins(v.calib, ["model_id"]).select("model_id", "bin", *[F.round(x, 6).alias(x) for x in ("midpoint", "truth", "predicted")], "n")


@query("a48_interval_coverage", "SELECT model_id, round(picp, 8) AS picp, round(pinaw, 8) AS pinaw FROM picp")
def a48(v):
    y, lo, hi = c("y_true"), c("q_lo"), c("q_hi")
    return v.calib.groupBy("model_id").agg(F.round(S.coverage(y, lo, hi), 8).alias("picp"), F.round(S.mean_width(y, lo, hi), 8).alias("pinaw"))


@query("a49_brier_and_nll", """SELECT model_id, round(avg(pow(least(greatest(y_pred / (top + 1e-8) * 0.5 + 0.5, 0.0), 1.0) - CASE WHEN y_true > 60 THEN 1.0 ELSE 0.0 END, 2)), 8) AS brier,
    round(avg(0.5 * ln(2 * pi() * pow(greatest((q_hi - q_lo) / 4, 1e-4), 2)) + pow(y_true - y_pred, 2) / (2 * pow(greatest((q_hi - q_lo) / 4, 1e-4), 2))), 6) AS nll FROM calib JOIN (SELECT model_id, max(abs(y_pred)) AS top FROM calib GROUP BY 1) USING (model_id) GROUP BY 1""")
def a49(v):
    top = v.calib.groupBy("model_id").agg(F.max(F.abs("y_pred")).alias("top"))
    return v.calib.join(top, "model_id").groupBy("model_id").agg(
        F.round(L.brier(c("y_true") > 60, c("y_pred"), c("top")), 8).alias("brier"),
        F.round(L.gaussian_nll(c("y_true"), c("y_pred"), c("q_lo"), c("q_hi")), 6).alias("nll"))


@query("a50_conformal_correction", """SELECT model_id, round(quantile_cont(s, 0.90), 6) AS correction, round(any_value(split), 6) AS split_conformal FROM (SELECT model_id, greatest(q_lo - y_true, y_true - q_hi) AS s FROM calib)
    JOIN (SELECT model_id, max(s) FILTER (WHERE r <= least(ceil((n + 1) * 0.9), n)) AS split FROM (SELECT model_id, s, row_number() OVER (PARTITION BY model_id ORDER BY s) AS r, count(*) OVER (PARTITION BY model_id) AS n FROM (SELECT model_id, greatest(q_lo - y_true, y_true - q_hi) AS s FROM calib)) GROUP BY 1) USING (model_id) GROUP BY 1""")
def a50(v):
    """Interpolated 0.90 quantile of the scores, and the published split-conformal order statistic."""
    s = v.calib.select("model_id", F.greatest(c("q_lo") - c("y_true"), c("y_true") - c("q_hi")).alias("s"))
    q = quantiles(s, ["model_id"], "s", {"correction": 0.90})
    return q.join(L.split_conformal(s, ["model_id"], "s", 0.90), "model_id").select(
        "model_id", F.round("correction", 6).alias("correction"), F.round("split_conformal", 6).alias("split_conformal"))


@query("g12_interval_scale", "SELECT model_id, round(s, 8) AS scale FROM scale")
def g12(v):
    return L.interval_scale(v.calib, ["model_id"]).select("model_id", F.round("scale", 8).alias("scale"))


@query("g13_apply_calibration", "SELECT event_id, round((q_lo + q_hi) / 2 - (q_hi - q_lo) / 2 * s, 6) AS lo, round((q_lo + q_hi) / 2 + (q_hi - q_lo) / 2 * s, 6) AS hi, round(1 / (1 + exp(-(y_pred - 60) / 25.0 / 1.5)), 8) AS prob FROM calib JOIN scale USING (model_id)")
def g13(v):
    x = L.apply_interval_scale(v.calib.join(L.interval_scale(v.calib, ["model_id"]), "model_id"))
    return x.select("event_id", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round(L.tempered((c("y_pred") - 60) / 25.0, F.lit(1.5)), 8).alias("prob"))


@query("a72_calibration_report", """SELECT model_id, n, round(ece, 6) AS ece_before, round(picp, 6) AS picp_before, round(pinaw, 6) AS pinaw_before, round(pa, 6) AS picp_after, round(wa, 6) AS pinaw_after FROM picp JOIN ece USING (model_id) JOIN (
    SELECT model_id, avg(CASE WHEN y_true BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS pa, avg(hi - lo) / (max(y_true) - min(y_true) + 1e-8) AS wa FROM (SELECT model_id, y_true, (q_lo + q_hi) / 2 - (q_hi - q_lo) / 2 * s AS lo, (q_lo + q_hi) / 2 + (q_hi - q_lo) / 2 * s AS hi FROM calib JOIN scale USING (model_id)) GROUP BY 1) USING (model_id)""")
def a72(v):
    y = c("y_true")
    before = v.calib.groupBy("model_id").agg(F.count("*").alias("n"), S.coverage(y, c("q_lo"), c("q_hi")).alias("picp_before"), S.mean_width(y, c("q_lo"), c("q_hi")).alias("pinaw_before"))
    x = L.apply_interval_scale(v.calib.join(L.interval_scale(v.calib, ["model_id"]), "model_id"))
    after = x.groupBy("model_id").agg(S.coverage(y, c("lo"), c("hi")).alias("picp_after"), S.mean_width(y, c("lo"), c("hi")).alias("pinaw_after"))
    ece = S.calibration_error(v.calib, ["model_id"]).select("model_id", c("ece").alias("ece_before"))
    j = before.join(after, "model_id").join(ece, "model_id")
    return j.select("model_id", "n", *[F.round(x, 6).alias(x) for x in ("ece_before", "picp_before", "pinaw_before", "picp_after", "pinaw_after")])


@query("a64_prediction_quantiles", "SELECT model_id, round(q[1], 6) AS q10, round(q[2], 6) AS q25, round(q[3], 6) AS q50, round(q[4], 6) AS q75, round(q[5], 6) AS q90 FROM (SELECT model_id, quantile_cont(y_pred, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM calib GROUP BY 1)")
def a64(v):
    p = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}
    return quantiles(v.calib, ["model_id"], "y_pred", p).select("model_id", *[F.round(x, 6).alias(x) for x in p])


@query("g11_temperature_scaling", """WITH g AS (SELECT model_id, t, avg(-(yb * ln(p + 1e-9) + (1 - yb) * ln(1 - p + 1e-9))) AS nll FROM (SELECT model_id, t, CASE WHEN y_true > 60 THEN 1.0 ELSE 0.0 END AS yb, 1 / (1 + exp(-((y_pred - 60) / 25.0) / t)) AS p FROM calib CROSS JOIN (SELECT 0.1 + k * ((10.0 - 0.1) / 33) AS t FROM range(34) r(k))) GROUP BY 1, 2),
    b AS (SELECT model_id, arg_min(t, (nll, t)) AS t0 FROM g GROUP BY 1),
    f AS (SELECT model_id, t, avg(-(yb * ln(p + 1e-9) + (1 - yb) * ln(1 - p + 1e-9))) AS nll FROM (SELECT model_id, t, CASE WHEN y_true > 60 THEN 1.0 ELSE 0.0 END AS yb, 1 / (1 + exp(-((y_pred - 60) / 25.0) / t)) AS p FROM calib JOIN (SELECT model_id, greatest(t0 - 0.3 + k * 0.02, 0.1) AS t FROM b, range(31) r(k)) USING (model_id)) GROUP BY 1, 2)
    SELECT model_id, round(arg_min(t, (nll, t)), 4) AS temperature, round(min(nll), 6) AS nll FROM f GROUP BY 1""")
def g11(v):
    return L.fit_temperature(v.calib, ["model_id"], c("y_true") > 60, (c("y_pred") - 60) / 25.0).select(
        "model_id", F.round("temperature", 4).alias("temperature"), F.round("nll", 6).alias("nll"))


# --- skill -----------------------------------------------------------------
SQL_VIEWS["pair"] = "SELECT model_id, event_id, y_true AS obs, y_pred AS sim FROM calib"
SKILL_SQL = """round(1 - sum(pow(obs - sim, 2)) / (var_pop(obs) * count(*) + 1e-9), 6) AS nse, round(1 - sqrt(pow(corr(obs, sim) - 1, 2) + pow(stddev_pop(sim) / (stddev_pop(obs) + 1e-9) - 1, 2) + pow(avg(sim) / (avg(obs) + 1e-9) - 1, 2)), 6) AS kge,
    round(100 * (sum(sim) - sum(obs)) / (sum(obs) + 1e-9), 6) AS pbias, round(sqrt(avg(pow(obs - sim, 2))), 6) AS rmse, round(avg(abs(obs - sim)), 6) AS mae, round(pow(corr(obs, sim), 2), 6) AS r2"""


@query("a24_forecast_skill", f"SELECT {SKILL_SQL}, round(sqrt(avg(pow(obs - sim, 2))) / (avg(obs) + 1e-9), 6) AS nrmse FROM pair")
def a24(v):
    x = S.skill(c("y_true"), c("y_pred"))
    return v.calib.agg(*[F.round(e, 6).alias(n) for n, e in x.items()], F.round(x["rmse"] / (F.avg("y_true") + 1e-9), 6).alias("nrmse"))


@query("a25_group_skill", f"SELECT model_id, {SKILL_SQL} FROM pair GROUP BY 1 HAVING count(*) > 10")
def a25(v):
    return v.calib.groupBy("model_id").agg(F.count("*").alias("n"), *[F.round(e, 6).alias(n) for n, e in S.skill(c("y_true"), c("y_pred")).items()]).filter("n > 10").drop("n")


@query("a28_class_metrics", """WITH m AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY 1, 2), k AS (SELECT cls, sum(n) FILTER (WHERE t = cls AND p = cls) AS tp, sum(n) FILTER (WHERE t <> cls AND p = cls) AS fp, sum(n) FILTER (WHERE t = cls AND p <> cls) AS fn FROM m CROSS JOIN (SELECT DISTINCT t AS cls FROM m UNION SELECT DISTINCT p FROM m) GROUP BY 1)
    SELECT cls, round(2.0 * coalesce(tp, 0) / (2 * coalesce(tp, 0) + coalesce(fp, 0) + coalesce(fn, 0)), 6) AS f1, round(avg(2.0 * coalesce(tp, 0) / (2 * coalesce(tp, 0) + coalesce(fp, 0) + coalesce(fn, 0))) OVER (), 6) AS macro_f1, round((SELECT sum(n) FILTER (WHERE t = p) / sum(n) FROM m), 6) AS accuracy FROM k""")
def a28(v):
    return L.class_metrics(v.table("labels"), "quality", "toxic")


@query("a29_interval_score", "SELECT model_id, round(avg(q_hi - q_lo + 20 * greatest(q_lo - y_true, 0) + 20 * greatest(y_true - q_hi, 0)), 6) AS score FROM calib GROUP BY 1")
def a29(v):
    return v.calib.groupBy("model_id").agg(F.round(L.interval_score(c("y_true"), c("q_lo"), c("q_hi"), 0.1), 6).alias("score"))


@query("a30_rmse_per_variable", """SELECT variable, round(sqrt(avg(pow(y_true - pred, 2))), 6) AS rmse, sqrt(avg(pow(y_true - pred, 2))) <= lim AS meets FROM (SELECT y_true, unnest(['q_hi','q_lo','y_pred']) AS variable, unnest([q_hi, q_lo, y_pred]) AS pred, unnest([30.0, 40.0, 25.0]) AS lim FROM calib) GROUP BY variable, lim""")
def a30(v):
    u = v.calib.unpivot("y_true", ["q_hi", "q_lo", "y_pred"], "variable", "pred")
    lim = F.when(c("variable") == "q_hi", 30.0).when(c("variable") == "q_lo", 40.0).otherwise(25.0)
    r = F.sqrt(F.avg(F.pow(c("y_true") - c("pred"), 2)))
    return u.groupBy("variable").agg(r.alias("r")).select("variable", F.round("r", 6).alias("rmse"), (c("r") <= lim).alias("meets"))


@query("a71_holdout_mape", """SELECT river_id, count(*) AS n, round(avg(abs((discharge_cms - m) / (abs(discharge_cms) + 1e-8))), 6) AS mape FROM daily_flow JOIN (SELECT river_id, max(day) - 365 AS cut FROM daily_flow GROUP BY 1) USING (river_id)
    JOIN (SELECT d.river_id, avg(discharge_cms) AS m FROM daily_flow d JOIN (SELECT river_id, max(day) - 365 AS cut FROM daily_flow GROUP BY 1) k ON d.river_id = k.river_id AND d.day <= k.cut GROUP BY 1) USING (river_id) WHERE day > cut GROUP BY 1""")
def a71(v):
    return L.holdout_mape(v.daily_flow, "river_id", "day", "discharge_cms", 365)


SQL_VIEWS["member"] = "SELECT station_id, day, model_id, avg(x) AS x FROM (SELECT station_id, CAST(ts AS DATE) AS day, variable AS model_id, value AS x FROM obs) GROUP BY 1, 2, 3"
SQL_VIEWS["weight"] = """SELECT model_id, (1 / e) / (sum(1 / e) OVER () + 1e-12) AS w FROM (SELECT model_id, greatest(CASE WHEN model_id = 'view' THEN greatest(1.0 - avg(error) / 1000, 1e-4) * 100 ELSE avg(error) END, 1e-6) AS e FROM err GROUP BY 1)"""


@query("a52_member_weights", "SELECT model_id, round(w, 8) AS weight FROM weight")
def a52(v):
    e = v.err.groupBy("model_id").agg(F.avg("error").alias("m"))
    e = e.select("model_id", F.when(c("model_id") == "view", F.greatest(1.0 - c("m") / 1000, F.lit(1e-4)) * 100).otherwise(c("m")).alias("e"))
    return L.inverse_error_weights(e).select("model_id", F.round("weight", 8).alias("weight"))


@query("a51_ensemble", """SELECT station_id, strftime(day, '%Y-%m-%d') AS day, round(mean, 6) AS mean, round(sqrt(greatest(var, 0)), 5) AS std, round(mean - 1.645 * greatest(sqrt(greatest(var, 0)), 1e-6), 5) AS lower, round(mean + 1.645 * greatest(sqrt(greatest(var, 0)), 1e-6), 5) AS upper FROM (
    SELECT station_id, day, any_value(mean) AS mean, sum(w * pow(x - mean, 2)) / sum(w) AS var FROM (SELECT *, sum(w * x) OVER p / sum(w) OVER p AS mean FROM member JOIN weight USING (model_id) WINDOW p AS (PARTITION BY station_id, day)) GROUP BY 1, 2)""")
def a51(v):
    """Weighted mean, weighted spread and 90 % bounds over the members that are present."""
    e = v.err.groupBy("model_id").agg(F.avg("error").alias("m"))
    w = L.inverse_error_weights(e.select("model_id", F.when(c("model_id") == "view", F.greatest(1.0 - c("m") / 1000, F.lit(1e-4)) * 100).otherwise(c("m")).alias("e")))
    m = v.obs.groupBy("station_id", F.to_date("ts").alias("day"), c("variable").alias("model_id")).agg(F.avg("value").alias("x"))
    x = L.ensemble(m.join(w, "model_id"), ["station_id", "day"], c("x"), c("weight"))
    return x.select("station_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("mean", 6).alias("mean"), *[F.round(n, 5).alias(n) for n in ("std", "lower", "upper")])


@query("g17_update_verdict", """SELECT model_id, CASE WHEN NOT (d < 0 AND (model_id <> 'view' OR nse >= 0.60)) THEN 'ROLLBACK' WHEN d <= -0.10 THEN 'FLAG_FOR_AB_TEST' ELSE 'SWAP' END AS action FROM (SELECT model_id, (mb - ma) / ma AS d FROM arms) JOIN (
    SELECT model_id, 1 - sum(pow(obs - sim, 2)) / (var_pop(obs) * count(*) + 1e-8) AS nse FROM pair GROUP BY 1) USING (model_id)""")
def g17(v):
    m = S.arm_moments(v.err, ["model_id"], c("error"), champ()).select("model_id", ((c("mean_b") - c("mean_a")) / c("mean_a")).alias("d"))
    h = v.calib.groupBy("model_id").agg(S.skill(c("y_true"), c("y_pred"))["nse"].alias("nse"))
    return m.join(h, "model_id").select("model_id", L.update_verdict(c("d"), c("nse"), c("model_id") == "view").alias("action"))


@query("g18_traffic_split", "SELECT event_id, CASE WHEN CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20 THEN 'challenger' ELSE 'champion' END AS arm FROM events")
def g18(v):
    return v.events.select("event_id", L.traffic_arm(c("event_id"), 20).alias("arm"))


@query("g04_standardise", """SELECT vec_id, f.idx, round((x - m) / greatest(s, 1e-8), 6) AS z, round((ln(1 + x - lo) - q[2]) / nullif(q[3] - q[1], 0), 5) AS robust FROM feature f JOIN (SELECT idx, avg(x) AS m, stddev_samp(x) AS s, min(x) AS lo FROM feature GROUP BY 1) USING (idx)
    JOIN (SELECT idx, quantile_cont(ln(1 + x - lo), [0.25, 0.5, 0.75]) AS q FROM feature JOIN (SELECT idx, min(x) AS lo FROM feature GROUP BY 1) USING (idx) GROUP BY 1) USING (idx)""")
def g04(v):
    f = v.feature
    shifted = f.join(f.groupBy("idx").agg(F.min("x").alias("lo")), "idx").withColumn("l", F.log1p(c("x") - c("lo")))
    return (L.robust_scale(L.standardise(shifted, ["idx"], "x", "z"), ["idx"], "l", "robust")
            .select("vec_id", "idx", F.round("z", 6).alias("z"), F.round("robust", 5).alias("robust")))


SQL_VIEWS["mi"] = """SELECT idx, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM (SELECT DISTINCT idx, b, y, n, sum(n) OVER (PARTITION BY idx, b) AS nx, sum(n) OVER (PARTITION BY idx, y) AS ny, sum(n) OVER (PARTITION BY idx) AS t FROM (
    SELECT f.idx, CASE WHEN x = w[11] THEN 10 ELSE len(list_filter(w, lambda q: q <= x)) END AS b, label AS y, count(*)::DOUBLE AS n FROM feature f JOIN (SELECT idx, list_transform(range(0, 10), lambda k: lo + k * ((hi - lo) / 10)) || [hi] AS w FROM (SELECT idx, min(x) AS lo, max(x) AS hi FROM feature GROUP BY 1)) USING (idx) GROUP BY 1, 2, 3)) GROUP BY 1"""


@query("g06_mutual_information", "SELECT idx, round(mi, 6) AS mi, mi > 0.01 AS selected FROM mi")
def g06(v):
    m = L.binned_mutual_information(v.feature, ["idx"], "x", "label")
    return m.select("idx", F.round("mi", 6).alias("mi"), (c("mi") > 0.01).alias("selected"))


@query("k01_top_features", "SELECT idx, round(mi, 6) AS mi FROM mi ORDER BY round(mi, 9) DESC, idx LIMIT 30")
def k01(v):
    m = L.binned_mutual_information(v.feature, ["idx"], "x", "label")
    return m.orderBy(F.round("mi", 9).desc(), "idx").limit(30).select("idx", F.round("mi", 6).alias("mi"))


@query("k04_substitute_features", "SELECT idx, round(mi, 6) AS mi FROM mi WHERE idx <> 7 ORDER BY round(mi, 9) DESC, idx LIMIT 5")
def k04(v):
    m = L.binned_mutual_information(v.feature, ["idx"], "x", "label")
    return m.filter("idx <> 7").orderBy(F.round("mi", 9).desc(), "idx").limit(5).select("idx", F.round("mi", 6).alias("mi"))


SQL_VIEWS["contrib"] = "SELECT vec_id, f.idx, (x - m) * (idx % 7 - 3) AS contribution FROM feature f JOIN (SELECT idx, avg(x) AS m FROM feature GROUP BY 1) USING (idx)"


def contrib(v: Views) -> DataFrame:
    """Contributions of a linear score: weight times deviation from the mean."""
    m = v.feature.groupBy("idx").agg(F.avg("x").alias("m"))
    return v.feature.join(m, "idx").select("vec_id", "idx", ((c("x") - c("m")) * (c("idx") % 7 - 3)).alias("contribution"))


@query("a59_feature_attribution", "SELECT idx, round(avg(abs(contribution)), 8) AS mean_abs FROM contrib GROUP BY 1 ORDER BY round(avg(abs(contribution)), 9) DESC, idx LIMIT 15")
def a59(v):
    return L.attribution(contrib(v), "idx", "contribution", 15)


@query("a60_pair_interaction", """SELECT a.idx AS f1, b.idx AS f2, round(avg(abs(a.contribution * b.contribution)), 10) AS effect FROM contrib a JOIN contrib b ON a.vec_id = b.vec_id AND a.idx < b.idx GROUP BY 1, 2 ORDER BY round(avg(abs(a.contribution * b.contribution)), 12) DESC, f1, f2 LIMIT 10""")
def a60(v):
    return L.pair_interactions(contrib(v), "vec_id", "idx", "contribution", 10)


@query("a61_partial_dependence", """SELECT idx, k AS grid, round(avg(score - w * x + w * (lo + k * (hi - lo) / 9)), 8) AS mean_prediction FROM (SELECT f.*, (idx % 7 - 3) AS w, sum(x * (idx % 7 - 3)) OVER (PARTITION BY vec_id) AS score, min(x) OVER (PARTITION BY idx) AS lo, max(x) OVER (PARTITION BY idx) AS hi FROM feature f) CROSS JOIN range(10) r(k) GROUP BY 1, 2""")
def a61(v):
    """Mean prediction when one feature of a linear score is set to each grid value."""
    return L.partial_dependence(v.feature, "vec_id", "idx", "x", F.col("idx") % 7 - 3, 10)


@query("a23_trend", """SELECT watershed_id, count(*) AS n, round(regr_slope(v, t), 6) AS slope_per_year, round(regr_r2(v, t), 8) AS r2, round(regr_r2(v, t) / (1 - regr_r2(v, t)) * (count(*) - 2), 5) AS f_stat FROM (
    SELECT watershed_id, p_mm / 100 AS v, (row_number() OVER (PARTITION BY watershed_id ORDER BY month) - 1) / 12.0 AS t FROM monthly) GROUP BY 1 HAVING count(*) >= 4""")
def a23(v):
    return trend(v).select("watershed_id", "n", F.round("slope", 6).alias("slope_per_year"), F.round("r2", 8).alias("r2"), F.round("f", 5).alias("f_stat"))


def trend(v: Views) -> DataFrame:
    """Linear trend of monthly values (one row per month bounds the window)."""
    w = Window.partitionBy("watershed_id").orderBy("month")
    x = v.monthly.select("watershed_id", (c("p_mm") / 100).alias("v"), ((F.row_number().over(w) - 1) / 12.0).alias("t"))
    return L.linear_trend(x, ["watershed_id"], "v", "t")


@query("a23_trend_significance", tail_sql("""SELECT watershed_id, (n - 2) / ((n - 2) + r / (1 - r) * (n - 2)) AS x0, (n - 2) / 2.0 AS a0, 0.5 AS b0 FROM (SELECT watershed_id, count(*) AS n, regr_r2(v, t) AS r FROM (
    SELECT watershed_id, p_mm / 100 AS v, (row_number() OVER (PARTITION BY watershed_id ORDER BY month) - 1) / 12.0 AS t FROM monthly) GROUP BY 1 HAVING count(*) >= 4)""", "watershed_id", "round(p, 6) AS p_value", ", round(p, 6) < 0.05 AS significant"))
def a23p(v):
    """p of the F test and the 5 % verdict."""
    return trend(v).select("watershed_id", F.round(S.f_upper_tail(c("f"), F.lit(1.0), (c("n") - 2).cast("double")), 6).alias("p_value")).withColumn("significant", c("p_value") < 0.05)

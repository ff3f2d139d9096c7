"""Reservoirs, balances, water quality, coast, groundwater and availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raincourse.functions import flood, water
from raincourse.operators import joins as J
from raincourse.operators import learning as L
from raincourse.operators.rollup import clip, latest_per_key, level_of, rank_of, worst
from raincourse.operators.spatial import box_join
from raincourse.registry import query
from raincourse.session import sized
from raincourse.streaming.state import fold_storage, series_of
from raincourse.views import SQL_VIEWS, Views

c = F.col

# --- reservoirs ------------------------------------------------------------
SQL_VIEWS["inflow"] = """SELECT r.*, d.day, CASE WHEN reservoir_id % 3 = 0 THEN 0.85 WHEN reservoir_id % 3 = 1 THEN 0.95 ELSE 1.0 END * (d.discharge_cms + CASE WHEN r.river_id < 10 THEN 4500 * 1.5 * 0.6 / 3600.0 ELSE 0.0 END) AS inflow_cms
    FROM reservoir r JOIN daily_flow d USING (river_id)"""
SQL_VIEWS["res_now"] = """SELECT *, (s - dead_m3) / greatest(capacity_m3, 1.0) AS frac FROM (SELECT *, greatest(least(capacity_m3 * (0.3 + (reservoir_id % 8) / 10.0) + (inflow_cms - 50.0) * 24 * 3600.0, capacity_m3 + dead_m3), dead_m3) AS s FROM inflow QUALIFY row_number() OVER (PARTITION BY reservoir_id ORDER BY day DESC) = 1)"""
SQL_VIEWS["gate"] = """SELECT *, CASE WHEN frac >= 1.0 THEN 'EMERGENCY' WHEN frac >= 0.9 THEN 'ALERT' ELSE 'NORMAL' END AS gate,
    least(CASE WHEN frac < 0.6 THEN normal_release_cms * 0.5 WHEN frac < 0.9 THEN normal_release_cms * (1 + (frac - 0.6) / (0.9 - 0.6)) WHEN frac < 1.0 THEN normal_release_cms + capacity_m3 * 0.10 / 21600.0 ELSE max_release_cms END, max_release_cms) AS release FROM res_now"""


def cascade_factor() -> F.Column:
    r = c("reservoir_id") % 3
    return F.when(r == 0, 0.85).when(r == 1, 0.95).otherwise(1.0)


def river_supply(river_cms: F.Column) -> F.Column:
    """River flow with a rain supplement on some rivers."""
    return river_cms + F.when(c("river_id") < 10, 4500 * 1.5 * 0.6 / 3600.0).otherwise(0.0)


def reservoir_inflow(river_cms: F.Column) -> F.Column:
    """River flow times a cascade factor, with a rain supplement on some rivers."""
    return cascade_factor() * river_supply(river_cms)


def inflow(v: Views) -> DataFrame:
    return v.reservoir.join(v.daily_flow.select("river_id", "day", "discharge_cms"), "river_id").withColumn(
        "inflow_cms", reservoir_inflow(c("discharge_cms"))).drop("discharge_cms")


def res_now(v: Views) -> DataFrame:
    newest = latest_per_key(v.daily_flow, ["river_id"], ["day"])
    n = v.reservoir.join(newest, "river_id").withColumn("inflow_cms", reservoir_inflow(c("discharge_cms")))
    s = water.next_storage(c("capacity_m3") * (0.3 + (c("reservoir_id") % 8) / 10.0), c("inflow_cms"), F.lit(50.0), c("capacity_m3"), c("dead_m3"), 24)
    n = n.withColumn("s", s).withColumn("frac", (c("s") - c("dead_m3")) / F.greatest("capacity_m3", F.lit(1.0)))
    return n.withColumns({"gate": water.gate_state(c("frac")),
                          "release": water.gate_release(c("frac"), c("capacity_m3"), c("normal_release_cms"), c("max_release_cms"))})


@query("m26_reservoir_inflow", "SELECT reservoir_id, strftime(day, '%Y-%m-%d') AS day, round(inflow_cms, 10) AS inflow_cms FROM inflow")
def m26(v):
    return inflow(v).select("reservoir_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("inflow_cms", 10).alias("inflow_cms"))


@query("m23_storage_update", "SELECT reservoir_id, round(s, 1) AS storage_m3, round(frac, 6) AS fraction, round(least(fsl_m - 10 + frac / 0.9 * 10, mwl_m), 4) AS level_m, gate, frac <= 0.05 AS supply_risk FROM gate")
def m23(v):
    return res_now(v).select("reservoir_id", F.round("s", 1).alias("storage_m3"), F.round("frac", 6).alias("fraction"),
                             F.round(water.reservoir_level_m(c("frac"), c("fsl_m"), c("mwl_m")), 4).alias("level_m"), "gate",
                             (c("frac") <= water.MINIMUM_LEVEL).alias("supply_risk"))


@query("m24_gate_release", "SELECT reservoir_id, round(release, 5) AS release_cms, CASE WHEN frac >= 1.0 THEN 'MWL_BREACH' WHEN frac >= 0.9 THEN 'FSL_EXCEEDED' ELSE 'NONE' END AS alert FROM gate")
def m24(v):
    return res_now(v).select("reservoir_id", F.round("release", 5).alias("release_cms"), water.release_alert(c("frac")).alias("alert"))


@query("m25_downstream_impact", "SELECT reservoir_id, round(release * 0.60, 5) AS peak_cms, CASE WHEN release / max_release_cms >= 0.80 THEN 'CRITICAL' WHEN release / max_release_cms >= 0.60 THEN 'HIGH' WHEN release / max_release_cms >= 0.35 THEN 'MODERATE' ELSE 'LOW' END AS impact FROM gate")
def m25(v):
    return res_now(v).select("reservoir_id", F.round(c("release") * 0.60, 5).alias("peak_cms"), water.release_impact(c("release"), c("max_release_cms")).alias("impact"))


@query("a04_reservoir_rollup", """SELECT nation_id, count(*) AS reservoirs, ['NORMAL','ALERT','EMERGENCY'][max(list_position(['NORMAL','ALERT','EMERGENCY'], gate))] AS worst_gate, count(*) FILTER (WHERE gate <> 'NORMAL') AS alerts FROM gate GROUP BY 1""")
def a04(v):
    return res_now(v).groupBy("nation_id").agg(F.count("*").alias("reservoirs"), worst(c("gate"), water.GATE_STATES).alias("worst_gate"),
                                               F.count_if(c("gate") != "NORMAL").alias("alerts"))


@query("j21_gate_decision_join", "SELECT u.reservoir_id, round(coalesce(d.release, 50.0), 5) AS release_cms, coalesce(d.gate, 'NONE') AS alert FROM gate u LEFT JOIN (SELECT reservoir_id, release, gate FROM gate WHERE frac >= 0.6) d USING (reservoir_id)")
def j21(v):
    """Update joined with the decision of the same reservoir; without one the outflow stands."""
    u = res_now(v)
    d = u.filter("frac >= 0.6").select("reservoir_id", c("release").alias("r"), c("gate").alias("g"))
    return u.select("reservoir_id").join(d, "reservoir_id", "left").select(
        "reservoir_id", F.round(F.coalesce("r", F.lit(50.0)), 5).alias("release_cms"), F.coalesce("g", F.lit("NONE")).alias("alert"))


@query("t05_storage_series", """WITH RECURSIVE d AS (SELECT reservoir_id, capacity_m3, dead_m3, inflow_cms, row_number() OVER (PARTITION BY reservoir_id ORDER BY day) AS i FROM inflow),
    r AS (SELECT reservoir_id, i, greatest(least(capacity_m3 * 0.65 + (inflow_cms - 240.0) * 24.0 * 3600.0, capacity_m3 + dead_m3), dead_m3) AS s FROM d WHERE i = 1
      UNION ALL SELECT d.reservoir_id, d.i, greatest(least(r.s + (d.inflow_cms - 240.0) * 24.0 * 3600.0, d.capacity_m3 + d.dead_m3), d.dead_m3) FROM r JOIN d ON d.reservoir_id = r.reservoir_id AND d.i = r.i + 1)
    SELECT reservoir_id, max(i)::BIGINT AS steps, round(arg_max(s, i), 0) AS last_m3, round(min(s), 0) AS low_m3, round(max(s), 0) AS high_m3 FROM r GROUP BY 1""")
def t05(v):
    """Storage carried from day to day with clamps. The series of a river is built once (one
    value per day) and joined to its reservoirs, which are few rows with much work each: they are spread first."""
    series = sized(series_of(v.daily_flow, ["river_id"], "day", "discharge_cms"), "series")
    r = v.reservoir.repartition(int(v.spark.conf.get("spark.sql.shuffle.partitions")), "reservoir_id").join(series, "river_id")
    f = fold_storage(r, c("capacity_m3"), c("dead_m3"), lambda x: reservoir_inflow(x.discharge_cms), F.lit(240.0), 24.0, 0.65)
    return f.select("reservoir_id", "steps", *[F.round(x, 0).alias(x) for x in ("last_m3", "low_m3", "high_m3")])


# --- water balance ---------------------------------------------------------
SQL_VIEWS["balance"] = """SELECT *, CASE WHEN p_mm > 0 THEN abs(res / p_mm) ELSE 0.0 END AS frac FROM (SELECT *, p_mm - et - q_mm - ds AS res FROM (
    SELECT watershed_id, month, p_mm, q_mm, coalesce(CASE WHEN et_mm > 700 THEN et_mm END, p_mm * 0.70) AS et, CASE WHEN et_mm > 700 THEN 'measured' ELSE 'estimated' END AS et_source,
      coalesce((theta - lag(theta) OVER (PARTITION BY watershed_id ORDER BY month)) * 1000, 0.0) AS ds, theta FROM monthly))"""


def balance(v: Views) -> DataFrame:
    """Monthly balance; evapotranspiration is measured or estimated, storage from soil moisture change."""
    w = Window.partitionBy("watershed_id").orderBy("month")
    measured = F.when(c("et_mm") > 700, c("et_mm"))
    m = v.monthly.withColumns({
        "et": F.coalesce(measured, c("p_mm") * 0.70), "et_source": F.when(measured.isNotNull(), "measured").otherwise("estimated"),
        "ds": F.coalesce((c("theta") - F.lag("theta").over(w)) * 1000, F.lit(0.0))})
    m = m.withColumn("res", c("p_mm") - c("et") - c("q_mm") - c("ds"))
    return m.withColumn("frac", water.balance_fraction(c("res"), c("p_mm")))


@query("m21_water_balance", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, round(res, 4) AS residual_mm, round(frac, 6) AS fraction, CASE WHEN frac > 0.15 THEN 'UNCLOSED' ELSE 'CLOSED' END AS status FROM balance")
def m21(v):
    return balance(v).select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), F.round("res", 4).alias("residual_mm"), F.round("frac", 6).alias("fraction"),
                             F.when(c("frac") > water.BALANCE_LIMIT, "UNCLOSED").otherwise("CLOSED").alias("status"))


@query("j13_source_fallback", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, round(et, 4) AS et_mm, et_source FROM balance")
def j13(v):
    """Measured rows joined on the key, with the estimate behind them and a source label."""
    m = v.monthly
    measured = m.filter("et_mm > 700").select("watershed_id", "month", c("et_mm").alias("measured"))
    x = m.select("watershed_id", "month", (c("p_mm") * 0.70).alias("estimated")).join(measured, ["watershed_id", "month"], "left")
    return J.with_fallback(x, ["watershed_id", "month"], [("measured", "measured"), ("estimated", "estimated")], "et", "et_source").select(
        "watershed_id", F.date_format("month", "yyyy-MM").alias("month"), F.round("et", 4).alias("et_mm"), "et_source")


@query("w20_soil_moisture_change", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, round(ds, 6) AS change_mm FROM balance")
def w20(v):
    return balance(v).select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), F.round("ds", 6).alias("change_mm"))


@query("a22_balance_status_counts", """SELECT watershed_id, count(*) FILTER (WHERE p_mm IS NULL) AS failed, count(*) FILTER (WHERE frac > 0.15) AS unclosed, count(*) FILTER (WHERE frac <= 0.15) AS closed FROM balance GROUP BY 1""")
def a22(v):
    return balance(v).groupBy("watershed_id").agg(F.count_if(c("p_mm").isNull()).alias("failed"), F.count_if(c("frac") > 0.15).alias("unclosed"), F.count_if(c("frac") <= 0.15).alias("closed"))


SQL_VIEWS["closure"] = """SELECT *, CASE WHEN q_obs <> 0 THEN abs(calc - q_obs) / abs(q_obs) * 100 WHEN abs(calc) < 1 THEN 0.0 ELSE 100.0 END AS err FROM (SELECT watershed_id, month, p_mm - et - ds AS calc, CASE WHEN month(month) = 2 THEN 0.0 ELSE q_mm END AS q_obs FROM balance)"""


def closure(v: Views) -> DataFrame:
    q = F.when(F.month("month") == 2, 0.0).otherwise(c("q_mm"))
    return balance(v).select("watershed_id", "month", (c("p_mm") - c("et") - c("ds")).alias("calc"), q.alias("q_obs")).withColumn(
        "err", water.closure_error_pct(c("calc"), c("q_obs")))


@query("m22_closure_error", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, round(err, 4) AS error_pct, err > 15 AS imbalanced FROM closure")
def m22(v):
    return closure(v).select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), F.round("err", 4).alias("error_pct"), (c("err") > 15).alias("imbalanced"))


@query("k02_worst_closure", "SELECT row_number() OVER (ORDER BY e DESC, watershed_id) AS pos, watershed_id, e AS mean_error_pct FROM (SELECT watershed_id, round(avg(err), 4) AS e FROM closure GROUP BY 1)")
def k02(v):
    """Ranking of one row per watershed."""
    x = closure(v).groupBy("watershed_id").agg(F.round(F.avg("err"), 4).alias("mean_error_pct"))
    return x.select(F.row_number().over(Window.orderBy(c("mean_error_pct").desc(), "watershed_id")).cast("long").alias("pos"), "watershed_id", "mean_error_pct")


@query("a19_area_weighted_runoff", """SELECT cell_id % 25 AS watershed_id, round(sum(p_size * q) / sum(p_size), 8) AS runoff_mm FROM (SELECT cell_id, p_size, CASE WHEN r <= 0.2 * s THEN 0.0 ELSE pow(r - 0.2 * s, 2) / (r + 0.8 * s) END AS q FROM (SELECT cell_id, p_size, value * 4 AS r, 25400.0 / (60.0 + cell_id % 35) - 254.0 AS s FROM cell)) GROUP BY 1""")
def a19(v):
    q = flood.curve_number_runoff(c("value") * 4, 60.0 + c("cell_id") % 35)
    return v.cell.groupBy((c("cell_id") % 25).alias("watershed_id")).agg(F.round(F.sum(c("p_size") * q) / F.sum("p_size"), 8).alias("runoff_mm"))


@query("a21_period_balance", """SELECT watershed_id, round(sum(p_mm), 2) AS total_p, round(sum(q_mm), 2) AS total_q, round(sum(et_mm), 2) AS total_et, round(sum(q_mm) / sum(p_mm), 6) AS runoff_ratio, round(max(q_mm), 4) AS peak_q, strftime(arg_max(month, (round(q_mm, 6), month)), '%Y-%m') AS peak_month FROM monthly GROUP BY 1""")
def a21(v):
    return v.monthly.groupBy("watershed_id").agg(
        F.round(F.sum("p_mm"), 2).alias("total_p"), F.round(F.sum("q_mm"), 2).alias("total_q"), F.round(F.sum("et_mm"), 2).alias("total_et"),
        F.round(F.sum("q_mm") / F.sum("p_mm"), 6).alias("runoff_ratio"), F.round(F.max("q_mm"), 4).alias("peak_q"),
        F.date_format(F.max_by("month", F.struct(F.round("q_mm", 6), "month")), "yyyy-MM").alias("peak_month"))


# --- water quality: one satellite retrieval per order ----------------------
SQL_VIEWS["reflect"] = """SELECT o_orderkey AS obs_id, CAST(o_custkey % 40 AS INTEGER) AS body_id, CAST(o_orderdate AS DATE) AS day, CASE o_orderstatus WHEN 'F' THEN 'landsat' WHEN 'O' THEN 'modis' ELSE 'synthetic' END AS source,
    (o_orderkey * 7) % 100 AS cloud_pct, 0.02 + (o_orderkey % 37) / 1000.0 AS rho_red, 0.01 + (o_orderkey % 23) / 1000.0 AS rho_nir, 0.002 + (o_orderkey % 11) / 1000.0 AS rrs412,
    0.004 + (o_orderkey % 13) / 1000.0 AS rrs443, 0.006 + (o_orderkey % 17) / 1000.0 AS rrs555, 0.02 + (o_orderkey % 9) / 100.0 AS swir, 24 + (o_orderkey % 80) / 10.0 AS lst FROM orders"""
SQL_VIEWS["quality"] = """SELECT *, CASE WHEN wqi >= 90 THEN 'excellent' WHEN wqi >= 70 THEN 'good' WHEN wqi >= 50 THEN 'fair' WHEN wqi >= 25 THEN 'poor' ELSE 'very_poor' END AS category FROM (
    SELECT *, round(CASE WHEN turb < 10 THEN 100.0 WHEN turb < 50 THEN 100 - (turb - 10) / 40 * 50 WHEN turb < 200 THEN 50 - (turb - 50) / 150 * 25 ELSE greatest(25 - (turb - 200) / 200 * 25, 0) END * 0.40
      + CASE WHEN chl < 2 THEN 100.0 WHEN chl < 10 THEN 100 - (chl - 2) / 8 * 40 WHEN chl < 50 THEN 60 - (chl - 10) / 40 * 35 ELSE greatest(25 - (chl - 50) / 100 * 25, 0) END * 0.35
      + CASE WHEN cdom > 1 THEN greatest(100 - (cdom - 1) * 50, 0) ELSE 100 END * 0.15 + CASE WHEN ta < 1 THEN 100 WHEN ta < 2 THEN 100 - (ta - 1) * 40 WHEN ta < 4 THEN 60 - (ta - 2) * 20 ELSE greatest(20 - (ta - 4) * 5, 0) END * 0.10, 6) AS wqi FROM (
    SELECT *, pow(10, 1.1317 * ln(greatest(rho_red / rho_nir, 0.01)) + 1.0848) AS turb, pow(10, 0.2424 - 2.7423 * log10(greatest(rrs443 / rrs555, 0.01))) AS chl, rrs412 / rrs555 AS cdom, abs(lst - 27.5) AS ta FROM reflect))"""


def reflect(v: Views) -> DataFrame:
    k = c("o_orderkey")
    return v.table("orders").select(
        k.alias("obs_id"), (c("o_custkey") % 40).cast("int").alias("body_id"), F.to_date("o_orderdate").alias("day"),
        F.when(c("o_orderstatus") == "F", "landsat").when(c("o_orderstatus") == "O", "modis").otherwise("synthetic").alias("source"),
        ((k * 7) % 100).alias("cloud_pct"), (0.02 + (k % 37) / 1000.0).alias("rho_red"), (0.01 + (k % 23) / 1000.0).alias("rho_nir"),
        (0.002 + (k % 11) / 1000.0).alias("rrs412"), (0.004 + (k % 13) / 1000.0).alias("rrs443"), (0.006 + (k % 17) / 1000.0).alias("rrs555"),
        (0.02 + (k % 9) / 100.0).alias("swir"), (24 + (k % 80) / 10.0).alias("lst"))


def quality(v: Views) -> DataFrame:
    q = reflect(v).withColumns({"turb": water.turbidity_ntu(c("rho_red"), c("rho_nir")), "chl": water.chlorophyll_ug_l(c("rrs443"), c("rrs555")),
                                "cdom": water.cdom(c("rrs412"), c("rrs555"))})
    q = q.withColumn("wqi", F.round(water.quality_index(c("turb"), c("chl"), c("cdom"), c("lst") - 27.5), 6))
    return q.withColumn("category", water.quality_category(c("wqi")))


@query("m27_water_quality_index", """SELECT obs_id, round(turb, 6) AS turbidity, round(chl, 6) AS chlorophyll, round(cdom, 6) AS cdom, wqi, category, CASE WHEN chl < 2 THEN 'OLIGOTROPHIC' WHEN chl < 10 THEN 'MESOTROPHIC' WHEN chl < 50 THEN 'EUTROPHIC' ELSE 'HYPEREUTROPHIC' END AS trophic FROM quality""")
def m27(v):
    return quality(v).select("obs_id", F.round("turb", 6).alias("turbidity"), F.round("chl", 6).alias("chlorophyll"), F.round("cdom", 6).alias("cdom"),
                             "wqi", "category", water.trophic_state(c("chl")).alias("trophic"))


@query("m28_bloom_probability", "SELECT obs_id, round(least(1.0, pow(chl / 50.0, 0.8)), 6) AS bloom_probability, round(swir * 180, 4) AS phosphorus FROM quality")
def m28(v):
    return quality(v).select("obs_id", F.round(water.bloom_probability(c("chl")), 6).alias("bloom_probability"), F.round(c("swir") * 180, 4).alias("phosphorus"))


@query("m41_chlorophyll_confidence", "SELECT source, CASE source WHEN 'landsat' THEN 'high' WHEN 'modis' THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n, round(avg(chl), 6) AS mean_chl FROM quality GROUP BY 1")
def m41(v):
    conf = F.when(c("source") == "landsat", "high").when(c("source") == "modis", "medium").otherwise("low")
    return quality(v).groupBy("source", conf.alias("confidence")).agg(F.count("*").alias("n"), F.round(F.avg("chl"), 6).alias("mean_chl"))


@query("s20_source_priority", """SELECT body_id, strftime(day, '%Y-%m-%d') AS day, arg_min(source, (p, obs_id)) AS source, arg_min(obs_id, (p, obs_id)) AS obs_id FROM (SELECT *, CASE WHEN source = 'landsat' AND cloud_pct < 20 THEN 0 WHEN source = 'modis' THEN 1 WHEN source = 'landsat' THEN 9 ELSE 2 END AS p FROM reflect) WHERE p < 9 GROUP BY 1, 2""")
def s20(v):
    """Clear Landsat first, then MODIS, then the rest; cloudy Landsat is not used."""
    p = F.when((c("source") == "landsat") & (c("cloud_pct") < 20), 0).when(c("source") == "modis", 1).when(c("source") == "landsat", 9).otherwise(2)
    best = F.min_by(F.struct("source", "obs_id"), F.struct("p", "obs_id"))
    x = reflect(v).withColumn("p", p).filter("p < 9").groupBy("body_id", "day").agg(best.alias("b"))
    return x.select("body_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "b.source", "b.obs_id")


@query("a07_national_water_quality", """SELECT year(day) AS year, count(*) AS n, round(avg(wqi), 6) AS mean_wqi, round(min(wqi), 6) AS min_wqi, count(*) FILTER (WHERE category IN ('poor','very_poor')) AS poor_count,
    ['excellent','good','fair','poor','very_poor'][max(list_position(['excellent','good','fair','poor','very_poor'], category))] AS concern FROM quality GROUP BY 1""")
def a07(v):
    return quality(v).groupBy(F.year("day").cast("long").alias("year")).agg(
        F.count("*").alias("n"), F.round(F.avg("wqi"), 6).alias("mean_wqi"), F.round(F.min("wqi"), 6).alias("min_wqi"),
        F.count_if(c("category").isin("poor", "very_poor")).alias("poor_count"), worst(c("category"), water.QUALITY_LEVELS).alias("concern"))


@query("a69_turbid_share", "SELECT body_id, round(avg(CASE WHEN turb > 50 THEN 1.0 ELSE 0.0 END) * 100, 6) AS turbid_pct, round(avg(turb), 6) AS mean_ntu FROM quality GROUP BY 1")
def a69(v):
    return quality(v).groupBy("body_id").agg(F.round(F.avg((c("turb") > 50).cast("double")) * 100, 6).alias("turbid_pct"), F.round(F.avg("turb"), 6).alias("mean_ntu"))


# --- coast -----------------------------------------------------------------
SQL_VIEWS["coast0"] = """SELECT *, round(5.0 * pow(sii, 0.6), 2) AS reach, CASE WHEN sii >= 1.2 THEN 'CRITICAL' WHEN sii >= 0.7 THEN 'HIGH' WHEN sii >= 0.3 THEN 'MODERATE' ELSE 'SAFE' END AS cat FROM (
    SELECT *, round(prism * 0.6 * tide / 21600.0 / greatest(discharge_cms, 0.1) * (1 + (sub / 1000.0 + 0.003) * tide), 4) AS sii, round(0.041 * (tide / slope) / sqrt(greatest(discharge_cms, 1.0)), 2) AS bw FROM (
    SELECT flow_id, river_id, day, discharge_cms, 1e6 * (1 + gauge_id % 5) AS prism, 0.4 + (flow_id % 9) / 10.0 AS tide, 5 + river_id AS sub, 0.00003 + (river_id % 6) * 0.00005 AS slope FROM flow))"""
SQL_VIEWS["coast"] = """SELECT *, CASE WHEN score >= 5 THEN 'EXTREME' WHEN score >= 3 THEN 'HIGH' WHEN score >= 1 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM (
    SELECT *, CASE cat WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MODERATE' THEN 1 ELSE 0 END + CASE WHEN bw > 25 THEN 2 WHEN bw > 15 THEN 1 ELSE 0 END + CASE WHEN sub + 3.0 > 25 THEN 1 ELSE 0 END AS score FROM coast0)"""


def coast(v: Views) -> DataFrame:
    r = c("river_id")
    x = v.flow.select("flow_id", "river_id", "day", "discharge_cms", (1e6 * (1 + c("gauge_id") % 5)).alias("prism"), (0.4 + (c("flow_id") % 9) / 10.0).alias("tide"),
                      (5 + r).alias("sub"), (0.00003 + (r % 6) * 0.00005).alias("slope"))
    x = x.withColumns(water.intrusion(c("prism"), F.lit(0.6), c("tide"), c("discharge_cms"), c("sub"), F.lit(5000)))
    x = x.withColumn("bw", water.backwater_km(F.lit(0.041), c("tide"), c("slope"), c("discharge_cms")))
    return x.withColumn("risk", water.coastal_risk(c("category"), c("bw"), c("sub") + 3.0))


@query("m10_salt_intrusion", "SELECT flow_id, sii, cat AS category, round(35.0 * sii / (1 + sii), 2) AS salinity_ppt, reach AS reach_km, CAST(floor(5000 * least(reach / 20.0, 1.0)) AS BIGINT) AS wells_affected FROM coast")
def m10(v):
    return coast(v).select("flow_id", "sii", "category", "salinity_ppt", "reach_km", "wells_affected")


@query("m11_tidal_backwater", "SELECT flow_id, bw AS backwater_km, bw > 15 AS flag FROM coast")
def m11(v):
    return coast(v).select("flow_id", c("bw").alias("backwater_km"), (c("bw") > 15).alias("flag"))


@query("m12_coastal_risk", """SELECT flow_id, risk, CASE WHEN river_id = 0 AND sii > 0.7 THEN 'FLUSH_AND_CLOSE' WHEN cat = 'CRITICAL' THEN 'CLOSE_ALL' WHEN cat = 'HIGH' OR bw > 15 THEN 'REDUCE_HALF' ELSE 'NORMAL' END AS gate FROM coast""")
def m12(v):
    return coast(v).select("flow_id", "risk", water.gate_advice(c("category"), c("bw"), (c("river_id") == 0) & (c("sii") > 0.7)).alias("gate"))


@query("a03_coastal_rollup", """SELECT year(day) AS year, count(DISTINCT river_id) AS cities, ['LOW','MODERATE','HIGH','EXTREME'][max(list_position(['LOW','MODERATE','HIGH','EXTREME'], risk))] AS worst_risk, count(*) FILTER (WHERE risk IN ('HIGH','EXTREME')) AS high_or_extreme FROM coast GROUP BY 1""")
def a03(v):
    return coast(v).groupBy(F.year("day").cast("long").alias("year")).agg(
        F.count_distinct("river_id").alias("cities"), worst(c("risk"), water.COAST_LEVELS).alias("worst_risk"), F.count_if(c("risk").isin("HIGH", "EXTREME")).alias("high_or_extreme"))


# --- groundwater -----------------------------------------------------------
SQL_VIEWS["aquifer"] = """SELECT *, CASE WHEN gws < -5 AND trend < -2 THEN 'CRITICAL' WHEN gws < -3 OR (gws < -2 AND trend < -1) THEN 'WARNING' WHEN gws < -1 OR trend < -0.5 THEN 'WATCH' ELSE 'NORMAL' END AS severity FROM (
    SELECT watershed_id, month, round((p_mm - 620) / 60 - (theta - 0.30) * 100, 2) AS gws, round(-2.5 + (watershed_id % 6) * 0.6, 2) AS trend FROM monthly)"""


def aquifer(v: Views) -> DataFrame:
    a = v.monthly.select("watershed_id", "month", F.round((c("p_mm") - 620) / 60 - (c("theta") - 0.30) * 100, 2).alias("gws"),
                         F.round(-2.5 + (c("watershed_id") % 6) * 0.6, 2).alias("trend"))
    return a.withColumn("severity", water.aquifer_severity(c("gws"), c("trend")))


@query("m33_aquifer_anomaly", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, gws AS anomaly_cm, round(gws / 1.8, 3) AS zscore, severity, gws < -2.0 AND trend < -0.5 AS alert FROM aquifer")
def m33(v):
    return aquifer(v).select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), c("gws").alias("anomaly_cm"), F.round(c("gws") / 1.8, 3).alias("zscore"),
                             "severity", ((c("gws") < -2.0) & (c("trend") < -0.5)).alias("alert"))


@query("a14_aquifer_run_status", """SELECT strftime(month, '%Y-%m') AS month, count(*) AS processed, coalesce(string_agg(CAST(watershed_id AS VARCHAR), ',' ORDER BY watershed_id) FILTER (WHERE severity IN ('WARNING','CRITICAL')), '') AS alerting,
    coalesce(string_agg(CAST(watershed_id AS VARCHAR), ',' ORDER BY watershed_id) FILTER (WHERE severity = 'CRITICAL'), '') AS critical, bool_or(severity = 'CRITICAL') AS any_critical FROM aquifer GROUP BY 1""")
def a14(v):
    def names(*levels):
        return F.array_join(F.array_sort(F.collect_list(F.when(c("severity").isin(*levels), c("watershed_id")))), ",")
    return aquifer(v).groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("processed"), names("WARNING", "CRITICAL").alias("alerting"), names("CRITICAL").alias("critical"), F.bool_or(c("severity") == "CRITICAL").alias("any_critical"))


SQL_VIEWS["basin_cell"] = """SELECT b.watershed_id, k.cell_id, (k.value - 14) * 8 * (1.0 - 0.45 - 0.05) AS gws FROM cell k JOIN (SELECT watershed_id, -11.0 + (watershed_id % 5) * 3.5 AS lat_min, -11.0 + (watershed_id % 5) * 3.5 + 4.0 AS lat_max, 95.0 + (watershed_id // 5) * 9.25 AS lon_min, 95.0 + (watershed_id // 5) * 9.25 + 10.0 AS lon_max FROM watershed) b
    ON k.lat BETWEEN b.lat_min AND b.lat_max AND k.lon BETWEEN b.lon_min AND b.lon_max"""


def basin_cell(v: Views) -> DataFrame:
    """Cells inside basin boxes (boxes overlap), with the groundwater half of the water thickness."""
    k = c("watershed_id")
    lat, lon = -11.0 + (k % 5) * 3.5, 95.0 + F.floor(k / 5) * 9.25
    boxes = v.watershed.select("watershed_id", lat.alias("lat_min"), (lat + 4.0).alias("lat_max"), lon.alias("lon_min"), (lon + 10.0).alias("lon_max"))
    return box_join(v.cell, boxes).withColumn("gws", (c("value") - 14) * 8 * (1.0 - 0.45 - 0.05))


@query("j07_box_containment", "SELECT watershed_id, cell_id FROM basin_cell")
def j07(v):
    return basin_cell(v).select("watershed_id", "cell_id")


SQL_VIEWS["basin"] = """SELECT *, CASE WHEN gws <= -35 THEN 'EMERGENCY' WHEN gws <= -20 THEN 'CRITICAL' WHEN gws <= -10 THEN 'WARNING' WHEN gws <= -5 THEN 'WATCH' ELSE 'NORMAL' END AS level FROM (SELECT watershed_id, round(avg(gws), 6) AS gws, round(avg(CASE WHEN gws < -20 THEN 1.0 ELSE 0.0 END) * 100, 6) AS below_pct,
    round(avg(CASE WHEN gws > 1 THEN 1.0 ELSE 0.0 END), 6) AS wet_fraction, round(avg(CASE WHEN gws < -1 THEN 1.0 ELSE 0.0 END), 6) AS dry_fraction FROM basin_cell GROUP BY 1)"""


def basin(v: Views) -> DataFrame:
    g = c("gws")
    return basin_cell(v).groupBy("watershed_id").agg(
        F.round(F.avg(g), 6).alias("gws"), F.round(F.avg((g < -20).cast("double")) * 100, 6).alias("below_pct"),
        F.round(F.avg((g > 1).cast("double")), 6).alias("wet_fraction"), F.round(F.avg((g < -1).cast("double")), 6).alias("dry_fraction")).withColumn(
        "level", water.groundwater_level(c("gws")))


@query("a15_basin_grid_stats", "SELECT watershed_id, gws, below_pct, wet_fraction, dry_fraction FROM basin")
def a15(v):
    return basin(v).select("watershed_id", "gws", "below_pct", "wet_fraction", "dry_fraction")


@query("m34_groundwater_level", "SELECT watershed_id, level, level <> 'NORMAL' AS alert, round(abs(gws) * 0.15, 4) AS subsidence_cm FROM basin")
def m34(v):
    return basin(v).select("watershed_id", "level", (c("level") != "NORMAL").alias("alert"), F.round(F.abs("gws") * 0.15, 4).alias("subsidence_cm"))


@query("k05_most_critical_basin", "SELECT count(*) AS alerting, arg_min(watershed_id, (gws, watershed_id)) AS basin, min(gws) AS gws FROM basin WHERE gws <= 0")
def k05(v):
    return basin(v).filter("gws <= 0").agg(F.count("*").alias("alerting"), F.min_by("watershed_id", F.struct("gws", "watershed_id")).alias("basin"), F.min("gws").alias("gws"))


SQL_VIEWS["depletion"] = """SELECT region_id, month, avg((p_mm - et - q_mm) / 10) - avg(ds) - avg(p_mm * 0.30) / 10 AS dgws FROM balance JOIN watershed USING (watershed_id) GROUP BY 1, 2"""


def depletion(v: Views) -> DataFrame:
    """Storage change of a region less soil and surface water change."""
    b = balance(v).join(v.watershed.select("watershed_id", "region_id"), "watershed_id")
    return b.groupBy("region_id", "month").agg((F.avg((c("p_mm") - c("et") - c("q_mm")) / 10) - F.avg("ds") - F.avg(c("p_mm") * 0.30) / 10).alias("dgws"))


@query("a13_aquifer_depletion", """SELECT strftime(month, '%Y-%m') AS month, count(*) AS regions, round(avg(dgws), 5) AS mean_change_mm, count(*) FILTER (WHERE round(dgws, 6) <= -15) AS emergencies, count(*) FILTER (WHERE round(dgws, 6) <= -5) AS at_least_watch FROM depletion GROUP BY 1""")
def a13(v):
    d = depletion(v).withColumn("level", water.storage_loss_level(F.round("dgws", 6)))
    return d.groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("regions"), F.round(F.avg("dgws"), 5).alias("mean_change_mm"), F.count_if(c("level") == "EMERGENCY").alias("emergencies"), F.count_if(c("level") != "NORMAL").alias("at_least_watch"))


@query("a75_baseline_anomaly", """SELECT watershed_id, strftime(m.month, '%Y-%m') AS month, round(p_mm - b, 4) AS anomaly, round(percent_rank() OVER (PARTITION BY watershed_id, month(m.month) ORDER BY p_mm), 6) AS pct_rank FROM monthly m JOIN (SELECT watershed_id, month(month) AS mm, avg(p_mm) AS b FROM monthly WHERE month BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1, 2) k USING (watershed_id) WHERE mm = month(m.month)""")
def a75(v):
    """Value less its mean in the baseline years, and its rank among the same calendar months."""
    base = (v.monthly.filter("month between date'1996-01-01' and date'1998-12-31'").groupBy("watershed_id", F.month("month").alias("mm")).agg(F.avg("p_mm").alias("b")))
    w = Window.partitionBy("watershed_id", "mm").orderBy("p_mm")
    x = v.monthly.withColumn("mm", F.month("month")).join(base, ["watershed_id", "mm"])
    return x.select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), F.round(c("p_mm") - c("b"), 4).alias("anomaly"), F.round(F.percent_rank().over(w), 6).alias("pct_rank"))


# --- availability ----------------------------------------------------------
SQL_VIEWS["outlook"] = """SELECT *, CASE WHEN wai >= 80 THEN 'abundant' WHEN wai >= 60 THEN 'sufficient' WHEN wai >= 40 THEN 'moderate' WHEN wai >= 20 THEN 'scarce' ELSE 'critical' END AS class,
    CASE WHEN risky AND wai < 30 THEN 'switch_to_palawija' WHEN risky AND wai < 50 THEN 'delay_4_weeks' WHEN wai >= 75 THEN 'proceed_on_schedule' WHEN wai >= 55 THEN 'proceed_with_caution' WHEN wai >= 40 THEN 'delay_2_weeks' ELSE 'suspend_rain_fed' END AS advice FROM (
    SELECT watershed_id, month, theta, p_mm, month(month) NOT IN (10, 11, 12, 1, 2, 3) AND watershed_id % 2 = 1 AS risky, round(greatest(least(50 + (p_mm / 620 - 1) * 100 * 0.5, 100), 0) * 0.40 + greatest(least(theta / 0.50 * 100, 100), 0) * 0.25 + greatest(least(50 + (p_mm - 620) / 60 * 1.5, 100), 0) * 0.20 + (20 + (watershed_id * 11) % 70) * 0.15, 1) AS wai,
      (p_mm - 620) / 150 AS score, 20 + (watershed_id * 11) % 70 AS fill FROM monthly)"""


def outlook(v: Views) -> DataFrame:
    k = c("watershed_id")
    fill = 20 + (k * 11) % 70
    o = v.monthly.select("watershed_id", "month", "theta", "p_mm", fill.alias("fill"), ((c("p_mm") - 620) / 150).alias("score"),
                         water.availability_index((c("p_mm") / 620 - 1) * 100, c("theta"), (c("p_mm") - 620) / 60, fill).alias("wai"))
    season = F.when(water.wet_season(F.month("month")), "MT-I").otherwise("MT-II")
    return o.withColumns({"class": water.availability_class(c("wai")), "advice": water.planting_advice(c("wai"), season, k % 2 == 0)})


@query("m29_availability_index", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, wai, class FROM outlook")
def m29(v):
    return outlook(v).select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), "wai", "class")


@query("m30_planting_advice", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, advice, concat('WAI=', CAST(CAST(floor(wai) AS BIGINT) AS VARCHAR), '/100. ', replace(advice, '_', ' ')) AS text FROM outlook")
def m30(v):
    return outlook(v).select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), "advice",
                             F.format_string("WAI=%d/100. %s", F.floor("wai"), F.replace(c("advice"), F.lit("_"), F.lit(" "))).alias("text"))


@query("m31_outlook_months", """SELECT watershed_id, strftime(month, '%Y-%m') AS month, strftime(month + INTERVAL 1 MONTH, '%Y-%m') || ',' || strftime(month + INTERVAL 2 MONTH, '%Y-%m') || ',' || strftime(month + INTERVAL 3 MONTH, '%Y-%m') AS months, round(p_mm * f * 3, 4) AS rain_3m, CAST(round((f - 1) * 100, 4) AS DOUBLE) AS anomaly_pct, round(greatest(17 * 30 - p_mm * f * 3 * 0.7 * 0.3, 0) * 10, 3) AS deficit_m3ha, CAST(conf AS DOUBLE) AS confidence
    FROM (SELECT *, [1.30, 1.12, 1.00, 0.82, 0.65][watershed_id % 5 + 1] AS f, [65.0, 75.0, 82.0, 72.0, 60.0][watershed_id % 5 + 1] AS conf FROM monthly)""")
def m31(v):
    """Phase factor applied to the next three months; crop need 17 mm/day over 30 days, 70 % of rain effective."""
    pos = (c("watershed_id") % 5 + 1).cast("int")
    # Rain factor and confidence by ENSO phase, from strong La Nina to strong El Nino.
    f = F.element_at(F.array(*map(F.lit, [1.30, 1.12, 1.00, 0.82, 0.65])), pos)
    conf = F.element_at(F.array(*map(F.lit, [65.0, 75.0, 82.0, 72.0, 60.0])), pos)
    months = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.date_format(F.add_months("month", i), "yyyy-MM"))
    rain = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: c("p_mm") * f), F.lit(0.0), lambda s, x: s + x)
    return v.monthly.select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), F.array_join(months, ",").alias("months"), F.round(rain, 4).alias("rain_3m"),
                            F.round((f - 1) * 100, 4).alias("anomaly_pct"), F.round(F.greatest(17 * 30 - rain * 0.7 * 0.3, F.lit(0.0)) * 10, 3).alias("deficit_m3ha"), conf.alias("confidence"))


SQL_VIEWS["farm"] = """SELECT *, CASE WHEN class = 'CRITICAL' THEN 'HOLD' WHEN class = 'DEFICIT' THEN season || '_DELAY' ELSE season || '_PROCEED' END AS flag FROM (
    SELECT watershed_id, month, fill, CASE WHEN month(month) IN (10, 11, 12, 1, 2, 3) THEN 'MT_I' ELSE 'MT_II' END AS season, CASE WHEN score < -1.5 OR fill < 20 OR theta < 0.15 THEN 'CRITICAL' WHEN score < -0.5 OR fill < 40 THEN 'DEFICIT' WHEN score > 0.5 THEN 'SURPLUS' ELSE 'ADEQUATE' END AS class FROM (SELECT *, greatest(least(55 + score * 15 + (theta - 0.28) * 80, 100), 5) AS fill FROM (SELECT watershed_id, month, score, theta FROM outlook)))"""


def farm(v: Views) -> DataFrame:
    o = outlook(v).withColumn("fill", water.fill_estimate_pct(c("score"), c("theta"))).withColumn("class", water.farm_class(c("score"), c("fill"), c("theta")))
    return o.withColumn("flag", water.calendar_flag(c("class"), F.month("month")))


@query("m32_farm_water_class", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, class, flag FROM farm")
def m32(v):
    return farm(v).select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), "class", "flag")


@query("m43_fill_estimate", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, round(fill, 6) AS fill_pct FROM farm")
def m43(v):
    return farm(v).select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), F.round("fill", 6).alias("fill_pct"))


@query("m42_advisory_grid", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, unnest([30, 60, 90]) AS horizon_days, class FROM farm")
def m42(v):
    return farm(v).select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), F.explode(F.array(*map(F.lit, [30, 60, 90]))).alias("horizon_days"), "class")


@query("f08_watershed_advisory", "SELECT strftime(month, '%Y-%m') AS month, class, flag FROM farm WHERE watershed_id = 7 AND month = (SELECT max(month) FROM monthly)")
def f08(v):
    """Advisories of one watershed and horizon from the newest run, kept as an array and exploded."""
    f = farm(v).filter("watershed_id = 7")
    f = f.filter(c("month") == v.monthly.agg(F.max("month")).scalar())
    rows = f.withColumn("advisories", F.transform(F.array(*map(F.lit, [30, 60, 90])), lambda h: F.struct(h.alias("horizon"), c("class").alias("class"), c("flag").alias("flag"))))
    return rows.select("month", F.inline("advisories")).filter("horizon = 30").select(F.date_format("month", "yyyy-MM").alias("month"), "class", "flag")


# provinces: every region borrows the basins of its own nations and the next one
SQL_VIEWS["bridge"] = "SELECT n_nationkey AS province_id, unnest([n_nationkey, (n_nationkey + 1) % 25, (n_nationkey + 7) % 25]) AS watershed_id FROM nation"
SQL_VIEWS["basin_now"] = """SELECT watershed_id, score, class, CASE WHEN advice IN ('switch_to_palawija', 'suspend_rain_fed') THEN 'CANCEL' WHEN advice LIKE 'delay%' THEN 'DELAY' WHEN advice = 'proceed_with_caution' THEN 'IRRIGATE' ELSE 'PROCEED' END AS rec, wai FROM outlook QUALIFY row_number() OVER (PARTITION BY watershed_id ORDER BY month DESC) = 1"""
SQL_VIEWS["province"] = """SELECT *, CASE WHEN s > 0.5 THEN 'SURPLUS' WHEN s < -0.5 THEN 'DEFICIT' ELSE 'NORMAL' END AS status, CASE WHEN s < -1.5 THEN 'RED' WHEN s < -0.5 OR s > 1.5 THEN 'YELLOW' ELSE 'GREEN' END AS action FROM (
    SELECT province_id, round(avg(score), 6) AS s, count(*) FILTER (WHERE score < -0.5) AS n_deficit, count(*) FILTER (WHERE score > 0.5) AS n_surplus, ['PROCEED','IRRIGATE','DELAY','CANCEL'][max(list_position(['PROCEED','IRRIGATE','DELAY','CANCEL'], rec))] AS advice FROM bridge JOIN basin_now USING (watershed_id) GROUP BY 1)"""


def bridge(v: Views) -> DataFrame:
    k = c("watershed_id")
    return v.watershed.select(k.alias("province_id"), F.array(k, (k + 1) % 25, (k + 7) % 25).alias("ids")).select("province_id", F.explode("ids").alias("watershed_id"))


def basin_now(v: Views) -> DataFrame:
    o = latest_per_key(outlook(v), ["watershed_id"], ["month"])
    a = c("advice")
    rec = F.when(a.isin("switch_to_palawija", "suspend_rain_fed"), "CANCEL").when(a.startswith("delay"), "DELAY").when(a == "proceed_with_caution", "IRRIGATE").otherwise("PROCEED")
    return o.select("watershed_id", "score", "class", rec.alias("rec"), "wai")


def province(v: Views) -> DataFrame:
    s = c("s")
    p = bridge(v).join(basin_now(v), "watershed_id").groupBy("province_id").agg(
        F.round(F.avg("score"), 6).alias("s"), F.count_if(c("score") < -0.5).alias("n_deficit"), F.count_if(c("score") > 0.5).alias("n_surplus"),
        worst(c("rec"), ["PROCEED", "IRRIGATE", "DELAY", "CANCEL"]).alias("advice"))
    return p.withColumns({"status": F.when(s > 0.5, "SURPLUS").when(s < -0.5, "DEFICIT").otherwise("NORMAL"),
                          "action": F.when(s < -1.5, "RED").when((s < -0.5) | (s > 1.5), "YELLOW").otherwise("GREEN")})


@query("j10_bridge_join", "SELECT province_id, watershed_id, score FROM (SELECT province_id, watershed_id, round(score, 6) AS score FROM bridge JOIN basin_now USING (watershed_id))")
def j10(v):
    return bridge(v).join(basin_now(v), "watershed_id").select("province_id", "watershed_id", F.round("score", 6).alias("score"))


@query("a11_province_index", "SELECT province_id, s AS index, n_deficit, n_surplus, advice, status, action FROM province")
def a11(v):
    return province(v).select("province_id", c("s").alias("index"), "n_deficit", "n_surplus", "advice", "status", "action")


@query("a12_dominant_class", "SELECT province_id, class FROM (SELECT province_id, class, count(*) AS n FROM bridge JOIN basin_now USING (watershed_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY province_id ORDER BY n DESC, class) = 1")
def a12(v):
    """Most frequent class; ties go to the first name (the order of arrival is not kept by a table)."""
    return J.dominant(bridge(v).join(basin_now(v), "watershed_id"), ["province_id"], "class")


@query("a76_basin_rollup", """SELECT count(*) FILTER (WHERE class = 'critical') AS critical, count(*) FILTER (WHERE class = 'scarce') AS scarce, arg_min(watershed_id, (wai, watershed_id)) AS lowest_basin, any_value(d) AS provinces_deficit, any_value(n) AS provinces_normal, any_value(red) AS red
    FROM basin_now, (SELECT count(*) FILTER (WHERE status = 'DEFICIT') AS d, count(*) FILTER (WHERE status = 'NORMAL') AS n, coalesce(string_agg(CAST(province_id AS VARCHAR), ',' ORDER BY province_id) FILTER (WHERE action = 'RED'), '') AS red FROM province)""")
def a76(v):
    p = province(v).agg(F.count_if(c("status") == "DEFICIT").alias("d"), F.count_if(c("status") == "NORMAL").alias("n"),
                        F.array_join(F.array_sort(F.collect_list(F.when(c("action") == "RED", c("province_id")))), ",").alias("red"))
    b = basin_now(v).agg(F.count_if(c("class") == "critical").alias("critical"), F.count_if(c("class") == "scarce").alias("scarce"),
                         F.min_by("watershed_id", F.struct("wai", "watershed_id")).alias("lowest_basin"))
    return b.select("*", p.select("d").scalar().alias("provinces_deficit"), p.select("n").scalar().alias("provinces_normal"), p.select("red").scalar().alias("red"))

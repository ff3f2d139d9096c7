"""Evapotranspiration, irrigation, drought, soil moisture and seasonal outlooks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raincourse.functions import calendar, climate, water
from raincourse.operators.rollup import first_available, latest_per_key, level_of, rank_of, worst
from raincourse.registry import query
from raincourse.views import SQL_VIEWS, Views

c = F.col

SQL_VIEWS["pm"] = """SELECT *, greatest((0.408 * delta * rn + gamma * 900.0 / (tm + 273.0) * wind_u2_ms * vpd)
      / greatest(delta + gamma * (1 + 0.34 * wind_u2_ms), 1e-6), 0.0) AS et0 FROM (
    SELECT *, 0.77 * rs - heat * (0.34 - 0.14 * sqrt(ea)) * greatest(least(1.35 * rs / greatest((0.75 + 2e-5 * elev_m) * ra, 0.01) - 0.35, 1.0), 0.05) AS rn FROM (
    SELECT *, greatest((0.25 + 0.50 * sunshine_hr / greatest(24.0 / pi() * ws, 0.01)) * ra, 0.0) AS rs FROM (
    SELECT *, greatest(24.0 * 60.0 / pi() * 0.082 * (1 + 0.033 * cos(season)) * (ws * sin(lat) * sin(decl) + cos(lat) * cos(decl) * sin(ws)), 0.0) AS ra FROM (
    SELECT *, acos(-tan(lat) * tan(decl)) AS ws, es * rh_pct / 100.0 AS ea, greatest(es - es * rh_pct / 100.0, 0.0) AS vpd FROM (
    SELECT *, radians(lat_deg) AS lat, 0.409 * sin(season - 1.39) AS decl, 0.5 * (e_max + e_min) AS es,
      4098.0 * 0.6108 * exp(17.27 * tm / (tm + 237.3)) / pow(tm + 237.3, 2) AS delta FROM (
    SELECT *, (tmax_c + tmin_c) / 2 AS tm, 2 * pi() * dayofyear(day) / 365.0 AS season,
      0.000665 * 101.3 * pow((293.0 - 0.0065 * elev_m) / 293.0, 5.26) AS gamma,
      0.6108 * exp(17.27 * tmax_c / (tmax_c + 237.3)) AS e_max, 0.6108 * exp(17.27 * tmin_c / (tmin_c + 237.3)) AS e_min,
      4.903e-9 * 0.5 * (pow(tmax_c + 273.16, 4) + pow(tmin_c + 273.16, 4)) AS heat FROM daily_met))))))"""


def with_et(v: Views) -> DataFrame:
    return v.daily_met.withColumns(climate.penman_monteith(
        c("tmax_c"), c("tmin_c"), c("rh_pct"), c("wind_u2_ms"), c("sunshine_hr"), c("lat_deg"), c("elev_m"),
        F.dayofyear("day")))


@query("m01_penman_monteith", """SELECT station_id, strftime(day, '%Y-%m-%d') AS day, round(et0, 6) AS et0_mm, round(rs, 6) AS rs, round(rn, 6) AS rn,
    round(gamma, 8) AS gamma, round(delta, 8) AS delta, round(vpd, 6) AS deficit_kpa FROM pm""")
def m01(v):
    return with_et(v).select("station_id", F.date_format("day", "yyyy-MM-dd").alias("day"),
                             *[F.round(x, 6).alias(x) for x in ("et0_mm", "rs", "rn", "deficit_kpa")],
                             *[F.round(x, 8).alias(x) for x in ("gamma", "delta")])


@query("m02_penman_measured_radiation", """SELECT station_id, strftime(day, '%Y-%m-%d') AS day, round(greatest((0.408 * delta * rn2 + gamma * 900.0 / (tm + 273.0) * wind_u2_ms * (es - ea))
      / (delta + gamma * (1 + 0.34 * wind_u2_ms)), 0.0), 6) AS et0_mm FROM (SELECT *, 0.77 * (10.0 + sunshine_hr) - heat * (0.34 - 0.14 * sqrt(ea)) * (1.35 * least((10.0 + sunshine_hr) / 18.0, 1.0) - 0.35) AS rn2 FROM pm)""")
def m02(v):
    et = climate.penman_monteith_measured(c("tmax_c"), c("tmin_c"), 10.0 + c("sunshine_hr"), c("rh_pct"), c("wind_u2_ms"), c("elev_m"))
    return v.daily_met.select("station_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round(et, 6).alias("et0_mm"))


CROPS = list(climate.KC)
CROPS2 = list(climate.KCB)


def pick(names: list[str], key) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))


@query("m03_crop_coefficient", """SELECT station_id, strftime(day, '%Y-%m-%d') AS day, crop, stage, round(et0 * k[stage_no], 6) AS etc_mm FROM (
    SELECT *, ['rice','corn','sugarcane','cassava','oil_palm'][station_id % 5 + 1] AS crop, CAST(station_id % 3 + 1 AS INTEGER) AS stage_no, ['ini','mid','end'][station_id % 3 + 1] AS stage,
      CASE station_id % 5 WHEN 0 THEN [1.05,1.20,0.90] WHEN 1 THEN [0.30,1.20,0.60] WHEN 2 THEN [0.40,1.25,0.75] WHEN 3 THEN [0.30,1.05,0.95] ELSE [1.00,1.00,1.00] END AS k FROM pm)""")
def m03(v):
    s = c("station_id")
    d = with_et(v).withColumns({"crop": pick(CROPS, s), "stage": pick(["ini", "mid", "end"], s)})
    kc = climate.table_value(climate.KC, c("crop"), s % 3 + 1)
    return d.select("station_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "crop", "stage",
                    F.round(c("et0_mm") * kc, 6).alias("etc_mm"))


SQL_VIEWS["need"] = """SELECT *, CASE WHEN frac > 1 THEN 'FIELD_SATURATED' WHEN need <= 0 THEN 'NO_IRRIGATION' WHEN need <= 10 THEN 'IRRIGATE_SOON' ELSE 'IRRIGATE_NOW' END AS recommendation,
      CASE WHEN need > 10 THEN 'CRITICAL_DEFICIT' WHEN need > 3 THEN 'MODERATE_DEFICIT' WHEN need > 0 THEN 'ADEQUATE' ELSE 'SURPLUS' END AS level FROM (
    SELECT *, greatest(etc - p_eff - (theta - 0.30 * 0.85) * 250.0 * 0.10, 0.0) AS need FROM (
    SELECT *, theta / 0.30 AS frac, (kcb * least(theta / 0.30, 1.0) + least(0.15 * (rain / greatest(rain + 5.0, 1.0)), 0.20)) * et0 AS etc,
      CASE WHEN rain > 5 THEN rain * 0.75 ELSE 0.0 END AS p_eff FROM (
    SELECT station_id, day, et0, crop, days, stage, (station_id * 3 + dayofyear(day)) % 12 AS rain, 0.05 + (station_id % 30) / 100.0 AS theta,
      kc[list_position(['ini','dev','mid','late'], stage)] AS kcb FROM (
    SELECT *, CASE WHEN days <= e[1] THEN 'ini' WHEN days <= e[2] THEN 'dev' WHEN days <= e[3] THEN 'mid' ELSE 'late' END AS stage FROM (
    SELECT *, ['rice','corn','sugarcane','soybean','dryland_rice'][station_id % 5 + 1] AS crop,
      CASE station_id % 5 WHEN 0 THEN [30,70,130] WHEN 1 THEN [25,60,105] WHEN 2 THEN [50,120,340] WHEN 3 THEN [20,50,95] ELSE [25,60,115] END AS e,
      CASE station_id % 5 WHEN 0 THEN [1.05,1.10,1.15,0.90] WHEN 1 THEN [0.30,0.75,1.15,0.55] WHEN 2 THEN [0.40,0.80,1.20,0.70] WHEN 3 THEN [0.40,0.80,1.10,0.50] ELSE [0.80,1.00,1.10,0.80] END AS kc,
      ((dayofyear(day) - (station_id * 17) % 365) % 365 + 365) % 365 AS days FROM pm)))))"""


def need(v: Views) -> DataFrame:
    """Irrigation need of each district and day; districts stand on stations."""
    s = c("station_id")
    d = with_et(v).withColumns({
        "crop": pick(CROPS2, s), "days": F.pmod(F.dayofyear("day") - (s * 17) % 365, F.lit(365)),
        "rain": (s * 3 + F.dayofyear("day")) % 12, "theta": 0.05 + (s % 30) / 100.0})
    d = d.withColumn("stage", climate.growth_stage(c("crop"), c("days")))
    pos = F.array_position(F.array(*map(F.lit, climate.STAGES)), c("stage"))
    d = d.withColumn("kcb", climate.table_value(climate.KCB, c("crop"), pos))
    d = d.withColumns(climate.net_irrigation(c("kcb"), c("et0_mm"), c("theta"), c("rain")))
    return d.withColumn("level", climate.district_level(c("need_mm")))


@query("m04_net_irrigation", """SELECT station_id, strftime(day, '%Y-%m-%d') AS day, round(etc, 6) AS etc_mm, round(need, 6) AS need_mm, recommendation,
    frac < 0.50 AS stress, CASE WHEN need > 0 THEN round(need * 1.15, 2) ELSE 0.0 END AS application_mm FROM need""")
def m04(v):
    return need(v).select("station_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("etc_mm", 6).alias("etc_mm"),
                          F.round("need_mm", 6).alias("need_mm"), "recommendation", "stress", "application_mm")


@query("m05_district_advisory", "SELECT station_id, strftime(day, '%Y-%m-%d') AS day, level FROM need")
def m05(v):
    return need(v).select("station_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "level")


@query("a09_national_irrigation", """SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS districts, count(*) FILTER (WHERE level = 'CRITICAL_DEFICIT') AS critical, count(*) FILTER (WHERE level = 'MODERATE_DEFICIT') AS moderate,
    count(*) FILTER (WHERE level = 'ADEQUATE') AS adequate, count(*) FILTER (WHERE level = 'SURPLUS') AS surplus, round(count(*) FILTER (WHERE level = 'CRITICAL_DEFICIT') * 100.0 / count(*), 4) AS critical_pct,
    round(avg(need), 4) AS mean_need_mm, count(*) FILTER (WHERE frac < 0.5) AS stressed, count(*) FILTER (WHERE level = 'CRITICAL_DEFICIT') * 1.0 / count(*) > 0.20 AS coupled FROM need GROUP BY 1""")
def a09(v):
    n = F.count("*")
    crit = F.count_if(c("level") == "CRITICAL_DEFICIT")
    return (need(v).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        n.alias("districts"), crit.alias("critical"), F.count_if(c("level") == "MODERATE_DEFICIT").alias("moderate"),
        F.count_if(c("level") == "ADEQUATE").alias("adequate"), F.count_if(c("level") == "SURPLUS").alias("surplus"),
        F.round(crit * 100.0 / n, 4).alias("critical_pct"), F.round(F.avg("need_mm"), 4).alias("mean_need_mm"),
        F.count_if("stress").alias("stressed"), (crit / n > 0.20).alias("coupled")))


@query("w18_growth_stage", """SELECT station_id, strftime(day, '%Y-%m-%d') AS day, stage, CASE WHEN days < e[1] THEN 'initial' WHEN days < e[2] THEN 'development' WHEN days < e[3] THEN 'mid_season' WHEN days < e[4] THEN 'late' ELSE 'initial' END AS calendar_stage
    FROM (SELECT *, CASE crop WHEN 'rice' THEN [20,50,110,140] WHEN 'corn' THEN [20,40,90,120] WHEN 'sugarcane' THEN [35,60,190,230] WHEN 'soybean' THEN [15,30,70,90] ELSE [15,35,75,100] END AS e FROM need)""")
def w18(v):
    return need(v).select("station_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "stage",
                          climate.calendar_stage(c("crop"), c("days")).alias("calendar_stage"))


@query("w19_stage_calendar", """SELECT station_id, stage, strftime(day0 + CAST(d0 AS INTEGER), '%Y-%m-%d') AS start_date, strftime(day0 + CAST(d0 + len AS INTEGER), '%Y-%m-%d') AS end_date, round(need * len, 1) AS need_mm, round(sum(round(need * len, 6)) OVER (PARTITION BY station_id), 6) AS total_mm FROM (
    SELECT *, coalesce(sum(len) OVER (PARTITION BY station_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d0 FROM (
    SELECT station_id, day0, need, unnest(['ini','dev','mid','late']) AS stage, unnest([1,2,3,4]) AS pos, unnest(CASE crop WHEN 'rice' THEN [30,40,60,30] WHEN 'corn' THEN [25,35,45,25] WHEN 'sugarcane' THEN [50,70,220,60] WHEN 'soybean' THEN [20,30,45,25] ELSE [25,35,55,25] END) AS len
    FROM (SELECT station_id, crop, min(day) AS day0, round(avg(need), 6) AS need FROM need GROUP BY 1, 2)))""")
def w19(v):
    """Stage start and end by a running sum of lengths; four rows per district."""
    days = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(s).alias("stage"),
                              climate.table_value(climate.STAGE_DAYS, c("crop"), F.lit(i + 1), "rice").alias("len"))
                     for i, s in enumerate(climate.STAGES)])
    d = (need(v).groupBy("station_id", "crop").agg(F.min("day").alias("day0"), F.round(F.avg("need_mm"), 6).alias("need"))
         .select("station_id", "day0", "need", F.inline(days)))
    w = Window.partitionBy("station_id").orderBy("pos")
    before = F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    d = d.withColumn("d0", before)
    return d.select("station_id", "stage", F.date_format(F.date_add("day0", c("d0")), "yyyy-MM-dd").alias("start_date"),
                    F.date_format(F.date_add("day0", c("d0") + c("len")), "yyyy-MM-dd").alias("end_date"),
                    F.round(c("need") * c("len"), 1).alias("need_mm"),
                    F.round(F.sum(F.round(c("need") * c("len"), 6)).over(Window.partitionBy("station_id")), 6).alias("total_mm"))


@query("a08_national_et", """SELECT strftime(day, '%Y-%m-%d') AS day, round(avg(et0), 6) AS mean_et, round(max(et0), 6) AS max_et, round(min(et0), 6) AS min_et, count(*) FILTER (WHERE et0 > 5) AS high_et FROM pm GROUP BY 1""")
def a08(v):
    e = c("et0_mm")
    return with_et(v).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(
        F.round(F.avg(e), 6).alias("mean_et"), F.round(F.max(e), 6).alias("max_et"), F.round(F.min(e), 6).alias("min_et"),
        F.count_if(e > 5).alias("high_et"))


# Monthly drought indices: normals are the mean of the calendar month of each watershed.
SQL_VIEWS["acc3"] = """SELECT *, sum(p_mm) OVER w AS p3, sum(normal) OVER w AS n3, sum(et_mm) OVER w AS e3, avg(theta) OVER w AS theta3, count(*) OVER w AS months FROM (
      SELECT *, avg(p_mm) OVER (PARTITION BY watershed_id, month(month)) AS normal FROM monthly)
    WINDOW w AS (PARTITION BY watershed_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
SQL_VIEWS["drought"] = """SELECT *, CASE WHEN idx >= -0.5 THEN 'NORMAL' WHEN idx >= -1.0 THEN 'MILD_DROUGHT' WHEN idx >= -1.5 THEN 'MODERATE_DROUGHT' WHEN idx >= -2.0 THEN 'SEVERE_DROUGHT' ELSE 'EXTREME_DROUGHT' END AS class FROM (
    SELECT *, least(spi3, spei3) AS idx FROM (SELECT *, round((p3 - n3) / greatest(n3 * 0.25, 1.0), 6) AS spi3, round((p3 - n3) / greatest(abs(n3 - e3) * 0.30, 1.0), 6) AS spei3 FROM acc3 WHERE months = 3))"""


def acc3(v: Views) -> DataFrame:
    """Three-month sums; one row per watershed and month bounds each window."""
    m = v.monthly
    normal = Window.partitionBy("watershed_id", F.month("month"))
    w = Window.partitionBy("watershed_id").orderBy("month").rowsBetween(-2, 0)
    return (m.withColumn("normal", F.avg("p_mm").over(normal))
            .withColumns({"p3": F.sum("p_mm").over(w), "n3": F.sum("normal").over(w), "e3": F.sum("et_mm").over(w),
                          "theta3": F.avg("theta").over(w), "months": F.count("*").over(w)}))


def drought(v: Views) -> DataFrame:
    return (acc3(v).filter("months = 3")
            .withColumns({"spi3": F.round(climate.spi_proxy(c("p3"), c("n3")), 6),
                          "spei3": F.round(climate.spei_proxy(c("p3"), c("n3"), c("e3")), 6)})
            .withColumn("class", climate.drought_class(F.least("spi3", "spei3"))))


@query("w09_three_month_sums", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, round(p3, 4) AS p3, round(e3, 4) AS e3, months FROM acc3")
def w09(v):
    return acc3(v).select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), F.round("p3", 4).alias("p3"),
                          F.round("e3", 4).alias("e3"), "months")


@query("m06_drought_indices", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, spi3, spei3, class, round((theta3 - 0.30) / 0.30 * 100, 4) AS moisture_anomaly_pct FROM drought")
def m06(v):
    return drought(v).select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), "spi3", "spei3", "class",
                             F.round((c("theta3") - 0.30) / 0.30 * 100, 4).alias("moisture_anomaly_pct"))


@query("a05_national_drought", """SELECT strftime(month, '%Y-%m') AS month, lv[max(r) + 1] AS worst, count(*) FILTER (WHERE r >= 1) AS at_least_mild, count(*) FILTER (WHERE r >= 3) AS at_least_severe,
    CAST(round(sum(CASE WHEN r >= 1 THEN area_km2 * s[r + 1] ELSE 0 END), 4) AS DOUBLE) AS affected_km2 FROM (
    SELECT month, area_km2, list_position(['NORMAL','MILD_DROUGHT','MODERATE_DROUGHT','SEVERE_DROUGHT','EXTREME_DROUGHT'], class) - 1 AS r, ['NORMAL','MILD_DROUGHT','MODERATE_DROUGHT','SEVERE_DROUGHT','EXTREME_DROUGHT'] AS lv, [0.0, 0.15, 0.35, 0.60, 0.85] AS s
    FROM drought JOIN watershed USING (watershed_id)) GROUP BY month, lv""")
def a05(v):
    r = rank_of(c("class"), climate.DROUGHT_LEVELS)
    share = F.element_at(F.array(*map(F.lit, climate.DROUGHT_AREA_SHARE)), c("r") + 1)
    return (drought(v).join(v.watershed.select("watershed_id", "area_km2"), "watershed_id").withColumn("r", r)
            .groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(
                level_of(F.max("r"), climate.DROUGHT_LEVELS).alias("worst"), F.count_if(c("r") >= 1).alias("at_least_mild"),
                F.count_if(c("r") >= 3).alias("at_least_severe"),
                F.round(F.sum(F.when(c("r") >= 1, c("area_km2") * share).otherwise(0.0)), 4).alias("affected_km2")))


SQL_VIEWS["deficit"] = """SELECT watershed_id, month, theta, swd, CASE WHEN swd >= 60 THEN 'EMERGENCY' WHEN swd >= 40 THEN 'WARNING' WHEN swd >= 20 THEN 'WATCH' ELSE 'NORMAL' END AS risk FROM (
    SELECT *, greatest(least((fc - theta) / (fc - 0.14) * 100, 100), 0) AS swd FROM (SELECT *, 0.34 + (watershed_id % 7) / 100.0 AS fc FROM monthly))"""


def deficit(v: Views) -> DataFrame:
    fc = 0.34 + (c("watershed_id") % 7) / 100.0
    return (v.monthly.withColumn("swd", climate.water_deficit_pct(c("theta"), fc, F.lit(0.14)))
            .withColumn("risk", climate.deficit_class(c("swd"))))


@query("m07_soil_water_deficit", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, round(swd, 6) AS swd_pct, risk FROM deficit")
def m07(v):
    return deficit(v).select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), F.round("swd", 6).alias("swd_pct"), "risk")


@query("a06_drought_risk_counts", """SELECT strftime(month, '%Y-%m') AS month, count(*) FILTER (WHERE risk <> 'NORMAL') AS warning_count, count(*) FILTER (WHERE risk = 'EMERGENCY') AS emergency_count,
    coalesce(string_agg(CAST(watershed_id AS VARCHAR), ',' ORDER BY watershed_id) FILTER (WHERE risk IN ('WARNING', 'EMERGENCY')), '') AS imbalanced FROM deficit GROUP BY 1""")
def a06(v):
    listed = F.array_sort(F.collect_list(F.when(c("risk").isin("WARNING", "EMERGENCY"), c("watershed_id"))))
    return deficit(v).groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(
        F.count_if(c("risk") != "NORMAL").alias("warning_count"), F.count_if(c("risk") == "EMERGENCY").alias("emergency_count"),
        F.array_join(listed, ",").alias("imbalanced"))


SQL_VIEWS["moist_month"] = """SELECT watershed_id, month, theta, sigma, CASE WHEN sigma IS NULL THEN -1 WHEN sigma < -1.64 THEN 4 WHEN sigma < -1.28 THEN 3 WHEN sigma < -0.84 THEN 2 WHEN sigma < -0.52 THEN 1 ELSE 0 END AS risk FROM (
    SELECT *, round((theta - [0.35,0.34,0.33,0.30,0.27,0.24,0.21,0.20,0.22,0.26,0.30,0.34][month(month)]) / [0.06,0.06,0.07,0.07,0.07,0.08,0.08,0.08,0.07,0.07,0.06,0.06][month(month)], 6) AS sigma FROM monthly)"""


def moist_month(v: Views) -> DataFrame:
    return (v.monthly.withColumn("sigma", F.round(climate.moisture_anomaly(c("theta"), F.month("month")), 6))
            .withColumn("risk", climate.moisture_risk(c("sigma"))))


@query("m08_moisture_anomaly", "SELECT watershed_id, strftime(month, '%Y-%m') AS month, sigma, risk, round(greatest(least((theta - 0.14) / (0.36 - 0.14), 1), 0), 6) AS wetness FROM moist_month")
def m08(v):
    return moist_month(v).select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), "sigma", "risk",
                                 F.round(climate.relative_wetness(c("theta"), F.lit(0.14), F.lit(0.36)), 6).alias("wetness"))


@query("a16_domain_drought_level", """SELECT month, CASE WHEN f4 >= 0.2 THEN 4 WHEN f3 >= 0.2 THEN 3 WHEN f2 >= 0.2 THEN 2 WHEN f1 >= 0.2 THEN 1 ELSE 0 END AS level FROM (
    SELECT strftime(month, '%Y-%m') AS month, avg(CAST(risk >= 4 AS INTEGER)) AS f4, avg(CAST(risk >= 3 AS INTEGER)) AS f3, avg(CAST(risk >= 2 AS INTEGER)) AS f2, avg(CAST(risk >= 1 AS INTEGER)) AS f1 FROM moist_month WHERE risk >= 0 GROUP BY 1)""")
def a16(v):
    shares = {k: F.avg((c("risk") >= k).cast("double")) for k in (4, 3, 2, 1)}
    level = F.when(shares[4] >= 0.2, 4).when(shares[3] >= 0.2, 3).when(shares[2] >= 0.2, 2).when(shares[1] >= 0.2, 1).otherwise(0)
    return moist_month(v).filter("risk >= 0").groupBy(F.date_format("month", "yyyy-MM").alias("month")).agg(level.alias("level"))


@query("f14_moisture_mask", """SELECT watershed_id, round(avg(theta), 8) AS mean_theta, round(avg(CASE WHEN theta IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS valid_fraction FROM (
    SELECT watershed_id, nullif(CASE WHEN p_mm < 200 THEN 0.0 ELSE theta END, 0.0) AS theta FROM monthly) GROUP BY 1""")
def f14(v):
    """Zero moisture means no retrieval: it becomes null and lowers the valid share."""
    t = F.nullif(F.when(c("p_mm") < 200, 0.0).otherwise(c("theta")), F.lit(0.0))
    return v.monthly.select("watershed_id", t.alias("t")).groupBy("watershed_id").agg(
        F.round(F.avg("t"), 8).alias("mean_theta"), F.round(F.avg(c("t").isNotNull().cast("double")), 6).alias("valid_fraction"))


# Seasonal forecast from a harmonic fit of the 12 monthly normals.
SQL_VIEWS["normals"] = "SELECT watershed_id, month(month) AS m, avg(p_mm) AS p_norm, avg(et_mm) AS et_norm FROM monthly GROUP BY 1, 2"
SQL_VIEWS["harmonic"] = """SELECT watershed_id, sum(p_norm) / 12 AS c0, sum(p_norm * cos(2 * pi() * m / 12)) * 2 / 12 AS a1, sum(p_norm * sin(2 * pi() * m / 12)) * 2 / 12 AS b1,
    sum(p_norm * cos(2 * pi() * m / 6)) * 2 / 12 AS a2, sum(p_norm * sin(2 * pi() * m / 6)) * 2 / 12 AS b2 FROM normals GROUP BY 1"""


def normals(v: Views) -> DataFrame:
    return v.monthly.groupBy("watershed_id", F.month("month").alias("m")).agg(
        F.avg("p_mm").alias("p_norm"), F.avg("et_mm").alias("et_norm"))


def harmonic(v: Views) -> DataFrame:
    def term(fn, period):
        return F.sum(c("p_norm") * fn(2 * math.pi * c("m") / period)) * 2 / 12

    return normals(v).groupBy("watershed_id").agg(
        (F.sum("p_norm") / 12).alias("c0"), term(F.cos, 12).alias("a1"), term(F.sin, 12).alias("b1"),
        term(F.cos, 6).alias("a2"), term(F.sin, 6).alias("b2"))


@query("a63_harmonic_fit", "SELECT watershed_id, round(c0, 4) AS c0, round(a1, 4) AS a1, round(b1, 4) AS b1, round(a2, 4) AS a2, round(b2, 4) AS b2 FROM harmonic")
def a63(v):
    return harmonic(v).select("watershed_id", *[F.round(x, 4).alias(x) for x in ("c0", "a1", "b1", "a2", "b2")])


SQL_VIEWS["context"] = """SELECT r.watershed_id, issue, coalesce(d.spei3, 0.0) AS spei3, d.spei3 IS NOT NULL AS adjusted, coalesce(a.bias, 0.0) AS bias FROM
    (SELECT watershed_id, max(month) AS issue FROM monthly GROUP BY 1) r
    LEFT JOIN (SELECT x.watershed_id, arg_max(y.spei3, y.month) AS spei3 FROM (SELECT watershed_id, max(month) AS issue FROM monthly GROUP BY 1) x JOIN drought y ON x.watershed_id = y.watershed_id
      AND y.month BETWEEN x.issue - INTERVAL 2 MONTH AND x.issue GROUP BY 1) d USING (watershed_id)
    LEFT JOIN (SELECT watershed_id, month, (theta - 0.30) / 0.30 * 100 AS bias FROM monthly) a ON a.watershed_id = r.watershed_id AND a.month = issue"""


def context(v: Views) -> DataFrame:
    """Newest drought index within three months and the moisture anomaly of the issue month."""
    m = v.monthly
    issue = m.groupBy("watershed_id").agg(F.max("month").alias("issue"))
    d = (drought(v).join(issue, "watershed_id")
         .filter(c("month").between(F.add_months("issue", -2), c("issue")))
         .groupBy("watershed_id").agg(F.max_by("spei3", "month").alias("spei3")))
    a = m.select("watershed_id", c("month").alias("issue"), ((c("theta") - 0.30) / 0.30 * 100).alias("bias"))
    return (issue.join(d, "watershed_id", "left").join(a, ["watershed_id", "issue"], "left")
            .select("watershed_id", "issue", F.coalesce("spei3", F.lit(0.0)).alias("spei3"),
                    c("spei3").isNotNull().alias("adjusted"), F.coalesce("bias", F.lit(0.0)).alias("bias")))


@query("j22_lookback_match", "SELECT watershed_id, strftime(issue, '%Y-%m') AS issue, spei3, adjusted, round(bias, 6) AS bias FROM context")
def j22(v):
    return context(v).select("watershed_id", F.date_format("issue", "yyyy-MM").alias("issue"), "spei3", "adjusted", F.round("bias", 6).alias("bias"))


SQL_VIEWS["season_month"] = """SELECT *, greatest((p - et_norm) * 0.45, 0.0) AS runoff, p < et_norm * 0.85 AS deficit FROM (
    SELECT x.*, n.p_norm, n.et_norm, greatest((c0 + a1 * cos(2 * pi() * x.m / 12) + b1 * sin(2 * pi() * x.m / 12) + a2 * cos(2 * pi() * x.m / 6) + b2 * sin(2 * pi() * x.m / 6)) * (1 + bias / 100.0 * 0.3), 0.0)
      * CASE WHEN abs(spei3) > 0.5 THEN 1.0 + greatest(least(spei3 * 0.08, 0.20), -0.20) ELSE 1.0 END AS p
    FROM (SELECT watershed_id, spei3, bias, i, (month(issue) - 1 + i) % 12 + 1 AS m FROM context, range(6) t(i)) x JOIN harmonic USING (watershed_id) JOIN normals n ON n.watershed_id = x.watershed_id AND n.m = x.m)"""


def season_month(v: Views) -> DataFrame:
    x = (context(v).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5))))
         .withColumn("m", (F.month("issue") - 1 + c("i")) % 12 + 1)
         .join(harmonic(v), "watershed_id").join(normals(v), ["watershed_id", "m"]))
    p = F.greatest(climate.harmonic_value(*map(c, ("c0", "a1", "b1", "a2", "b2", "m"))) * (1 + c("bias") / 100.0 * 0.3), F.lit(0.0))
    spei = F.when(F.abs("spei3") > 0.5, 1.0 + F.greatest(F.least(c("spei3") * 0.08, F.lit(0.20)), F.lit(-0.20))).otherwise(1.0)
    return (x.withColumn("p", p * spei)
            .withColumns({"runoff": F.greatest((c("p") - c("et_norm")) * 0.45, F.lit(0.0)),
                          "deficit": c("p") < c("et_norm") * 0.85}))


@query("m35_seasonal_forecast", "SELECT watershed_id, i, m, round(p, 4) AS p_mm, round(runoff, 4) AS runoff_mm, deficit FROM season_month")
def m35(v):
    return season_month(v).select("watershed_id", "i", "m", F.round("p", 4).alias("p_mm"), F.round("runoff", 4).alias("runoff_mm"), "deficit")


SQL_VIEWS["season"] = """SELECT *, CASE WHEN ratio < 0.55 THEN 'CRITICAL' WHEN ratio < 0.75 THEN 'DEFICIT' WHEN ratio < 0.90 THEN 'CAUTION' ELSE 'FAVORABLE' END AS advisory FROM (
    SELECT watershed_id, sum(p) / greatest(sum(p_norm), 1.0) AS ratio, count(*) FILTER (WHERE deficit) AS deficit_months FROM season_month GROUP BY 1)"""


def season(v: Views) -> DataFrame:
    """Months of a forecast as one array; deficit months counted by array functions."""
    a = season_month(v).groupBy("watershed_id").agg(
        F.array_sort(F.collect_list(F.struct("i", "p", "p_norm", "et_norm"))).alias("s"))
    dry = F.zip_with(F.transform("s", lambda x: x.p), F.transform("s", lambda x: x.et_norm), lambda p, e: p < e * 0.85)
    total = [F.aggregate("s", F.lit(0.0), lambda t, x: t + x[n]) for n in ("p", "p_norm")]
    return (a.select("watershed_id", (total[0] / F.greatest(total[1], F.lit(1.0))).alias("ratio"),
                     F.size(F.filter(dry, lambda d: d)).cast("long").alias("deficit_months"))
            .withColumn("advisory", climate.seasonal_advisory(c("ratio"))))


@query("y02_deficit_months", "SELECT watershed_id, round(ratio, 6) AS ratio, deficit_months, advisory FROM season")
def y02(v):
    return season(v).select("watershed_id", F.round("ratio", 6).alias("ratio"), "deficit_months", "advisory")


@query("a10_seasonal_outlook", """SELECT count(*) AS watersheds, ['FAVORABLE','CAUTION','DEFICIT','CRITICAL'][max(list_position(['FAVORABLE','CAUTION','DEFICIT','CRITICAL'], advisory))] AS worst_advisory,
    count(*) FILTER (WHERE advisory IN ('DEFICIT','CRITICAL')) AS deficit_watersheds, round(avg(deficit_months), 6) AS mean_deficit_months FROM season""")
def a10(v):
    return season(v).agg(F.count("*").alias("watersheds"), worst(c("advisory"), climate.ADVISORY_LEVELS).alias("worst_advisory"),
                         F.count_if(c("advisory").isin("DEFICIT", "CRITICAL")).alias("deficit_watersheds"),
                         F.round(F.avg("deficit_months"), 6).alias("mean_deficit_months"))


@query("j15_forecast_skill", """SELECT o.watershed_id, strftime(o.month, '%Y-%m') AS month, round(greatest(0.0, 1.0 - abs(o.p_mm / greatest(f.p_norm, 1.0) - 1.0)), 6) AS skill
    FROM monthly o JOIN normals f ON o.watershed_id = f.watershed_id AND month(o.month) = f.m""")
def j15(v):
    o = v.monthly.withColumn("m", F.month("month")).join(normals(v), ["watershed_id", "m"])
    skill = F.greatest(F.lit(0.0), 1.0 - F.abs(c("p_mm") / F.greatest("p_norm", F.lit(1.0)) - 1.0))
    return o.select("watershed_id", F.date_format("month", "yyyy-MM").alias("month"), F.round(skill, 6).alias("skill"))


@query("m20_curve_number_runoff", """SELECT station_id, strftime(day, '%Y-%m-%d') AS day, round(cn, 6) AS cn, round(CASE WHEN precip_mm <= 0.2 * s THEN 0.0 ELSE pow(precip_mm - 0.2 * s, 2) / (precip_mm + 0.8 * s) END, 6) AS runoff_mm FROM (
    SELECT *, 25400.0 / cn - 254.0 AS s FROM (SELECT *, greatest(least(CASE WHEN r < 0.35 THEN 4.2 * cn2 / (10 - 0.058 * cn2) WHEN r > 0.70 THEN 23 * cn2 / (10 + 0.13 * cn2) ELSE cn2 END, 99.0), 30.0) AS cn FROM (
    SELECT *, 60.0 + station_id % 30 AS cn2, greatest(least(aux_sum / 300.0, 1.0), 0.0) AS r FROM daily)))""")
def m20(v):
    from raincourse.functions import flood

    d = v.daily.withColumn("cn", flood.curve_number(60.0 + c("station_id") % 30, c("aux_sum")))
    return d.select("station_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("cn", 6).alias("cn"),
                    F.round(flood.curve_number_runoff(c("precip_mm"), c("cn")), 6).alias("runoff_mm"))


@query("j24_input_chain", """SELECT d.station_id, strftime(d.day, '%Y-%m-%d') AS day, round(coalesce(o.rain, n.rain, 4.5), 6) AS rain_mm, CASE WHEN o.rain IS NOT NULL THEN 'district' WHEN n.rain IS NOT NULL THEN 'national' ELSE 'climatology' END AS source
    FROM daily d LEFT JOIN (SELECT station_id, day, precip_mm AS rain FROM daily WHERE n_obs >= 3) o USING (station_id, day), (SELECT avg(precip_mm) AS rain FROM daily WHERE n_obs >= 3) n""")
def j24(v):
    """Entity value, else the national mean (a scalar subquery), else climatology."""
    good = v.daily.filter("n_obs >= 3")
    national = good.agg(F.avg("precip_mm")).scalar()
    own = good.select("station_id", "day", c("precip_mm").alias("rain"))
    d = v.daily.select("station_id", "day").join(own, ["station_id", "day"], "left").withColumn("nat", national)
    pair = first_available([(c("rain"), "district"), (c("nat"), "national"), (F.lit(4.5), "climatology")], "v", "source")
    return d.select("station_id", F.date_format("day", "yyyy-MM-dd").alias("day"), *pair).withColumn("rain_mm", F.round("v", 6)).drop("v")


# Calendar features.
@query("d01_cyclic_time", """SELECT event_id, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dow_sin,
    round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dow_cos, round(sin(2 * pi() * dayofyear(ts) / 365.25), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25), 6) AS doy_cos,
    round(sin(2 * pi() * month(ts) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ts) / 12), 6) AS month_cos, month(ts) IN (10, 11, 12, 1, 2, 3) AS wet FROM events""")
def d01(v):
    return v.obs.select("event_id", *[F.round(e, 6).alias(n) for n, e in calendar.cyclic(c("ts")).items()],
                        water.wet_season(F.month("ts")).alias("wet"))


@query("d02_composite_day", "SELECT o_orderkey, CAST((dayofyear(o_orderdate) - 1) // 8 * 8 + 1 AS INTEGER) AS composite_day FROM orders")
def d02(v):
    return v.table("orders").select("o_orderkey", calendar.composite_day(c("o_orderdate")).alias("composite_day"))


@query("d03_month_steps", """SELECT flow_id, strftime(date_trunc('month', day) - INTERVAL 1 MONTH, '%Y-%m-%d') AS prev_month, day(last_day(day)) AS days, round(discharge_cms * 86400 * day(last_day(day)) * 1e3 / ((100.0 + river_id * 40) * 1e6) * 1e3, 2) AS q_mm FROM flow""")
def d03(v):
    days = F.dayofmonth(F.last_day("day"))
    q = water.discharge_mm_month(c("discharge_cms"), days, 100.0 + c("river_id") * 40)
    return v.flow.select("flow_id", F.date_format(F.add_months(F.trunc("day", "month"), -1), "yyyy-MM-dd").alias("prev_month"),
                         days.cast("long").alias("days"), q.alias("q_mm"))


@query("d04_season_label", "SELECT flow_id, CASE WHEN month(day) IN (10, 11, 12, 1, 2, 3) THEN 'MT-I' ELSE 'MT-II' END AS season FROM flow")
def d04(v):
    return v.flow.select("flow_id", F.when(water.wet_season(F.month("day")), "MT-I").otherwise("MT-II").alias("season"))


@query("d05_holiday_flag", """SELECT f.flow_id, h.holiday IS NOT NULL AS is_holiday, coalesce(h.holiday, '') AS holiday, coalesce(h.k, 0) AS days_after FROM flow f LEFT JOIN
    (SELECT CAST(make_date(y, m, d) + k AS DATE) AS day, n AS holiday, CAST(k AS INTEGER) AS k FROM (SELECT DISTINCT year(day) AS y FROM flow) CROSS JOIN (VALUES (1, 1, 'Tahun Baru'), (5, 1, 'Hari Buruh'), (6, 1, 'Hari Pancasila'), (8, 17, 'Hari Kemerdekaan'), (12, 25, 'Hari Natal')) t(m, d, n)
      CROSS JOIN (VALUES (0), (1)) u(k)) h USING (day)""")
def d05(v):
    """Fixed dates, and the day after them, for every year in the data."""
    days = calendar.fixed_dates(v.flow.select(F.year("day").alias("y")).distinct(), "y")
    return (v.flow.join(days, "day", "left")
            .select("flow_id", c("holiday").isNotNull().alias("is_holiday"), F.coalesce("holiday", F.lit("")).alias("holiday"),
                    F.coalesce("offset", F.lit(0)).alias("days_after")))


def forecast_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count and total of the forecast rows of each cell, combined before the shuffle."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("precip_mm"), 6).alias("rain"))

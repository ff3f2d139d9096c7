"""Flash floods, river warnings, stage, inundation and their rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raincourse.functions import flood
from raincourse.operators.ordered import drop_halo, time_blocks
from raincourse.operators.rollup import latest_per_key, level_of, rank_of, worst
from raincourse.registry import query
from raincourse.views import SQL_VIEWS, Views

DAY = 86400

SQL_VIEWS["rain3h"] = """SELECT station_id, slot, sum(precip_mm) OVER (PARTITION BY station_id ORDER BY slot
    RANGE BETWEEN INTERVAL 150 MINUTES PRECEDING AND CURRENT ROW) AS rain_3h FROM half_hour"""
SQL_VIEWS["guidance"] = """SELECT *, CASE WHEN soil_moisture > 0.85 * porosity THEN 5.0 ELSE
    greatest(round(round(250.0 * (porosity - 0.10) * (1 - least(soil_moisture / porosity, 1.0))
      * CASE WHEN slope_deg > 15 THEN 0.55 WHEN slope_deg > 5 THEN 0.80 ELSE 1.0 END * 0.30, 9), 2), 5.0) END AS ffg
    FROM station"""
SQL_VIEWS["flash0"] = """SELECT r.station_id, r.slot, g.nation_id, round(r.rain_3h, 6) AS rain_3h, g.ffg, g.area_km2, g.slope_deg,
    round(round(r.rain_3h, 6) / g.ffg, 4) AS ffi FROM rain3h r JOIN guidance g USING (station_id)"""
SQL_VIEWS["flash"] = """SELECT station_id, slot, nation_id, rain_3h, ffg, ffi,
    CASE WHEN ffi >= 1.0 THEN 'EMERGENCY' WHEN ffi >= 0.7 THEN 'WARNING' WHEN ffi >= 0.5 THEN 'WATCH' ELSE 'CLEAR' END AS level,
    CAST(greatest(floor(greatest(floor(20.0 * pow(area_km2, 0.35) / sqrt(tan(radians(greatest(slope_deg, 1.0))))), 10)
      * greatest(1.0 - greatest(ffi - 0.7, 0.0) * 2.0, 0.15)), 10) AS INTEGER) AS onset_min
    FROM flash0"""


def rain_3h(v: Views) -> DataFrame:
    """Sum of the last six half-hours; a missing half-hour is no rain."""
    w = (Window.partitionBy("station_id", "_block").orderBy(F.col("slot").cast("long"))
         .rangeBetween(-150 * 60, 0))
    return drop_halo(time_blocks(v.half_hour, "slot", 150 * 60, 30 * DAY)
                     .withColumn("rain_3h", F.sum("precip_mm").over(w)))


def flash(v: Views) -> DataFrame:
    s = v.station.withColumn("ffg", flood.guidance_3h_mm(F.col("soil_moisture"), F.col("porosity"), F.col("slope_deg")))
    return (rain_3h(v).withColumn("rain_3h", F.round("rain_3h", 6)).join(s, "station_id")
            .withColumn("ffi", flood.flash_index(F.col("rain_3h"), F.col("ffg")))
            .select("station_id", "slot", "nation_id", "rain_3h", "ffg", "ffi",
                    flood.flash_level(F.col("ffi")).alias("level"),
                    flood.onset_minutes(F.col("area_km2"), F.col("slope_deg"), F.col("ffi")).alias("onset_min")))


@query("w08_rain_3h", "SELECT station_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, round(rain_3h, 4) AS rain_3h FROM rain3h")
def w08(v):
    return rain_3h(v).select("station_id", F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("slot"),
                             F.round("rain_3h", 4).alias("rain_3h"))


@query("m09_flash_flood_index", "SELECT station_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, ffg, ffi, level, onset_min FROM flash")
def m09(v):
    return flash(v).select("station_id", F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("slot"),
                           "ffg", "ffi", "level", "onset_min")


@query("a02_flash_flood_rollup", """
    WITH newest AS (SELECT * FROM flash QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY slot DESC) = 1)
    SELECT n_regionkey AS region_id, count(*) AS stations, count(*) FILTER (WHERE level <> 'CLEAR') AS active,
      ['CLEAR','WATCH','WARNING','EMERGENCY'][max(list_position(['CLEAR','WATCH','WARNING','EMERGENCY'], level))] AS worst_level,
      min(onset_min) AS first_onset_min
    FROM newest JOIN nation ON nation_id = n_nationkey GROUP BY 1""")
def a02(v):
    """Flash flood state by region from the newest reading of each station."""
    newest = latest_per_key(flash(v), ["station_id"], ["slot"])
    return (newest.join(v.watershed, newest.nation_id == F.col("watershed_id"))
            .groupBy("region_id")
            .agg(F.count("*").alias("stations"), F.count_if(F.col("level") != "CLEAR").alias("active"),
                 worst(F.col("level"), flood.FLASH_LEVELS).alias("worst_level"),
                 F.min("onset_min").alias("first_onset_min")))


# River forecasts: the newest daily mean flow of a river stands for the present.
SQL_VIEWS["river_now"] = """SELECT d.river_id, d.day, d.discharge_cms, w.area_km2, 10.0 + river_id AS base_cms,
    3.0 + river_id % 16 AS tc_hr, 100.0 + river_id * 20 AS threshold_cms, 150.0 + river_id * 10 AS bankfull_cms,
    0.20 + (river_id % 10) * 0.02 AS theta, (river_id * 7) % 30 AS rain_mm
    FROM (SELECT * FROM daily_flow QUALIFY row_number() OVER (PARTITION BY river_id ORDER BY day DESC) = 1) d
    JOIN watershed w ON w.watershed_id = d.river_id"""


def river_now(v: Views) -> DataFrame:
    r = F.col("river_id")
    return (latest_per_key(v.daily_flow, ["river_id"], ["day"])
            .join(v.watershed.select(F.col("watershed_id").alias("river_id"), "area_km2"), "river_id")
            .select("river_id", "day", "discharge_cms", "area_km2", (10.0 + r).alias("base_cms"),
                    (3.0 + r % 16).alias("tc_hr"), (100.0 + r * 20).alias("threshold_cms"),
                    (150.0 + r * 10).alias("bankfull_cms"), (0.20 + (r % 10) * 0.02).alias("theta"),
                    ((r * 7) % 30).alias("rain_mm")))


SQL_VIEWS["forecast"] = """SELECT river_id, threshold_cms, area_km2, lead_hr, rain_mm, theta, tc_hr, base_cms, q0,
    greatest(round(flow * pow(greatest(flow, 0.01) / greatest(base_cms, 0.01), 0.45), 2), base_cms * 0.1) AS forecast_cms
    FROM (SELECT *, CASE WHEN lead_hr <= tc_hr THEN q0 + lead_hr / tc_hr * greatest(
          least(0.3 + theta / 0.4 * 0.45, 0.9) * (rain_mm * 2.0 / lead_hr) * area_km2 * 100.0 / 360.0 - q0, 0.0)
        ELSE base_cms + (q0 - base_cms) * pow(0.5, (lead_hr - tc_hr) / tc_hr) END AS flow
      FROM (SELECT *, greatest(least(0.3 + theta / 0.4 * 0.4, 0.9) * (rain_mm / 0.5) * area_km2 * 100.0 / 360.0,
              base_cms * 0.5) AS q0, unnest([6, 12, 24]) AS lead_hr FROM river_now))"""


def forecast(v: Views) -> DataFrame:
    c = F.col
    return (river_now(v)
            .withColumn("q0", flood.rational_discharge(c("rain_mm"), c("theta"), c("area_km2"), c("base_cms")))
            .withColumn("lead_hr", F.explode(F.array(F.lit(6), F.lit(12), F.lit(24))))
            .withColumn("forecast_cms", flood.persistence_forecast(
                c("q0"), c("rain_mm"), c("theta"), c("area_km2"), c("base_cms"), c("tc_hr"), c("lead_hr"))))


@query("m17_streamflow_forecast", """SELECT river_id, lead_hr, round(q0, 4) AS q0, round(forecast_cms, 2) AS forecast_cms,
    CAST(round(greatest(least(greatest(90.0 - 24 * 1.1, 50.0) - CASE WHEN rain_mm > 20 THEN 10.0 ELSE 0.0 END
      - CASE WHEN theta > 0.35 THEN 5.0 ELSE 0.0 END, 95.0), 40.0), 1) AS DOUBLE) AS confidence FROM forecast""")
def m17(v):
    return forecast(v).select("river_id", "lead_hr", F.round("q0", 4).alias("q0"),
                              F.round("forecast_cms", 2).alias("forecast_cms"),
                              F.round(flood.forecast_confidence(F.col("rain_mm"), F.col("theta"), F.lit(24)), 1).alias("confidence"))


SQL_VIEWS["warning"] = """SELECT river_id, threshold_cms, peak_cms, peak_hr, CASE WHEN ratio >= 1.0 THEN 'RED' WHEN ratio >= 0.9 THEN 'ORANGE'
    WHEN ratio >= 0.7 THEN 'YELLOW' ELSE 'GREEN' END AS level
    FROM (SELECT river_id, any_value(threshold_cms) AS threshold_cms, max(forecast_cms) AS peak_cms,
      arg_max(lead_hr, (forecast_cms, -lead_hr)) AS peak_hr, max(forecast_cms) / any_value(threshold_cms) AS ratio
      FROM forecast GROUP BY 1)"""


def warning(v: Views) -> DataFrame:
    """Peak over the horizons, its lead time (the shortest on ties) and the level."""
    peak = F.max_by("lead_hr", F.struct("forecast_cms", -F.col("lead_hr")))
    return (forecast(v).groupBy("river_id", "threshold_cms")
            .agg(F.max("forecast_cms").alias("peak_cms"), peak.alias("peak_hr"))
            .withColumn("level", flood.river_level(F.col("peak_cms"), F.col("threshold_cms"))))


@query("w17_peak_horizon", "SELECT river_id, round(peak_cms, 2) AS peak_cms, peak_hr FROM warning")
def w17(v):
    return warning(v).select("river_id", F.round("peak_cms", 2).alias("peak_cms"), "peak_hr")


@query("m19_river_warning_level", """SELECT flow_id, CASE WHEN r >= 1.0 THEN 'RED' WHEN r >= 0.9 THEN 'ORANGE' WHEN r >= 0.7 THEN 'YELLOW'
    ELSE 'GREEN' END AS level FROM (SELECT flow_id, discharge_cms / (100.0 + river_id * 20) AS r FROM flow)""")
def m19(v):
    return v.flow.select("flow_id", flood.river_level(F.col("discharge_cms"), 100.0 + F.col("river_id") * 20).alias("level"))


@query("a01_flood_rollup", """SELECT count(*) AS rivers, count(*) FILTER (WHERE level <> 'GREEN') AS at_risk,
    ['GREEN','YELLOW','ORANGE','RED'][max(list_position(['GREEN','YELLOW','ORANGE','RED'], level))] AS worst_level FROM warning""")
def a01(v):
    return warning(v).agg(F.count("*").alias("rivers"), F.count_if(F.col("level") != "GREEN").alias("at_risk"),
                          worst(F.col("level"), flood.RIVER_LEVELS).alias("worst_level"))


@query("j14_threshold_join", """SELECT f.flow_id, coalesce(arg_max(l.stage, l.cms), 'NONE') AS stage, CAST(max(l.cms) AS DOUBLE) AS breached
    FROM flow f LEFT JOIN (SELECT n_nationkey AS river_id, unnest(['WATCH','WARNING','EMERGENCY']) AS stage,
      unnest([100.0 + n_nationkey, 250.0 + n_nationkey, 400.0 + n_nationkey]) AS cms FROM nation) l
    ON f.river_id = l.river_id AND f.discharge_cms >= l.cms GROUP BY 1""")
def j14(v):
    """Class by ordered limits per river: limits sit in one array per river, so the join is an equi-join."""
    k = F.col("watershed_id")
    limits = v.watershed.select(k.alias("river_id"), F.array(*[
        F.struct((F.lit(x) + k).alias("cms"), F.lit(s).alias("stage"))
        for x, s in [(100.0, "WATCH"), (250.0, "WARNING"), (400.0, "EMERGENCY")]]).alias("limits"))
    hit = F.array_max(F.filter("limits", lambda x: F.col("discharge_cms") >= x.cms))
    return (v.flow.join(limits, "river_id").withColumn("hit", hit)
            .select("flow_id", F.coalesce("hit.stage", F.lit("NONE")).alias("stage"), F.col("hit.cms").alias("breached")))


SQL_VIEWS["stage_flow"] = """SELECT flow_id, river_id, day, discharge_cms, 400.0 + (river_id % 3) * 150 AS s3, 500.0 + (river_id % 3) * 150 AS s2,
    600.0 + (river_id % 3) * 150 AS s1, 150.0 + river_id * 10 AS bankfull FROM flow"""


def stage_flow(v: Views) -> DataFrame:
    b = (F.col("river_id") % 3) * 150
    return v.flow.select("flow_id", "river_id", "day", "discharge_cms", (400.0 + b).alias("s3"), (500.0 + b).alias("s2"),
                         (600.0 + b).alias("s1"), (150.0 + F.col("river_id") * 10).alias("bankfull"))


@query("m15_stage_and_siaga", """SELECT flow_id, round(stage, 2) AS stage_cm, round(CASE WHEN discharge_cms <= 0 THEN 400.0 ELSE 82.4 * pow(discharge_cms, 0.43) END, 2) AS gauge_cm,
    CASE WHEN stage >= s1 THEN 'siaga1' WHEN stage >= s2 THEN 'siaga2' WHEN stage >= s3 THEN 'siaga3' ELSE 'none' END AS siaga
    FROM (SELECT *, greatest(s3 / pow(bankfull, 0.45) * pow(greatest(discharge_cms, 0.1), 0.45), 100.0) AS stage FROM stage_flow)""")
def m15(v):
    c = F.col
    return (stage_flow(v).withColumn("stage", flood.bankfull_stage_cm(c("discharge_cms"), c("bankfull"), c("s3")))
            .select("flow_id", F.round("stage", 2).alias("stage_cm"),
                    F.round(flood.gauge_stage_cm(c("discharge_cms")), 2).alias("gauge_cm"),
                    flood.siaga(c("stage"), c("s3"), c("s2"), c("s1")).alias("siaga")))


@query("m16_return_period", """SELECT flow_id, round(p, 6) AS exceedance, CASE WHEN p > 1e-6 THEN round(1 / p, 3) END AS return_years FROM (
    SELECT flow_id, least(greatest(1 - exp(-pow(greatest(t, 1e-12), -1 / xi)), 0.0), 1.0) AS p FROM (
      SELECT flow_id, xi, 1 + xi * (300.0 + discharge_cms - 455.0) / 95.0 AS t FROM (
        SELECT flow_id, discharge_cms, CASE river_id % 3 WHEN 0 THEN -0.12 WHEN 1 THEN -0.08 ELSE -0.15 END AS xi FROM flow)))""")
def m16(v):
    r = F.col("river_id") % 3
    xi = F.when(r == 0, -0.12).when(r == 1, -0.08).otherwise(-0.15)
    p = flood.gev_exceedance(300.0 + F.col("discharge_cms"), xi, F.lit(455.0), F.lit(95.0))
    return v.flow.select("flow_id", p.alias("p")).select(
        "flow_id", F.round("p", 6).alias("exceedance"),
        F.when(F.col("p") > 1e-6, F.round(1 / F.nullif(F.col("p"), F.lit(0.0)), 3)).alias("return_years"))


SQL_VIEWS["recession"] = """SELECT flow_id, river_id, day, s3, s2, s1, bankfull, discharge_cms, discharge_cms * 0.92 + rr AS q_6h, discharge_cms * 0.82 + rr * 0.65 AS q_12h,
    discharge_cms * 0.68 + rr * 0.65 * 0.50 AS q_24h FROM (SELECT *, (flow_id % 40) * (1.0 + greatest(
      (0.20 + (flow_id % 20) / 100.0 - 0.25) / 0.15, 0.0)) * bankfull / 180.0 AS rr FROM stage_flow)"""


def recession(v: Views) -> DataFrame:
    c = F.col
    return stage_flow(v).withColumns(flood.recession_forecast(
        c("discharge_cms"), c("flow_id") % 40, 0.20 + (c("flow_id") % 20) / 100.0, c("bankfull")))


@query("m18_recession_forecast", "SELECT flow_id, round(q_6h, 8) AS q_6h, round(q_12h, 8) AS q_12h, round(q_24h, 8) AS q_24h FROM recession")
def m18(v):
    return recession(v).select("flow_id", *[F.round(c, 8).alias(c) for c in ("q_6h", "q_12h", "q_24h")])


@query("m14_rating_and_analytical_area", """SELECT flow_id, round(h, 3) AS wse_m, round(w / 1000.0 * 119.0, 3) AS area_km2, round(greatest(h - bf, 0.0) * 0.4, 3) AS mean_depth_m
    FROM (SELECT flow_id, h, bf, CASE WHEN h > bf THEN least(40.0 + (h - bf) / bf * 2500.0, 2500.0) ELSE 40.0 END AS w
      FROM (SELECT flow_id, 0.45 * pow(greatest(discharge_cms, 0.01), 0.38) AS h, 0.45 * pow(bankfull, 0.38) AS bf FROM stage_flow))""")
def m14(v):
    c = F.col
    h = flood.rating_stage(c("discharge_cms"), F.lit(0.45), F.lit(0.38))
    bf = flood.rating_stage(c("bankfull"), F.lit(0.45), F.lit(0.38))
    a = flood.analytical_inundation(c("h"), c("bf"), F.lit(40.0), F.lit(2500.0), F.lit(119.0))
    return (stage_flow(v).select("flow_id", h.alias("h"), bf.alias("bf"))
            .select("flow_id", F.round("h", 3).alias("wse_m"), *[e.alias(n) for n, e in a.items()]))


SQL_VIEWS["extent"] = """SELECT *, CASE WHEN depth > bank THEN tw ELSE width * 1.2 END AS flood_width_m,
      CASE WHEN depth > bank THEN greatest(tw * 3.0 / 1000.0, 5.0) ELSE 10.0 END AS flood_length_km FROM (
    SELECT *, round(width + least(plain / bank * fp, fp), 1) AS tw FROM (
    SELECT *, greatest(depth - bank, CASE WHEN discharge_cms <= 0 THEN 0 ELSE pow(discharge_cms * 0.3 * 0.08 / (fp * sqrt(slope)), 0.6) END) AS plain FROM (
    SELECT flow_id, river_id, day, discharge_cms, width, fp, bank, slope,
      CASE WHEN discharge_cms <= 0 THEN 0 ELSE pow(discharge_cms * 0.035 / (width * sqrt(slope)), 0.6) END AS depth FROM (
    SELECT *, 30.0 + river_id * 4 AS width, 800.0 + river_id * 50 AS fp, 2.5 + (river_id % 4) * 0.5 AS bank, 0.0004 AS slope FROM flow))))"""


def extent(v: Views) -> DataFrame:
    r = F.col("river_id")
    c = F.col
    x = v.flow.select("flow_id", "river_id", "day", "discharge_cms", (30.0 + r * 4).alias("width"), (800.0 + r * 50).alias("fp"),
                      (2.5 + (r % 4) * 0.5).alias("bank"), F.lit(0.0004).alias("slope"))
    return x.withColumns(flood.inundation(c("discharge_cms"), c("width"), c("fp"), c("bank"), c("slope"),
                                          F.lit(0.035), F.lit(0.08)))


@query("m13_inundation_extent", """SELECT flow_id, round(depth, 2) AS depth_m, depth > bank AS overbank, CASE WHEN depth > bank THEN round(plain, 2) ELSE 0.0 END AS plain_depth_m,
    round(flood_width_m, 3) AS flood_width_m, round(flood_length_km, 4) AS flood_length_km, round(flood_width_m * flood_length_km * 1000 / 1e6, 5) AS area_km2 FROM extent""")
def m13(v):
    return extent(v).select("flow_id", "depth_m", "overbank", "plain_depth_m", F.round("flood_width_m", 3).alias("flood_width_m"),
                            F.round("flood_length_km", 4).alias("flood_length_km"), F.round("area_km2", 5).alias("area_km2"))


@query("k06_villages_affected", """SELECT flow_id, n, list_aggregate(list_transform(range(1, n + 1), lambda i: concat('v', river_id, '_', i)), 'string_agg', ',') AS villages
    FROM (SELECT flow_id, river_id, CASE WHEN depth > bank THEN least(8, greatest(1, CAST(floor(flood_width_m * flood_length_km * 1000 / 1e6 / 5) AS INTEGER))) ELSE 0 END AS n FROM extent)
    WHERE n > 0""")
def k06(v):
    """First n villages of a river, n by area; in-bank flow touches none."""
    names = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.concat(F.lit("v"), F.col("river_id").cast("string"), F.lit("_"), i.cast("string")))
    n = F.least(F.size(names), F.greatest(F.lit(1), F.floor(F.col("area_km2") / 5).cast("int")))
    return (extent(v).filter("overbank").withColumn("n", n)
            .select("flow_id", "n", F.array_join(F.slice(names, F.lit(1), F.col("n")), ",").alias("villages")))


@query("s16_flood_polygon", """SELECT flow_id, round(lon - w, 6) AS west, round(lon + w, 6) AS east, round(lat - l, 6) AS south, round(lat + l, 6) AS north
    FROM (SELECT flow_id, -7.0 + river_id * 0.1 AS lat, 107.0 + river_id * 0.2 AS lon, flood_width_m / 1000.0 / 111.0 / 2 AS w, flood_length_km / 111.0 / 2 AS l FROM extent)""")
def s16(v):
    from raincourse.sources.sinks import flood_polygon_json

    r = F.col("river_id")
    poly = extent(v).withColumns({"lat": -7.0 + r * 0.1, "lon": 107.0 + r * 0.2})
    text = flood_polygon_json(F.col("lon"), F.col("lat"), F.col("flood_width_m"), F.col("flood_length_km"),
                              {"river_id": r, "area_km2": F.round("area_km2", 3)})
    ring = "$.geometry.coordinates[0]"
    return poly.select("flow_id", text.alias("j")).select(
        "flow_id", *[F.round(F.get_json_object("j", f"{ring}[{i}][{k}]").cast("double"), 6).alias(n)
                     for n, i, k in [("west", 0, 0), ("east", 1, 0), ("south", 0, 1), ("north", 2, 1)]])


SQL_VIEWS["river_day"] = """SELECT river_id, day, CASE WHEN stage >= 700 THEN 'siaga1' WHEN stage >= 650 THEN 'siaga2' WHEN stage >= 600 THEN 'siaga3' ELSE 'none' END AS level
    FROM (SELECT river_id, day, 82.4 * pow(discharge_cms, 0.43) - 300 AS stage FROM daily_flow)"""


def river_day(v: Views) -> DataFrame:
    stage = flood.gauge_stage_cm(F.col("discharge_cms")) - 300
    return v.daily_flow.select("river_id", "day", flood.siaga(stage, F.lit(600), F.lit(650), F.lit(700)).alias("level"))


@query("w22_alert_state_change", """SELECT river_id, strftime(day, '%Y-%m-%d') AS day, level, CASE WHEN level <> 'none' THEN 'create' ELSE 'resolve' END AS action
    FROM (SELECT *, lag(level, 1, 'none') OVER (PARTITION BY river_id ORDER BY day) AS prev FROM river_day) WHERE level <> prev""")
def w22(v):
    """One row per day and river, so a river's series is bounded by the calendar."""
    w = Window.partitionBy("river_id").orderBy("day")
    return (river_day(v).withColumn("prev", F.lag("level", 1, "none").over(w)).filter(F.col("level") != F.col("prev"))
            .select("river_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "level",
                    F.when(F.col("level") != "none", "create").otherwise("resolve").alias("action")))


@query("x01_alert_text", """SELECT flow_id, concat('flood-', river_id, '-', strftime(day, '%Y%m%d'), '-', siaga) AS alert_id,
    upper(concat(siaga, ': river ', river_id)) AS title, concat('Streamflow forecast: ', CAST(round(q_6h) AS BIGINT), 'm3/s at 6h, ', CAST(round(q_12h) AS BIGINT), 'm3/s at 12h') AS description
    FROM (SELECT *, CASE WHEN q_6h >= s1 THEN 'siaga1' WHEN q_6h >= s2 THEN 'siaga2' WHEN q_6h >= s3 THEN 'siaga3' ELSE 'none' END AS siaga FROM recession) WHERE siaga <> 'none'""")
def x01(v):
    c = F.col
    r = recession(v).withColumn("siaga", flood.siaga(c("q_6h"), c("s3"), c("s2"), c("s1"))).filter("siaga <> 'none'")
    return r.select("flow_id",
                    F.concat_ws("-", F.lit("flood"), "river_id", F.date_format("day", "yyyyMMdd"), "siaga").alias("alert_id"),
                    F.upper(F.format_string("%s: river %d", c("siaga"), c("river_id"))).alias("title"),
                    F.format_string("Streamflow forecast: %dm3/s at 6h, %dm3/s at 12h", F.round("q_6h").cast("long"),
                                    F.round("q_12h").cast("long")).alias("description"))


@query("y01_horizon_arrays", "SELECT river_id, count(*) AS leads, sum(lead_hr)::BIGINT AS lead_sum, round(max(forecast_cms), 2) AS peak, round(sum(forecast_cms), 2) AS total FROM forecast GROUP BY 1")
def y01(v):
    """Forecasts per lead as an array of structs, read back with array functions."""
    a = forecast(v).groupBy("river_id").agg(F.array_sort(F.collect_list(F.struct("lead_hr", "forecast_cms"))).alias("h"))
    return a.select("river_id", F.size("h").cast("long").alias("leads"),
                    F.aggregate("h", F.lit(0), lambda s, x: s + x.lead_hr).cast("long").alias("lead_sum"),
                    F.round(F.array_max(F.transform("h", lambda x: x.forecast_cms)), 2).alias("peak"),
                    F.round(F.aggregate("h", F.lit(0.0), lambda s, x: s + x.forecast_cms), 2).alias("total"))


@query("y04_exceedance_map", """SELECT flow_id, lvl AS level, h >= lim AS exceeded FROM (SELECT flow_id, 12.4 * pow(greatest(discharge_cms, 0.01), 0.68) / 100 AS h,
    unnest(['WATCH','WARNING','EMERGENCY']) AS lvl, unnest([1.5, 2.5, 4.0]) AS lim FROM flow)""")
def y04(v):
    limits = F.map_from_arrays(F.array(*map(F.lit, ["WATCH", "WARNING", "EMERGENCY"])), F.array(*map(F.lit, [1.5, 2.5, 4.0])))
    h = flood.rating_stage(F.col("discharge_cms"), F.lit(12.4), F.lit(0.68)) / 100
    m = F.transform_values(limits, lambda k, x: F.col("h") >= x)
    return v.flow.select("flow_id", h.alias("h")).select("flow_id", F.explode(m).alias("level", "exceeded"))


@query("m40_predicted_flood_risk", """SELECT river_id, round(avg(CASE WHEN discharge_cms > 300 THEN 1.0 ELSE 0.0 END), 6) AS exceed_share, max(discharge_cms) AS max_cms,
    CASE WHEN max(discharge_cms) > 300 THEN 'RED' WHEN max(discharge_cms) > 225 THEN 'ORANGE' ELSE 'GREEN' END AS level FROM flow GROUP BY 1""")
def m40(v):
    q = F.col("discharge_cms")
    top = F.max(q)
    return v.flow.groupBy("river_id").agg(
        F.round(F.avg((q > 300).cast("double")), 6).alias("exceed_share"), top.alias("max_cms"),
        F.when(top > 300, "RED").when(top > 225, "ORANGE").otherwise("GREEN").alias("level"))

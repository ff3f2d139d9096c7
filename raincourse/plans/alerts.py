"""Reads over alerts, points, scenes and stations, with quality checks and service measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raincourse.functions import flood
from raincourse.operators import quality as Q
from raincourse.operators.rollup import latest_per_key, rank_of
from raincourse.operators.spatial import boxes_at_points, nearest_index
from raincourse.plans.climate import forecast_rows
from raincourse.plans.water import quality, reflect
from raincourse.registry import query
from raincourse.session import new_path
from raincourse.views import SQL_VIEWS, Views

c = F.col
SEVERITY = ["low", "medium", "high", "critical"]
SQL_RANK = "list_position(['low','medium','high','critical'], severity)"


def iso(name: str) -> F.Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


SQL_VIEWS["point"] = "SELECT o.*, -11 + ((station_id * 37) % 1700) / 100.0 AS lat, 95 + ((station_id * 61) % 4600) / 100.0 AS lon, CAST(station_id % 25 AS INTEGER) AS province_id FROM obs o"


def point(v: Views) -> DataFrame:
    s = c("station_id")
    return v.obs.withColumns({"lat": -11 + ((s * 37) % 1700) / 100.0, "lon": 95 + ((s * 61) % 4600) / 100.0, "province_id": (s % 25).cast("int")})


@query("f01_active_alerts", f"SELECT alert_id, severity, strftime(issued_at, '%Y-%m-%d %H:%M:%S') AS issued_at FROM alert WHERE is_active AND alert_type = 'click' AND {SQL_RANK} >= 2 AND province_id IN (3, 4)")
def f01(v, limit: int | None = None):
    """Active alerts of a type, least severity and provinces; with ``limit`` the newest of them."""
    a = v.alert.filter(c("is_active") & (c("alert_type") == "click") & (rank_of(c("severity"), SEVERITY) >= 1) & c("province_id").isin(3, 4))
    a = a if limit is None else a.orderBy(c("issued_at").desc(), "alert_id").limit(limit)
    return a.select("alert_id", "severity", iso("issued_at"))


@query("f02_alert_history", "SELECT alert_id, severity FROM alert WHERE alert_type = 'view' AND issued_at >= (SELECT max(issued_at) FROM alert) - INTERVAL 10 DAY")
def f02(v):
    """History of the last days, counted from the newest alert; the type reaches the Parquet scan."""
    a = v.alert
    newest = a.agg(F.max("issued_at")).scalar()
    return a.filter((c("alert_type") == "view") & (c("issued_at") >= newest - F.expr("interval 10 days"))).select("alert_id", "severity")


@query("f03_box_and_dates", "SELECT event_id, lat, lon, value FROM point WHERE lat BETWEEN -8 AND -2 AND lon BETWEEN 100 AND 120 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def f03(v):
    """Date bounds are put on the stored column before any cast, so they reach the scan."""
    early = v.table("events").filter((c("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")) & (c("ts") < F.lit("2024-01-12").cast("timestamp_ntz")))
    s = c("user_id")
    p = early.select("event_id", (-11 + ((s * 37) % 1700) / 100.0).alias("lat"), (95 + ((s * 61) % 4600) / 100.0).alias("lon"), "value")
    return p.filter(c("lat").between(-8, -2) & c("lon").between(100, 120))


@query("f04_rainfall_resolution", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(sum(precip_mm), 6) AS precip_mm, count(*) AS n FROM point WHERE lat BETWEEN -8 AND 2 AND lon BETWEEN 96 AND 130 GROUP BY 1")
def f04(v):
    return (point(v).filter(c("lat").between(-8, 2) & c("lon").between(96, 130)).groupBy(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day"))
            .agg(F.round(F.sum("precip_mm"), 6).alias("precip_mm"), F.count("*").alias("n")))


@query("f05_air_quality_rows", "SELECT event_id, province_id, value FROM point WHERE province_id = 6")
def f05(v, limit: int | None = None):
    """Air quality rows of a province; with ``limit`` the highest of them."""
    rows = point(v).filter("province_id = 6")
    rows = rows if limit is None else rows.orderBy(c("value").desc(), "event_id").limit(limit)
    return rows.select("event_id", "province_id", "value")


@query("f06_deforestation_events", """SELECT o_orderkey AS event_id, round(o_totalprice / 5000, 6) AS area_ha FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND -11 + ((o_orderkey * 37) % 1700) / 100.0 BETWEEN -9 AND 4 AND 95 + ((o_orderkey * 61) % 4600) / 100.0 BETWEEN 98 AND 139
    AND o_totalprice / 5000 >= 20 AND (o_orderkey % 100) / 100.0 >= 0.7""")
def f06(v):
    k = c("o_orderkey")
    return (v.table("orders").filter((c("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (c("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")))
            .filter((-11 + ((k * 37) % 1700) / 100.0).between(-9, 4) & (95 + ((k * 61) % 4600) / 100.0).between(98, 139)
                    & (c("o_totalprice") / 5000 >= 20) & ((k % 100) / 100.0 >= 0.7))
            .select(k.alias("event_id"), F.round(c("o_totalprice") / 5000, 6).alias("area_ha")))


@query("f07_flood_alert_counts", f"SELECT province_id, count(*) AS total, count(*) FILTER (WHERE is_active) AS active FROM alert WHERE alert_type = 'error' AND {SQL_RANK} >= 3 GROUP BY 1")
def f07(v):
    a = v.alert.filter((c("alert_type") == "error") & (rank_of(c("severity"), SEVERITY) >= 2))
    return a.groupBy("province_id").agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"))


SQL_VIEWS["subscriber"] = """SELECT s_suppkey AS subscriber_id, [CASE WHEN s_suppkey % 2 = 0 THEN 'click' ELSE 'view' END, 'error'] AS types, [s_nationkey, (s_nationkey + 1) % 25] AS provinces, CAST(s_suppkey % 3 + 1 AS INTEGER) AS min_rank FROM supplier"""


def subscriber(v: Views) -> DataFrame:
    k = c("s_suppkey")
    return v.table("supplier").select(
        k.alias("subscriber_id"), F.array(F.when(k % 2 == 0, "click").otherwise("view"), F.lit("error")).alias("types"),
        F.array("s_nationkey", (c("s_nationkey") + 1) % 25).alias("provinces"), (k % 3 + 1).cast("int").alias("min_rank"))


@query("f09_alert_subscriptions", f"""SELECT subscriber_id, severity, count(*) AS due FROM alert JOIN subscriber ON list_contains(types, alert_type) AND list_contains(provinces, province_id) AND {SQL_RANK} >= min_rank GROUP BY 1, 2""")
def f09(v):
    """Alerts due per subscriber. Alerts are counted by (type, province, severity) first,
    so the join fans out over counts and not over alerts."""
    counts = v.alert.groupBy("alert_type", "province_id", "severity").agg(F.count("*").alias("n"))
    subs = (subscriber(v).select("subscriber_id", "min_rank", F.explode(F.array_distinct("types")).alias("alert_type"), "provinces")
            .select("subscriber_id", "min_rank", "alert_type", F.explode(F.array_distinct("provinces")).alias("province_id")))
    return (counts.join(subs, ["alert_type", "province_id"]).filter(rank_of(c("severity"), SEVERITY) + 1 >= c("min_rank"))
            .groupBy("subscriber_id", "severity").agg(F.sum("n").alias("due")))


@query("f10_ingest_and_resolve", """SELECT alert_type, count(*) AS alerts, count(*) FILTER (WHERE active) AS active FROM (SELECT DISTINCT alert_id, alert_type, alert_id % 7 <> 0 AS active FROM (SELECT * FROM alert UNION ALL SELECT * FROM alert WHERE alert_id % 3 = 0)) GROUP BY 1""")
def f10(v):
    """Repeated deliveries count once by alert id; resolutions switch an alert off."""
    a = v.alert
    once = Q.ingest_once(a.unionByName(a.filter("alert_id % 3 = 0")), "alert_id")
    state = Q.resolve(once.withColumn("is_active", F.lit(True)), a.filter("alert_id % 7 = 0").select("alert_id"), "alert_id")
    return state.groupBy("alert_type").agg(F.count("*").alias("alerts"), F.count_if("is_active").alias("active"))


@query("f11_row_constraints", """SELECT event_id, array_to_string(list_filter([CASE WHEN aux > 90 THEN 'humidity_pct' END, CASE WHEN value / 100 - 1 > 1 THEN 'ndvi' END, CASE WHEN lat > 5 THEN 'latitude' END, CASE WHEN value - 1 < 0 THEN 'discharge' END], lambda x: x IS NOT NULL), ',') AS violations
    FROM point WHERE aux > 90 OR value / 100 - 1 > 1 OR lat > 5 OR value - 1 < 0""")
def f11(v):
    rules = {"humidity_pct": c("aux").between(0, 90), "ndvi": (c("value") / 100 - 1).between(-1, 1), "latitude": c("lat").between(-90, 5), "discharge": c("value") - 1 >= 0}
    _, reject = Q.split_valid(point(v), rules)
    return reject.select("event_id", F.array_join("violations", ",").alias("violations"))


@query("f12_pagination", "SELECT station_id, (SELECT count(*) FROM station) AS total, 3 * 20 < (SELECT count(*) FROM station) AS has_next FROM station ORDER BY station_id LIMIT 20 OFFSET 40")
def f12(v):
    """The third page of twenty, from an index written for paging."""
    index = Q.page_index(v.station.select("station_id"), ["station_id"], new_path(v.spark, "pages"))
    return Q.page(index, ["station_id"], 3, 20)


@query("f13_active_cells", "SELECT cell_id FROM (SELECT cell_id, CASE WHEN p_size % 5 = 0 THEN false WHEN p_size % 5 = 1 THEN NULL ELSE true END AS active FROM cell) WHERE coalesce(active, true)")
def f13(v):
    flag = F.when(c("p_size") % 5 == 0, False).when(c("p_size") % 5 == 1, F.lit(None).cast("boolean")).otherwise(True)
    return v.cell.filter(F.coalesce(flag, F.lit(True))).select("cell_id")


@query("f15_freshness_gate", """SELECT entity, fresh FROM (SELECT station_id AS entity, max(ts) >= (SELECT max(ts) FROM obs) - INTERVAL 75 MINUTE AS fresh FROM obs GROUP BY 1)""")
def f15(v):
    """Entities whose newest input is within the limit of the newest input of all."""
    o = v.obs
    now = o.agg(F.max("ts")).scalar()
    return o.groupBy(c("station_id").alias("entity")).agg(F.max("ts").alias("m")).select("entity", (c("m") >= now - F.expr("interval 75 minutes")).alias("fresh"))


@query("f16_grid_validation", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 97 = 0 THEN 'no_file' WHEN ts < TIMESTAMP '2024-01-03' THEN 'file_too_old' WHEN event_id % 89 = 0 THEN 'parse_error' WHEN value < 1 THEN 'null_precip' WHEN aux < 80 THEN 'insufficient_coverage' ELSE 'ok' END AS reason FROM obs) GROUP BY 1""")
def f16(v):
    k = c("event_id")
    reason = Q.first_failure([("no_file", k % 97 == 0), ("file_too_old", c("ts") < F.lit("2024-01-03").cast("timestamp")), ("parse_error", k % 89 == 0),
                              ("null_precip", c("value") < 1), ("insufficient_coverage", c("aux") < 80)])
    return v.obs.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("f17_drift_columns", "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(precip_mm, 6) AS precip_mm, round(temp_c, 6) AS temp_c FROM hourly")
def f17(v):
    """Identifier and date columns are dropped by name pattern (a name containing 'id' is dropped too)."""
    kept = Q.without_patterns(v.hourly, ("id", "timestamp", "entity_id", "valid_time", "ds", "date"))
    return kept.select(iso("ts"), F.round("precip_mm", 6).alias("precip_mm"), F.round("temp_c", 6).alias("temp_c"))


@query("f18_sparse_columns", "SELECT event_id, CASE WHEN value >= 5 THEN value END AS mostly FROM obs")
def f18(v):
    o = v.obs.select("event_id", F.when(c("value") >= 5, c("value")).alias("mostly"), F.when(c("value") >= 150, c("value")).alias("rarely"))
    return Q.dense_columns(o, 0.7)


@query("f19_current_conditions", """SELECT n_nationkey AS district_id, round(m.temp, 6) AS temp_c, round(q.wqi, 6) AS river_cms, r.value AS storm FROM nation LEFT JOIN (SELECT station_id % 25 AS d, arg_max(value, (ts, event_id)) AS temp FROM obs GROUP BY 1) m ON m.d = n_nationkey
    LEFT JOIN (SELECT river_id AS d, arg_max(discharge_cms, (day, flow_id)) AS wqi FROM flow GROUP BY 1) q ON q.d = n_nationkey LEFT JOIN (SELECT province_id AS d, arg_max(value, (issued_at, alert_id)) AS value FROM alert WHERE severity = 'critical' GROUP BY 1) r ON r.d = n_nationkey""")
def f19(v):
    """Newest value of each source per district, by map-side combined max_by."""
    def newest(df, key, value, order, out):
        return df.groupBy(key.cast("int").alias("district_id")).agg(F.max_by(value, F.struct(*order)).alias(out))
    base = v.table("nation").select(c("n_nationkey").alias("district_id"))
    out = base.join(newest(v.obs, c("station_id") % 25, c("value"), ["ts", "event_id"], "t"), "district_id", "left")
    out = out.join(newest(v.flow, c("river_id"), c("discharge_cms"), ["day", "flow_id"], "q"), "district_id", "left")
    out = out.join(newest(v.alert.filter("severity = 'critical'"), c("province_id"), c("value"), ["issued_at", "alert_id"], "storm"), "district_id", "left")
    return out.select("district_id", F.round("t", 6).alias("temp_c"), F.round("q", 6).alias("river_cms"), "storm")


@query("f20_forecast_near_point", """SELECT CAST(round((lat + 11) / 2) AS INTEGER) AS lat_idx, CAST(round((lon - 95) / 2) AS INTEGER) AS lon_idx, count(*) AS n, round(sum(precip_mm), 6) AS rain FROM hourly JOIN station USING (station_id) WHERE ts < TIMESTAMP '2024-01-04' GROUP BY 1, 2 HAVING lat_idx = 3 AND lon_idx BETWEEN 0 AND 12""")
def f20(v):
    """Rows up to a lead time in the grid cells near a coordinate, as totals per cell."""
    s = v.station.withColumns({"lat_idx": nearest_index(c("lat"), -11.0, 2.0, 100), "lon_idx": nearest_index(c("lon"), 95.0, 2.0, 100)})
    near = s.filter("lat_idx = 3 and lon_idx between 0 and 12").select("station_id", "lat_idx", "lon_idx")
    return forecast_rows(v.hourly.filter(c("ts") < F.lit("2024-01-04").cast("timestamp")).join(near, "station_id"), ["lat_idx", "lon_idx"])


@query("f21_station_view", """SELECT station_id, strftime(ts, '%Y-%m-%d %H:%M') AS at, round(q, 6) AS latest_cms, history, round(peak, 6) AS peak_24h_cms, round(first_q, 6) AS first_cms, round(f6, 6) AS forecast_6h_cms, threshold AS threshold_cms, q > threshold OR f6 > threshold AS alert FROM (
    SELECT *, q * 0.92 + rain6 * (1.0 + greatest((soil_moisture - 0.25) / 0.15, 0.0)) * threshold / 180.0 AS f6 FROM (
      SELECT h.station_id, max(h.ts) AS ts, arg_max(5 + h.precip_mm, h.ts) AS q, count(*) AS history, max(5 + h.precip_mm) AS peak, arg_min(5 + h.precip_mm, h.ts) AS first_q, sum(h.precip_mm) FILTER (WHERE h.ts > m.last - INTERVAL 6 HOUR) AS rain6, any_value(s.soil_moisture) AS soil_moisture, any_value(s.area_km2)::DOUBLE AS threshold
      FROM hourly h JOIN (SELECT station_id, max(ts) AS last FROM hourly GROUP BY 1) m ON h.station_id = m.station_id AND h.ts > m.last - INTERVAL 24 HOUR JOIN station s ON s.station_id = h.station_id GROUP BY 1))""")
def f21(v):
    """Latest flow, the 24 hours up to it, a forecast for 6 hours ahead, the threshold, and whether flow or forecast exceed it.

    Flow is made from hourly rain, 5 m3/s with every millimetre on top; the threshold is also the bankfull flow of the recession forecast.
    """
    h = v.hourly.select("station_id", "ts", "precip_mm", (5 + c("precip_mm")).alias("q"))
    last = h.groupBy("station_id").agg(F.max("ts").alias("last"))
    day = h.join(last, "station_id").where(c("ts") > c("last") - F.expr("INTERVAL 24 HOURS")).groupBy("station_id").agg(
        F.max("ts").alias("ts"), F.array_sort(F.collect_list(F.struct("ts", "q"))).alias("h"), F.sum(F.when(c("ts") > c("last") - F.expr("INTERVAL 6 HOURS"), c("precip_mm"))).alias("rain"))
    x = day.join(v.station.select("station_id", "soil_moisture", c("area_km2").cast("double").alias("threshold_cms")), "station_id")
    x = x.withColumn("latest", F.element_at("h", -1)["q"])
    x = x.withColumn("f6", flood.recession_forecast(c("latest"), c("rain"), c("soil_moisture"), c("threshold_cms"))["q_6h"])
    return x.select("station_id", F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), F.round("latest", 6).alias("latest_cms"), F.size("h").cast("long").alias("history"),
                    F.round(F.array_max(F.transform("h", lambda e: e.q)), 6).alias("peak_24h_cms"), F.round(c("h")[0]["q"], 6).alias("first_cms"), F.round("f6", 6).alias("forecast_6h_cms"),
                    "threshold_cms", ((c("latest") > c("threshold_cms")) | (c("f6") > c("threshold_cms"))).alias("alert"))


SCENE_DAYS, SCENE_CLOUD, SCENES = 1500, 60, 2
SCENE_POINT = (-8.0, 106.0)
MISSIONS = ("landsat", "modis")


@query("f22_newest_scenes", f"""SELECT source AS mission, obs_id, strftime(day, '%Y-%m-%d') AS day, CAST(cloud_pct AS BIGINT) AS cloud_pct, round(turb, 6) AS turbidity, round(chl, 6) AS chlorophyll, round(wqi, 6) AS quality, category FROM (
    SELECT *, -11 + ((body_id * 37) % 1700) / 100.0 AS lat0, 95 + ((body_id * 61) % 4600) / 100.0 AS lon0, 0.5 + (obs_id % 64) * 0.25 AS half FROM quality)
    WHERE source IN ('landsat', 'modis') AND cloud_pct < {SCENE_CLOUD} AND day >= (SELECT max(day) FROM reflect) - {SCENE_DAYS} AND {SCENE_POINT[0]} BETWEEN lat0 - half AND lat0 + half AND {SCENE_POINT[1]} BETWEEN lon0 - half AND lon0 + half
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY day DESC, obs_id) <= {SCENES}""")
def f22(v):
    """Newest scenes over a point, by mission, below a cloud limit and within some days, with their derived products."""
    return newest_scenes(v, *SCENE_POINT, MISSIONS, SCENE_CLOUD, SCENE_DAYS, SCENES)


def newest_scenes(v: Views, lat: float, lon: float, missions: tuple[str, ...], cloud: float, days: int, most: int) -> DataFrame:
    """Of each mission the ``most`` newest scenes whose footprint holds the point; products as a map in the operator, as columns here."""
    q, b, k = quality(v), c("body_id"), c("obs_id")
    half = 0.5 + (k % 64) * 0.25
    lat0, lon0 = -11 + (b * 37 % 1700) / 100.0, 95 + (b * 61 % 4600) / 100.0
    newest = reflect(v).agg(F.max("day")).scalar()
    scenes = q.where(c("source").isin(*missions) & (c("cloud_pct") < cloud) & (c("day") >= F.date_sub(newest, days))).select(
        "source", "obs_id", "day", "cloud_pct", "category", (lon0 - half).alias("west"), (lat0 - half).alias("south"), (lon0 + half).alias("east"), (lat0 + half).alias("north"),
        F.create_map(F.lit("turbidity"), c("turb"), F.lit("chlorophyll"), c("chl"), F.lit("quality"), c("wqi")).alias("products"))
    point = v.spark.range(1).select(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    w = Window.partitionBy("source").orderBy(c("day").desc(), "obs_id")
    found = boxes_at_points(scenes, point).withColumn("rn", F.row_number().over(w)).where(c("rn") <= most)
    return found.select(c("source").alias("mission"), "obs_id", F.date_format("day", "yyyy-MM-dd").alias("day"), c("cloud_pct").cast("long").alias("cloud_pct"),
                        *[F.round(c("products")[p], 6).alias(p) for p in ("turbidity", "chlorophyll", "quality")], "category")


# --- quality ---------------------------------------------------------------
SQL_VIEWS["gappy"] = "SELECT event_id, station_id, ts, CASE WHEN value >= 5 THEN value END AS precip_rate, CASE WHEN value < 300 THEN value - 2 END AS streamflow_cms, CASE WHEN aux > 3 THEN aux END AS rh FROM obs"


def gappy(v: Views) -> DataFrame:
    x = c("value")
    return v.obs.select("event_id", "station_id", "ts", F.when(x >= 5, x).alias("precip_rate"), F.when(x < 300, x - 2).alias("streamflow_cms"), F.when(c("aux") > 3, c("aux")).alias("rh"))


COLS = ["precip_rate", "streamflow_cms", "rh"]


@query("a53_null_rate", """SELECT unnest(['precip_rate','streamflow_cms','rh']) AS column_name, unnest([round(avg((precip_rate IS NULL)::INT), 6), round(avg((streamflow_cms IS NULL)::INT), 6), round(avg((rh IS NULL)::INT), 6)]) AS null_rate FROM gappy""")
def a53(v):
    return Q.null_rates(gappy(v), COLS).select("column_name", F.round("null_rate", 6).alias("null_rate"))


@query("a54_range_violations", """SELECT unnest(['precip_rate','streamflow_cms','rh']) AS column_name, unnest([round(count(*) FILTER (WHERE precip_rate > 250) / count(precip_rate), 6), round(count(*) FILTER (WHERE streamflow_cms < 0) / count(streamflow_cms), 6), round(count(*) FILTER (WHERE rh NOT BETWEEN 0 AND 95) / count(rh), 6)]) AS violation_rate FROM gappy""")
def a54(v):
    bad = {"precip_rate": c("precip_rate") > 250, "streamflow_cms": c("streamflow_cms") < 0, "rh": ~c("rh").between(0, 95)}
    return Q.violation_rates(gappy(v), bad).select("column_name", F.round("violation_rate", 6).alias("violation_rate"))


@query("a55_quality_suite", """SELECT column_name, expectation, severity, round(rate, 6) AS rate FROM (SELECT unnest(['precip_rate','rh','precip_rate','rh','streamflow_cms','streamflow_cms','ts']) AS column_name, unnest(['range_check','range_check','null_rate','null_rate','non_negative','null_rate','monotone_timestamp']) AS expectation,
    unnest(['critical','critical','critical','critical','critical','critical','critical']) AS severity, unnest([count(*) FILTER (WHERE precip_rate NOT BETWEEN 0 AND 500) / count(precip_rate), count(*) FILTER (WHERE rh NOT BETWEEN 0 AND 100) / count(rh), CASE WHEN avg((precip_rate IS NULL)::INT) > 0.05 THEN avg((precip_rate IS NULL)::INT) ELSE 0 END, CASE WHEN avg((rh IS NULL)::INT) > 0.05 THEN avg((rh IS NULL)::INT) ELSE 0 END,
      count(*) FILTER (WHERE streamflow_cms < 0) / count(streamflow_cms), CASE WHEN avg((streamflow_cms IS NULL)::INT) > 0.05 THEN avg((streamflow_cms IS NULL)::INT) ELSE 0 END, 0.0]) AS rate FROM gappy) WHERE rate > 0""")
def a55(v):
    """Long table of failed expectations; columns are found by name, as the suites do."""
    return Q.run_suite(gappy(v), order=["event_id"], ts="ts", skip=("event_id", "station_id"), width=1_000_000).select(
        "column_name", "expectation", "severity", F.round("rate", 6).alias("rate"))


@query("w11_monotone_time", "SELECT count(*) FILTER (WHERE g < INTERVAL 0 SECOND) AS negative_gaps, count(*) FILTER (WHERE ts IS NULL) AS missing_times, count(*) AS n FROM (SELECT ts, ts - lag(ts) OVER (ORDER BY event_id * 7919 % 1000003 + event_id // 1000003 * 1000003) AS g FROM obs)")
def w11(v):
    """Rows in ingest order (here ids shuffled within each 1,000,003, a prime): time must not step back."""
    o = v.obs.select((c("event_id") * 7919 % 1000003 + F.expr("event_id div 1000003") * 1000003).alias("pos"), "ts")
    return Q.negative_gaps(o, ["pos"], "ts", 100_000)


@query("a56_land_cover", """SELECT p_brand AS region, p_size % 10 + 2015 AS year, p_type AS land_class, round(sum(p_retailprice), 4) AS area_ha, round(sum(p_retailprice) / sum(sum(p_retailprice)) OVER (PARTITION BY p_brand, p_size % 10 + 2015) * 100, 6) AS share_pct FROM part GROUP BY 1, 2, 3""")
def a56(v):
    """Area and share of every class per region and year; the window holds one row per class."""
    area = v.table("part").groupBy(c("p_brand").alias("region"), (c("p_size") % 10 + 2015).alias("year"), c("p_type").alias("land_class")).agg(F.sum("p_retailprice").alias("ha"))
    share = c("ha") / F.sum("ha").over(Window.partitionBy("region", "year")) * 100
    return area.select("region", "year", "land_class", F.round("ha", 4).alias("area_ha"), F.round(share, 6).alias("share_pct"))


@query("a57_provinces", "SELECT DISTINCT province_id FROM point")
def a57(v):
    return point(v).select("province_id").distinct()


@query("a58_batch_manifest", "SELECT variable AS model_id, count(*) AS n_rows, count(*) FILTER (WHERE value < 3) AS n_errors FROM obs GROUP BY 1")
def a58(v):
    return v.obs.groupBy(c("variable").alias("model_id")).agg(F.count("*").alias("n_rows"), F.count_if(c("value") < 3).alias("n_errors"))


# --- service measures ------------------------------------------------------
@query("a65_service_measures", """WITH o AS (SELECT date_trunc('hour', ts) AS hour, ts, value, variable FROM obs),
    b AS (SELECT hour, le, lag(le, 1, 0.0) OVER w AS lo, n, lag(n, 1, 0) OVER w AS n0, max(n) OVER (PARTITION BY hour) AS total FROM (SELECT hour, le, count(*) FILTER (WHERE value <= le) AS n FROM o CROSS JOIN (SELECT unnest([10.0, 25.0, 50.0, 100.0, 250.0, 1000.0]) AS le) GROUP BY 1, 2) WINDOW w AS (PARTITION BY hour ORDER BY le))
    SELECT strftime(hour, '%Y-%m-%d %H:%M') AS hour, round(p99, 6) AS p99, round(err, 6) AS error_rate, err > 14 * (1 - 0.995) AS burning, stale_s FROM (SELECT hour, arg_min(lo + (le - lo) * (0.99 * total - n0) / (n - n0), le) FILTER (WHERE n >= 0.99 * total AND n > n0) AS p99 FROM b GROUP BY 1)
    JOIN (SELECT hour, avg(CASE WHEN variable = 'error' THEN 1.0 ELSE 0 END) AS err, CAST(floor(epoch(hour + INTERVAL 1 HOUR) - max(epoch(ts))) AS BIGINT) AS stale_s FROM o GROUP BY 1) USING (hour)""")
def a65(v):
    """Quantile from cumulative latency buckets, error burn rate and staleness per hour."""
    hour = F.date_trunc("hour", "ts").alias("hour")
    q = Q.bucket_quantile(v.obs, [hour], c("value"), [10.0, 25.0, 50.0, 100.0, 250.0, 1000.0], 0.99)
    err = F.avg((c("variable") == "error").cast("double"))
    end = F.unix_seconds("hour") + 3600
    s = v.obs.groupBy(hour).agg(err.alias("err"), F.max(c("ts").cast("double")).alias("m"))
    return q.join(s, "hour").select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), F.round("q", 6).alias("p99"), F.round("err", 6).alias("error_rate"),
                                    (c("err") > 14 * (1 - 0.995)).alias("burning"), F.floor(end - c("m")).cast("long").alias("stale_s"))


@query("t11_delivery_latency", """SELECT alert_type, count(*) AS n, count(*) FILTER (WHERE d <= 60) AS within_60s, count(*) FILTER (WHERE d <= 120) AS within_120s, round(max(d), 3) AS max_s FROM (
    SELECT b.alert_type, epoch(k.issued_at) - epoch(b.issued_at) AS d FROM alert b JOIN (SELECT alert_id - 1 AS alert_id, issued_at FROM alert WHERE alert_id % 2 = 1) k USING (alert_id)) GROUP BY 1""")
def t11(v):
    """Seconds from breach to confirmation, matched by alert id, with bucket counts."""
    a = v.alert
    confirm = a.filter("alert_id % 2 = 1").select((c("alert_id") - 1).alias("alert_id"), c("issued_at").alias("confirmed_at"))
    d = a.join(confirm, "alert_id").withColumn("d", c("confirmed_at").cast("double") - c("issued_at").cast("double"))
    return d.groupBy("alert_type").agg(F.count("*").alias("n"), F.count_if(c("d") <= 60).alias("within_60s"), F.count_if(c("d") <= 120).alias("within_120s"), F.round(F.max("d"), 3).alias("max_s"))


@query("t12_ingestion_lag", "SELECT station_id, CAST(floor(lag_s) AS BIGINT) AS lag_s, CASE WHEN lag_s > 3600 THEN 'critical' WHEN lag_s > 1800 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT station_id, (SELECT max(epoch(ts)) FROM obs) - max(epoch(ts)) AS lag_s FROM obs GROUP BY 1)")
def t12(v):
    o = v.obs.select("station_id", c("ts").cast("double").alias("t"))
    now = o.agg(F.max("t")).scalar()
    s = o.groupBy("station_id").agg(F.max("t").alias("m")).select("station_id", (now - c("m")).alias("lag"))
    return s.select("station_id", F.floor("lag").cast("long").alias("lag_s"), F.when(c("lag") > 3600, "critical").when(c("lag") > 1800, "warning").otherwise("ok").alias("status"))

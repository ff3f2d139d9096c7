"""Joins in space and time, and rain fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raincourse.operators import fusion
from raincourse.operators import joins as J
from raincourse.operators.learning import stable_bucket
from raincourse.operators.ranking import quantiles
from raincourse.operators.rollup import clip, latest_per_key
from raincourse.operators.spatial import ceiling_index, haversine_km, nearest_index, radius_join
from raincourse.registry import query
from raincourse.session import sized
from raincourse.views import SQL_VIEWS, Views

c = F.col
DAY = 86400.0

SQL_HAV = "2 * 6371.0 * atan2(sqrt({h}), sqrt(1 - {h}))"


def sql_distance(a: str, b: str) -> str:
    h = (f"(pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2))")
    return SQL_HAV.format(h=h)


SQL_VIEWS["grid"] = "SELECT CAST(round(lat + 11) AS INTEGER) AS lat_idx, CAST(round(lon - 95) AS INTEGER) AS lon_idx, avg(value) / 10 AS value FROM cell GROUP BY 1, 2"


def grid(v: Views) -> DataFrame:
    """Cells averaged on a regular one-degree grid."""
    return v.cell.groupBy(F.round(c("lat") + 11).cast("int").alias("lat_idx"), F.round(c("lon") - 95).cast("int").alias("lon_idx")).agg((F.avg("value") / 10).alias("value"))


@query("j01_dimension_lookup", "SELECT station_id, coalesce(n.n_name, 'unmapped') AS watershed, coalesce(r.r_name, 'unmapped') AS region FROM station LEFT JOIN nation n ON nation_id = n_nationkey LEFT JOIN region r ON n_regionkey = r_regionkey")
def j01(v):
    dim = v.watershed.join(v.region, "region_id").select(c("watershed_id").alias("nation_id"), c("name").alias("watershed"), "region")
    return J.lookup(v.station, dim, "nation_id", {"watershed": "unmapped", "region": "unmapped"}).select("station_id", "watershed", "region")


@query("j02_nearest_cell", "SELECT station_id, least(greatest(CAST(round(lat + 11) AS INTEGER), 0), 17) AS lat_idx, least(greatest(CAST(round(lon - 95) AS INTEGER), 0), 46) AS lon_idx, round(g.value, 8) AS value FROM station JOIN grid g ON g.lat_idx = least(greatest(CAST(round(lat + 11) AS INTEGER), 0), 17) AND g.lon_idx = least(greatest(CAST(round(lon - 95) AS INTEGER), 0), 46)")
def j02(v):
    s = v.station.withColumns({"lat_idx": nearest_index(c("lat"), -11.0, 1.0, 18), "lon_idx": nearest_index(c("lon"), 95.0, 1.0, 47)})
    return s.join(grid(v), ["lat_idx", "lon_idx"]).select("station_id", "lat_idx", "lon_idx", F.round("value", 8).alias("value"))


@query("j03_snapped_cell", "SELECT station_id, round(coalesce(k.v, 0.0), 8) AS background FROM station LEFT JOIN (SELECT CAST(round(lat / 0.04) AS INTEGER) AS a, CAST(round(lon / 0.04) AS INTEGER) AS b, avg(value) AS v FROM cell GROUP BY 1, 2) k ON k.a = CAST(round(lat / 0.04) AS INTEGER) AND k.b = CAST(round(lon / 0.04) AS INTEGER)")
def j03(v):
    """Both sides snap to the same 0.04 degree key; no cell counts as zero."""
    keys = {"a": F.round(c("lat") / 0.04).cast("int"), "b": F.round(c("lon") / 0.04).cast("int")}
    k = v.cell.withColumns(keys).groupBy("a", "b").agg(F.avg("value").alias("v"))
    return v.station.withColumns(keys).join(k, ["a", "b"], "left").select("station_id", F.round(F.coalesce("v", F.lit(0.0)), 8).alias("background"))


@query("j04_ceiling_cell", "SELECT station_id, i AS lat_idx, k AS lon_idx, round(value, 8) AS value FROM (SELECT station_id, CAST(least(greatest(ceil(round(lat + 11, 9)), 0), 17) AS INTEGER) AS i, CAST(least(greatest(ceil(round(lon - 95, 9)), 0), 46) AS INTEGER) AS k FROM station) JOIN grid ON lat_idx = i AND lon_idx = k")
def j04(v):
    s = v.station.withColumns({"lat_idx": ceiling_index(c("lat"), -11.0, 1.0, 18), "lon_idx": ceiling_index(c("lon"), 95.0, 1.0, 47)})
    return s.join(grid(v), ["lat_idx", "lon_idx"]).select("station_id", "lat_idx", "lon_idx", F.round("value", 8).alias("value"))


def gauges(v: Views) -> DataFrame:
    return v.station.select(c("station_id").alias("gauge_id"), c("lat").alias("g_lat"), c("lon").alias("g_lon"))


@query("j05_gauge_pairs", f"SELECT a.station_id, count(*) AS neighbours, round(sum(4.0 * exp(-0.5 * pow(({sql_distance('a.', 'b.')}) / 50.0, 2))), 6) AS covariance_sum FROM station a JOIN station b ON {sql_distance('a.', 'b.')} <= 300 GROUP BY 1")
def j05(v):
    """Distance and covariance of gauge pairs. Only pairs within 300 km are formed: no local
    correction uses a farther pair, and all pairs would grow with the square of the network."""
    p = radius_join(sized(v.station.select("station_id", "lat", "lon"), "stations"), sized(gauges(v), "gauges"), 300.0)
    cov = fusion.SIGMA_B ** 2 * fusion.gaussian_correlation(c("distance_km"))
    return p.groupBy("station_id").agg(F.count("*").alias("neighbours"), F.round(F.sum(cov), 6).alias("covariance_sum"))


SQL_VIEWS["near_pair"] = f"SELECT k.cell_id, k.value, s.station_id, {sql_distance('k.', 's.')} AS d, pow(pow(k.lat - s.lat, 2) + pow(k.lon - s.lon, 2) + 1e-12, -2) AS w FROM cell k JOIN station s ON abs(k.lat - s.lat) <= 1.4 AND {sql_distance('k.', 's.')} <= 150"


@query("j06_radius_join", "SELECT cell_id, station_id, round(d, 5) AS distance_km FROM near_pair")
def j06(v):
    return radius_join(v.cell.select("cell_id", "lat", "lon"), sized(gauges(v), "gauges"), 150.0).select("cell_id", c("gauge_id").alias("station_id"), F.round("distance_km", 5).alias("distance_km"))


@query("a20_inverse_distance_mean", "SELECT cell_id, count(*) AS n, round(sum(w * rain) / sum(w), 6) AS idw_mm FROM near_pair JOIN (SELECT station_id, sum(precip_mm) AS rain FROM obs GROUP BY 1) USING (station_id) GROUP BY 1")
def a20(v):
    """Weighted mean of gauge totals around each cell. Totals are joined to the gauges, which are few, not to the pairs."""
    total = v.obs.groupBy(c("station_id").alias("gauge_id")).agg(F.sum("precip_mm").alias("rain"))
    p = radius_join(v.cell.select("cell_id", "lat", "lon"), sized(gauges(v).join(total, "gauge_id"), "gauges"), 150.0)
    dy, dx = c("lat") - c("g_lat"), c("lon") - c("g_lon")
    square = dy * dy + dx * dx + 1e-12
    w = 1.0 / (square * square)
    return p.groupBy("cell_id").agg(F.count("*").alias("n"), F.round(F.sum(w * c("rain")) / F.sum(w), 6).alias("idw_mm"))


@query("m36_distance_and_correlation", "SELECT event_id, round(d, 6) AS distance_km, round(exp(-0.5 * pow(d / 50.0, 2)), 8) AS correlation, round(0.05 + 1.5 * (1 - exp(-d / 45.0)), 8) AS variogram FROM (SELECT event_id, " + sql_distance("p.", "o.") + " AS d FROM point p CROSS JOIN (SELECT -6.2 AS lat, 106.8 AS lon) o)")
def m36(v):
    s = c("station_id")
    d = haversine_km(-11 + ((s * 37) % 1700) / 100.0, 95 + ((s * 61) % 4600) / 100.0, F.lit(-6.2), F.lit(106.8))
    return v.obs.select("event_id", d.alias("d")).select("event_id", F.round("d", 6).alias("distance_km"), F.round(fusion.gaussian_correlation(c("d")), 8).alias("correlation"), F.round(fusion.variogram(c("d")), 8).alias("variogram"))


@query("j08_point_in_time_join", """SELECT s.event_id, round(f.precip_mm, 6) AS precip_mm, round(f.temp_c, 6) AS temp_c FROM obs s ASOF LEFT JOIN hourly f ON s.station_id = f.station_id AND s.ts >= f.ts""")
def j08(v):
    """Newest hourly features at or before each event."""
    spine = v.obs.select("event_id", "station_id", "ts")
    out = J.as_of(spine, v.hourly, ["station_id"], "ts", ["precip_mm", "temp_c"], 5 * DAY, "event_id")
    return out.select("event_id", F.round("precip_mm", 6).alias("precip_mm"), F.round("temp_c", 6).alias("temp_c"))


@query("j09_latest_features", "SELECT station_id, round(arg_max(precip_mm, ts), 6) AS precip_mm, arg_max(humidity, ts) AS humidity FROM hourly WHERE station_id IN (SELECT entity_id FROM alert WHERE severity = 'critical') GROUP BY 1")
def j09(v):
    """Newest features of the entities asked for (here those with a critical alert)."""
    keys = v.alert.filter("severity = 'critical'").select(c("entity_id").alias("station_id"))
    return latest_per_key(v.hourly, ["station_id"], ["ts"]).join(keys, "station_id", "left_semi").select("station_id", F.round("precip_mm", 6).alias("precip_mm"), "humidity")


@query("j11_prefix_match", """SELECT p_partkey, coalesce((SELECT arg_min(r, k) FROM (VALUES (1, 'Brand#1', 'java'), (2, 'Brand#2', 'sumatra'), (3, 'Brand#3', 'kalimantan')) t(k, p, r) WHERE starts_with(p_brand, p)), ['java','sumatra','kalimantan','sulawesi','maluku_papua'][CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 5 + 1]) AS region FROM part""")
def j11(v):
    """Region by the first matching name prefix, else by a stable hash bucket."""
    p = v.table("part").select("p_partkey", "p_brand")
    rank = F.when(c("prefix") == "Brand#1", 1).when(c("prefix") == "Brand#2", 2).when(c("prefix") == "Brand#3", 3)
    dim = (v.table("part").select(F.substring("p_brand", 1, 7).alias("prefix")).distinct().withColumn("k", rank).filter("k is not null")
           .withColumn("r", F.element_at(F.array(*map(F.lit, ["java", "sumatra", "kalimantan"])), c("k"))))
    hit = J.prefix_join(p, "p_brand", dim, "prefix").groupBy("p_partkey").agg(F.min_by("r", "k").alias("r"))
    fallback = F.element_at(F.array(*map(F.lit, ["java", "sumatra", "kalimantan", "sulawesi", "maluku_papua"])), (stable_bucket(c("p_partkey"), 5) + 1).cast("int"))
    return p.join(hit, "p_partkey", "left").select("p_partkey", F.coalesce("r", fallback).alias("region"))


@query("j12_substring_match", "SELECT c_custkey, min(code) AS code FROM customer JOIN (SELECT CAST(n_nationkey + 10 AS VARCHAR) AS code FROM nation) ON contains(c_name, code) GROUP BY 1")
def j12(v):
    """First registry code that occurs in a name."""
    dim = v.table("nation").select((c("n_nationkey") + 10).cast("string").alias("code"))
    hit = J.substring_join(v.table("customer").select("c_custkey", "c_name"), "c_name", dim, "code")
    return hit.groupBy("c_custkey").agg(F.min("code").alias("code"))


@query("j17_missing_entities", "SELECT station_id FROM station WHERE station_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-30')")
def j17(v):
    arrived = v.table("events").filter(c("ts") >= F.lit("2024-01-30").cast("timestamp_ntz")).select(c("user_id").alias("station_id"))
    return v.station.select("station_id").join(arrived, "station_id", "left_anti")


@query("j18_entities_with_data", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j18(v):
    rich = v.table("orders").filter("o_totalprice > 400000").select(c("o_custkey").alias("c_custkey"))
    return v.table("customer").select("c_custkey").join(rich, "c_custkey", "left_semi")


@query("j19_training_spine", "SELECT station_id, strftime(d, '%Y-%m-%d') AS day FROM station CROSS JOIN (SELECT unnest(generate_series((SELECT min(day) FROM daily), (SELECT max(day) FROM daily), INTERVAL 1 DAY)) AS d)")
def j19(v):
    """Every date for every entity, by a sequence per entity between two scalar bounds."""
    d = v.daily
    days = F.sequence(d.agg(F.min("day")).scalar(), d.agg(F.max("day")).scalar(), F.expr("interval 1 day"))
    return v.station.select("station_id", F.explode(days).alias("d")).select("station_id", F.date_format("d", "yyyy-MM-dd").alias("day"))


@query("j23_overlay_defaults", "SELECT n_nationkey AS river_id, coalesce(f.w, 30.0 + n_nationkey * 4) AS width_m, CAST(coalesce(f.b, 2.5) AS DOUBLE) AS bank_m FROM nation LEFT JOIN (SELECT river_id, round(avg(discharge_cms) / 5, 4) AS w, CASE WHEN river_id % 2 = 0 THEN 3.5 END AS b FROM flow GROUP BY 1) f ON f.river_id = n_nationkey")
def j23(v):
    base = v.table("nation").select(c("n_nationkey").alias("river_id"), (30.0 + c("n_nationkey") * 4).alias("width_m"), F.lit(2.5).alias("bank_m"))
    feats = v.flow.groupBy("river_id").agg(F.round(F.avg("discharge_cms") / 5, 4).alias("width_m")).withColumn("bank_m", F.when(c("river_id") % 2 == 0, 3.5))
    return J.overlay(base, feats, "river_id", ["width_m", "bank_m"])


# --- rain fusion: daily satellite field on the cells, gauges are stations ----
SQL_VIEWS["sat"] = "SELECT day, cell_id, lat, lon, value / 10 * (1 + (dayofyear(day) % 5) / 4.0) AS background FROM cell CROSS JOIN (SELECT DISTINCT day FROM daily)"
SQL_VIEWS["gauge_day"] = """SELECT d.day, d.station_id, s.lat, s.lon, d.precip_mm / 10 AS rain, coalesce(g.value / 1 * (1 + (dayofyear(d.day) % 5) / 4.0), 0.0) AS sat, CASE WHEN d.precip_mm > 200 THEN 2 WHEN d.precip_mm > 100 THEN 1 ELSE 0 END AS qc
    FROM daily d JOIN station s USING (station_id) LEFT JOIN grid g ON g.lat_idx = CAST(round(s.lat + 11) AS INTEGER) AND g.lon_idx = CAST(round(s.lon - 95) AS INTEGER)"""
SQL_VIEWS["ratio"] = "SELECT *, CASE WHEN sat > 0 THEN least(greatest(rain / (sat * 2.0 + 1e-6), 0.1), 5.0) WHEN rain > 0 THEN 3.0 ELSE 1.0 END AS r FROM gauge_day"
SQL_VIEWS["near_site"] = f"SELECT k.cell_id, s.station_id, pow(pow(k.lon - s.lon, 2) + pow(k.lat - s.lat, 2) + 1e-12, -2.0) AS w FROM cell k JOIN station s ON abs(k.lat - s.lat) <= 2.8 AND {sql_distance('k.', 's.')} <= 300"
SQL_VIEWS["bias"] = """SELECT s.day, s.cell_id, s.background, CASE WHEN n >= 3 THEN mean ELSE 1.0 END AS bias FROM sat s LEFT JOIN (
    SELECT day, cell_id, count(*) AS n, sum(w * r) / sum(w) AS mean FROM ratio JOIN near_site USING (station_id) WHERE qc = 0 GROUP BY 1, 2) USING (day, cell_id)"""


def day_factor() -> F.Column:
    return 1 + (F.dayofyear("day") % 5) / 4.0


def satellite(v: Views) -> DataFrame:
    """Long grid table (day, cell): a field for every day that has readings.

    Days come from two scalar bounds as a sequence, so cells are not crossed with a table.
    """
    d = v.daily
    days = F.sequence(d.agg(F.min("day")).scalar(), d.agg(F.max("day")).scalar(), F.expr("interval 1 day"))
    g = v.cell.select("cell_id", "lat", "lon", "value", F.explode(days).alias("day"))
    g = g.join(d.select("day").distinct(), "day", "left_semi")
    return g.select("day", "cell_id", "lat", "lon", (c("value") / 10 * day_factor()).alias("background"))


def gauge_day(v: Views) -> DataFrame:
    s = v.station.withColumns({"lat_idx": nearest_index(c("lat"), -11.0, 1.0, 99), "lon_idx": nearest_index(c("lon"), 95.0, 1.0, 99)}).join(grid(v), ["lat_idx", "lon_idx"], "left")
    d = v.daily.join(s, "station_id")
    p = c("precip_mm")
    return d.select("day", c("station_id").alias("gauge_id"), c("lat").alias("g_lat"), c("lon").alias("g_lon"), (p / 10).alias("rain"),
                    F.coalesce(c("value") * day_factor(), F.lit(0.0)).alias("sat"), F.when(p > 200, 2).when(p > 100, 1).otherwise(0).alias("qc"))


def idw_field(v: Views) -> DataFrame:
    g = gauge_day(v).filter("qc = 0").withColumn("ratio", fusion.gauge_ratio(c("rain"), c("sat")))
    return fusion.idw_bias(satellite(v), g, "day")


@query("g03_idw_bias_field", "SELECT strftime(day, '%Y-%m-%d') AS day, cell_id, round(bias, 6) AS bias, round(background * bias, 7) AS corrected FROM bias")
def g03(v):
    return idw_field(v).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "cell_id", F.round("bias", 6).alias("bias"), F.round(c("background") * c("bias"), 7).alias("corrected"))


@query("a18_bias_quantiles", "SELECT strftime(day, '%Y-%m-%d') AS day, round(avg(bias), 6) AS mean_bias, round(quantile_cont(bias, 0.1), 5) AS p10, round(quantile_cont(bias, 0.9), 5) AS p90 FROM bias WHERE bias > 0 GROUP BY 1")
def a18(v):
    f = sized(idw_field(v).filter("bias > 0 and not isnan(bias)").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "bias"), "bias")
    q = quantiles(f, ["day"], "bias", {"p10": 0.1, "p90": 0.9})
    return f.groupBy("day").agg(F.round(F.avg("bias"), 6).alias("mean_bias")).join(q, "day").select("day", "mean_bias", F.round("p10", 5).alias("p10"), F.round("p90", 5).alias("p90"))


@query("a17_field_summary", "SELECT strftime(day, '%Y-%m-%d') AS day, round(max(p), 5) AS max_mm, round(avg(p), 6) AS mean_mm, round(avg(CASE WHEN p IS NOT NULL THEN 1.0 ELSE 0 END) * 100, 4) AS coverage_pct, bool_or(p > 50) AS extreme FROM (SELECT day, least(greatest(background * bias, 0), 200) AS p FROM bias) GROUP BY 1")
def a17(v):
    p = c("p")
    f = idw_field(v).select(F.date_format("day", "yyyy-MM-dd").alias("day"), clip(c("background") * c("bias"), 0, 200).alias("p"))
    return f.groupBy("day").agg(F.round(F.max(p), 5).alias("max_mm"), F.round(F.avg(p), 6).alias("mean_mm"), F.round(F.avg(p.isNotNull().cast("double")) * 100, 4).alias("coverage_pct"), F.bool_or(p > 50).alias("extreme"))


@query("a62_gauge_check_rmse", "SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, round(sqrt(avg(pow(rain - sat, 2))), 6) AS rmse FROM gauge_day WHERE qc = 0 GROUP BY 1")
def a62(v):
    """Field at the nearest cell against the gauge, good readings only."""
    g = gauge_day(v).filter("qc = 0")
    return g.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.pow(c("rain") - c("sat"), 2))), 6).alias("rmse"))


@query("g01_optimal_interpolation")
def g01(v):
    """Needs a matrix inverse, which SQL has not; tested against a direct solution on a small network."""
    g = gauge_day(v).filter("qc < 2").withColumn("innovation", c("rain") - c("sat"))
    f = fusion.optimal_interpolation(satellite(v), g, "day")
    return f.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "cell_id", F.round("analysis", 6).alias("analysis"))


@query("g02_kriging_bias_field")
def g02(v):
    """Needs a matrix inverse, which SQL has not; tested against a direct solution on a small network."""
    g = gauge_day(v).filter("qc = 0").withColumn("ratio", fusion.kriging_ratio(c("rain"), c("sat")))
    f = fusion.kriging_bias(satellite(v), g, "day")
    return f.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "cell_id", F.round("bias", 6).alias("bias"), F.round("fused", 5).alias("fused"))


@query("t06_ratio_filter", """WITH RECURSIVE d AS (SELECT station_id, r, row_number() OVER (PARTITION BY station_id ORDER BY day) AS i FROM ratio), k AS (
    SELECT station_id, 0::BIGINT AS i, 1.0::DOUBLE AS x, 1.0::DOUBLE AS p FROM d GROUP BY 1 UNION ALL
    SELECT d.station_id, d.i, CASE WHEN abs(d.r - 1) > 1.001e-5 THEN k.x + (k.p + 0.04) / (k.p + 0.04 + 0.25) * (d.r - k.x) ELSE k.x END, CASE WHEN abs(d.r - 1) > 1.001e-5 THEN (1 - (k.p + 0.04) / (k.p + 0.04 + 0.25)) * (k.p + 0.04) ELSE k.p + 0.04 END
    FROM k JOIN d ON d.station_id = k.station_id AND d.i = k.i + 1)
    SELECT station_id, max(i) AS steps, round(arg_max(x, i), 8) AS state, round(arg_max(p, i), 8) AS variance FROM k GROUP BY 1""")
def t06(v):
    g = gauge_day(v).withColumn("ratio", fusion.gauge_ratio(c("rain"), c("sat")))
    f = fusion.ratio_filter(g.select(c("gauge_id").alias("station_id"), "day", "ratio"), ["station_id"], "day", "ratio")
    return f.select("station_id", "steps", F.round("state", 8).alias("state"), F.round("variance", 8).alias("variance"))

"""Scans and sinks: files are written from the given tables by Spark and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from raincourse.registry import query
from raincourse.session import new_path
from raincourse.sources import scans, sinks
from raincourse.streaming.pipelines import upsert_stream
from raincourse.views import SQL_VIEWS, Views

c = F.col


def text_file(v: Views, df: DataFrame, name: str) -> str:
    """Write one text column under the shared folder and give its path."""
    path = new_path(v.spark, name)
    df.write.text(path)
    return path


@query("s01_json_documents", "SELECT event_type, count(*) FILTER (WHERE event_id % 101 <> 0) AS good, round(sum(value) FILTER (WHERE event_id % 101 <> 0), 4) AS total, any_value(bad) AS unreadable FROM events CROSS JOIN (SELECT count(*) AS bad FROM events WHERE event_id % 101 = 0) GROUP BY 1")
def s01(v):
    """JSON lines with some cut off in the middle; those are counted apart."""
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    path = text_file(v, v.events.select(F.when(c("event_id") % 101 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value")), "documents")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    good, bad = scans.json_documents(v.spark, path, schema)
    return good.groupBy("event_type").agg(F.count("*").alias("good"), F.round(F.sum("value"), 4).alias("total"), bad.agg(F.count("*")).scalar().alias("unreadable"))


@query("s01_keyed_map", "SELECT concat('ws_', watershed_id) AS watershed, strftime(month, '%Y-%m') AS month, round(theta, 8) AS theta, round(theta - 0.01, 8) AS theta_prev FROM monthly")
def s01b(v):
    """One object per month keyed by watershed id."""
    m = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("ws_"), c("watershed_id").cast("string")), F.struct(F.date_format("month", "yyyy-MM").alias("month"), "theta", (c("theta") - 0.01).alias("theta_prev")))))
    path = text_file(v, v.monthly.groupBy("month").agg(F.to_json(m).alias("value")).select("value"), "keyed")
    rows = scans.keyed_map(v.spark.read.text(path), "value", "struct<month:string,theta:double,theta_prev:double>", "watershed")
    return rows.select("watershed", "month", F.round("theta", 8).alias("theta"), F.round("theta_prev", 8).alias("theta_prev"))


@query("s02_gauge_csv", "SELECT CAST(user_id AS VARCHAR) AS station_id, count(*) AS n, round(sum(greatest(value - 20, 0)), 4) AS precip_mm FROM events WHERE event_id % 50 <> 0 GROUP BY 1")
def s02(v):
    path = new_path(v.spark, "gauges")
    s = c("user_id")
    (v.events.select(s.cast("string").alias("station_id"), (-11 + ((s * 37) % 1700) / 100.0).cast("string").alias("lat"), (95 + ((s * 61) % 4600) / 100.0).cast("string").alias("lon"),
                     F.when(c("event_id") % 50 == 0, "n/a").otherwise((c("value") - 20).cast("string")).alias("precip_mm_30min")).write.csv(path, header=True))
    return scans.gauge_csv(v.spark, path).groupBy("station_id").agg(F.count("*").alias("n"), F.round(F.sum("precip_mm"), 4).alias("precip_mm"))


@query("s03_moisture_csv", "SELECT concat('r', station_id % 5) AS region, strftime(date_trunc('month', day), '%Y-%m') AS month, round(sum(precip_mm), 4) AS precip_mm, round(avg(aux_sum / 100.0), 6) AS theta FROM daily GROUP BY 1, 2")
def s03(v):
    path = new_path(v.spark, "moisture")
    v.daily.select(F.concat(F.lit("r"), (c("station_id") % 5).cast("string")).alias("region"), "day", "precip_mm", (c("aux_sum") / 100.0).alias("theta")).write.csv(path, header=True)
    return scans.moisture_csv(v.spark, path).select("region", F.date_format("month", "yyyy-MM").alias("month"), F.round("precip_mm", 4).alias("precip_mm"), F.round("theta", 6).alias("theta"))


@query("s04_feature_parquet", "SELECT station_id, row_number() OVER (PARTITION BY station_id ORDER BY day) - 1 AS time_idx, round(temp_c, 6) AS temp_c, CASE WHEN day >= DATE '2024-01-16' THEN round(precip_mm, 6) END AS precip_mm FROM daily")
def s04(v):
    """Two generations of files with different columns, read as one; a time index is added."""
    from pyspark.sql import Window

    path = new_path(v.spark, "features")
    v.daily.filter("day < date'2024-01-16'").select("station_id", "day", "temp_c").write.parquet(f"{path}/gen=1")
    v.daily.filter("day >= date'2024-01-16'").select("station_id", "day", "temp_c", "precip_mm").write.parquet(f"{path}/gen=2")
    w = Window.partitionBy("station_id").orderBy("day")
    return scans.feature_parquet(v.spark, path).select("station_id", (F.row_number().over(w) - 1).cast("long").alias("time_idx"), F.round("temp_c", 6).alias("temp_c"), F.round("precip_mm", 6).alias("precip_mm"))


@query("s05_grid_table", "SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS cells, round(sum(precip_mm), 4) AS total FROM daily WHERE day BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY 1")
def s05(v):
    """Grid rows partitioned by date, a date spread over several files; the scan lists three dates only."""
    path = new_path(v.spark, "grid")
    s = c("station_id")
    g = v.daily.select(c("day").alias("date"), ((s * 37) % 1700).cast("int").alias("lat_idx"), ((s * 61) % 4600).cast("int").alias("lon_idx"), c("precip_mm").alias("value"))
    g.repartition("date", c("lat_idx") % 8).write.partitionBy("date").parquet(path)
    r = scans.grid_table(v.spark, path, "2024-01-10", "2024-01-12")
    return r.groupBy(F.date_format("date", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("cells"), F.round(F.sum("value"), 4).alias("total"))


@query("s06_relational_tables", "SELECT CAST(user_id AS VARCHAR) AS station_id, event_type AS variable, count(*) AS n, sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END)::BIGINT AS quality_sum FROM events WHERE event_id % 9 <> 0 GROUP BY 1, 2")
def s06(v):
    """Typed rows with defaults; a missing time breaks the constraint and repeated keys count once."""
    e = v.events.select(c("user_id").alias("station_id"), F.when(c("event_id") % 9 != 0, c("ts")).alias("observed_at"), c("event_type").alias("variable"), "value",
                        F.when(c("event_id") % 4 != 0, F.lit(1)).alias("quality"))
    path = new_path(v.spark, "observations")
    scans.table_rows(e.unionByName(e.filter("value > 50")), "climate_observations").write.parquet(path)
    t = v.spark.read.parquet(path)
    return t.groupBy("station_id", "variable").agg(F.count("*").alias("n"), F.sum("quality").alias("quality_sum"))


@query("s07_message_bus", "SELECT event_type AS topic_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s07(v):
    """Messages as the bus delivers them, some of them twice, read as a stream and merged into a table by their id.

    The messages are files with the columns of a Kafka source; each event stands for a message, one in seven
    comes again later, and one in five had an earlier value.
    """
    k = c("event_id")
    message = lambda value, offset: F.struct(
        k.cast("string").cast("binary").alias("key"), F.to_json(F.struct("event_id", "event_type", value.alias("value"))).cast("binary").alias("value"),
        F.concat(F.lit("etl-"), c("event_type")).alias("topic"), (k % 3).cast("int").alias("partition"), offset.alias("offset"), c("ts").cast("timestamp").alias("timestamp"))
    sent = v.events.select(F.inline(F.filter(F.array(
        message(c("value"), k * 3 + 1), F.when(k % 7 == 0, message(c("value"), k * 3 + 2)), F.when(k % 5 == 0, message(c("value") + 1, k * 3))), lambda m: m.isNotNull())))
    path = new_path(v.spark, "bus")
    sent.write.parquet(f"{path}/messages")
    bus = v.spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/messages")
    rows = bus.select("offset", F.from_json(c("value").cast("string"), "event_id long, event_type string, value double").alias("m")).select("offset", "m.*")
    m = upsert_stream(rows, ["event_id"], "offset", f"{path}/merged")
    return m.groupBy(c("event_type").alias("topic_type")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("s08_station_feed", "SELECT CAST(station_id AS VARCHAR) AS station_id, count(*) FILTER (WHERE n_obs % 7 <> 0) AS good, round(sum(precip_mm) FILTER (WHERE n_obs % 7 <> 0), 5) AS rainfall_mm FROM daily GROUP BY 1 HAVING count(*) FILTER (WHERE n_obs % 7 <> 0) > 0")
def s08(v):
    """Feed documents of a day and up to a hundred stations; items with a broken number are rejected."""
    item = F.struct(c("station_id").cast("string").alias("station_id"), F.when(c("n_obs") % 7 == 0, "bad").otherwise("1.5").alias("lat"), F.lit("100").alias("lon"), c("precip_mm").cast("string").alias("rainfall"))
    docs = v.daily.groupBy("day", F.floor(c("station_id") / 100)).agg(F.to_json(F.struct(F.collect_list(item).alias("data"))).alias("doc"))
    good, _ = scans.station_feed(docs, "doc")
    return good.groupBy("station_id").agg(F.count("*").alias("good"), F.round(F.sum("rainfall_mm"), 5).alias("rainfall_mm"))


@query("s09_granule_catalogue", "SELECT 'g' || o_orderkey AS id, round(o_totalprice / 7, 2) AS size_mb, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'https://data/' || o_orderkey END AS url FROM orders WHERE (o_orderkey * 7) % 100 < 20 AND o_orderdate >= TIMESTAMP '1997-01-01'")
def s09(v):
    """Nested catalogue pages of at most a thousand entries; the first link whose relation is data; filters on time and cloud."""
    k = c("o_orderkey")
    data = F.struct(F.when(k % 3 == 0, "browse").otherwise(scans.DATA_LINK).alias("rel"), F.concat(F.lit("https://data/"), k.cast("string")).alias("href"))
    entry = F.struct(F.concat(F.lit("g"), k.cast("string")).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time_start"), (c("o_totalprice") / 7).alias("granule_size"),
                     ((k * 7) % 100).cast("double").alias("cloud_cover"), F.array(F.struct(F.lit("metadata").alias("rel"), F.lit("https://meta").alias("href")), data).alias("links"))
    docs = v.table("orders").groupBy(F.floor(k / 1000).alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(entry).alias("entry")).alias("feed"))).alias("doc"))
    g = scans.granule_feed(docs, "doc")
    return g.filter((c("cloud_cover") < 20) & (c("time_start") >= F.lit("1997-01-01").cast("timestamp"))).select("id", "size_mb", "url")


@query("s10_index_text", "SELECT CAST(watershed_id AS VARCHAR) AS basin, CAST(year(month) AS INTEGER) AS year, CAST(month(month) AS INTEGER) AS month, round((p_mm - 620) / 100, 2) AS index_value FROM monthly QUALIFY row_number() OVER (PARTITION BY watershed_id ORDER BY monthly.month DESC) <= 6")
def s10(v):
    line = F.format_string("  %d   %d  %d   %s", "watershed_id", F.year("month"), F.month("month"), F.round((c("p_mm") - 620) / 100, 2).cast("string"))
    lines = v.monthly.select(F.explode(F.when(F.month("month") == 1, F.array(F.lit("BASIN YR MON ANOM"), line)).otherwise(F.array(line))).alias("value"))
    return scans.index_text(v.spark, text_file(v, lines, "index"), ["basin"], 6)


@query("s11_rain_quality_code", "SELECT event_id, CASE WHEN value - 10 < 0 OR value - 10 > 200 THEN 2 WHEN value - 10 > 100 THEN 1 ELSE 0 END AS qc_flag, greatest(value - 10, 0) AS precip_mm FROM events")
def s11(v):
    x = c("value") - 10
    return v.events.select("event_id", scans.rain_quality(x).alias("qc_flag"), F.greatest(x, F.lit(0.0)).alias("precip_mm"))


@query("s12_alert_queue", "SELECT severity, count(*) AS n FROM alert WHERE severity IN ('high', 'critical') GROUP BY 1")
def s12(v):
    """Two appends to the queue, then the whole queue read back."""
    path = new_path(v.spark, "queue")
    a = v.alert.filter(c("severity").isin("high", "critical")).select("alert_id", "severity", "issued_at")
    cut = F.lit("2024-01-15").cast("timestamp")
    sinks.append_alerts(a.filter(c("issued_at") < cut), path)
    sinks.append_alerts(a.filter(c("issued_at") >= cut), path)
    return v.spark.read.schema("alert_id long, severity string, issued_at timestamp").json(path).groupBy("severity").agg(F.count("*").alias("n"))


@query("s13_latest_state", "SELECT entity_id, arg_max(severity, (issued_at, alert_id)) AS severity, max(alert_id) AS last_id FROM alert GROUP BY 1")
def s13(v):
    """State written twice; only the last state remains."""
    path = new_path(v.spark, "latest")
    a = v.alert
    for part in (a.filter("issued_at < timestamp'2024-01-10'"), a):
        state = part.groupBy("entity_id").agg(F.max_by("severity", F.struct("issued_at", "alert_id")).alias("severity"), F.max("alert_id").alias("last_id"))
        sinks.write_latest(state, path)
    return v.spark.read.parquet(path)


@query("s14_monthly_upsert", "SELECT station_id, strftime(day, '%Y-%m-%d') AS day, round(precip_mm + CASE WHEN day >= DATE '2024-01-20' THEN 1 ELSE 0 END, 6) AS precip_mm FROM daily")
def s14(v):
    """Rows of a date are replaced, others appended; only touched partitions are rewritten."""
    path = new_path(v.spark, "upsert")
    d = v.daily.select("station_id", "day", "precip_mm", F.lit(1).alias("version"), F.weekofyear("day").alias("week"))
    d.filter("day < date'2024-01-25'").repartition("week", c("station_id") % 8).write.partitionBy("week").parquet(path)
    new = d.filter("day >= date'2024-01-20'").withColumns({"precip_mm": c("precip_mm") + 1, "version": F.lit(2)})
    sinks.upsert_partitions(v.spark, path, new, "week", ["station_id", "day"], "version")
    return v.spark.read.parquet(path).select("station_id", F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("precip_mm", 6).alias("precip_mm"))


@query("s15_wet_cell_geojson", "SELECT cell_id, round(lon - 0.02, 6) AS west, round(lat + 0.02, 6) AS north, round(value - 10, 3) AS precip_mm FROM cell WHERE value - 10 >= 0.01")
def s15(v):
    x = v.cell.withColumn("p", c("value") - 10).filter("p >= 0.01")
    j = x.select(sinks.wet_cell_json(c("lon"), c("lat"), 0.02, {"cell_id": c("cell_id"), "precip_mm": F.round("p", 3)}).alias("value"))
    t = v.spark.read.text(text_file(v, j, "geojson"))
    g = lambda p: F.get_json_object("value", p)
    return t.select(g("$.properties.cell_id").cast("long").alias("cell_id"), F.round(g("$.geometry.coordinates[0][0][0]").cast("double"), 6).alias("west"),
                    F.round(g("$.geometry.coordinates[0][2][1]").cast("double"), 6).alias("north"), g("$.properties.precip_mm").cast("double").alias("precip_mm"))


@query("s17_log_lines", "SELECT level, count(*) AS n, sum(len(message))::BIGINT AS chars, any_value(d) AS dead FROM (SELECT lower(role) AS level, text AS message FROM conversations WHERE NOT (turn % 5 = 3) AND NOT ((conv_id + turn) % 11 = 0)) CROSS JOIN (SELECT count(*) AS d FROM conversations WHERE (conv_id + turn) % 11 = 0) GROUP BY 1")
def s17(v):
    """Whole texts as log messages; broken lines go to the dead letters, health checks are dropped."""
    t = v.table("conversations")
    line = F.to_json(F.struct(F.lit("app").alias("log_type"), F.upper("role").alias("level"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
                              F.when(c("turn") % 5 == 3, "/v1/health").otherwise("/v1/alerts").alias("request"), c("text").alias("message")))
    lines = t.select(F.when((c("conv_id") + c("turn")) % 11 == 0, F.concat(F.lit("{broken "), c("role"))).otherwise(line).alias("line"))
    events, dead = scans.log_lines(lines, "line")
    return events.groupBy("level").agg(F.count("*").alias("n"), F.sum(F.length("message")).alias("chars"), dead.agg(F.count("*")).scalar().alias("dead"))


@query("s18_table_run", "SELECT 'daily' AS dataset, count(*) AS records, 'success' AS status FROM daily")
def s18(v):
    """Extract, transform, load with the row count observed in the same job, then a run record."""
    path = new_path(v.spark, "run")
    seen = Observation("load")
    v.daily.observe(seen, F.count("*").alias("records")).write.parquet(path)
    n = seen.get["records"]
    status = F.when(F.count("*") == n, "success").otherwise("failed")
    return v.spark.read.parquet(path).agg(F.lit("daily").alias("dataset"), F.lit(n).cast("long").alias("records"), status.alias("status"))


@query("s19_newest_file", """SELECT CAST(river_id AS INTEGER) AS river_id, max(year(day))::VARCHAR AS stamp, count(*) AS n, strftime(max(day), '%Y-%m-%d') AS last_day, round(max(discharge_cms), 6) AS peak_cms
    FROM daily_flow WHERE year(day) = (SELECT max(year(d.day)) FROM daily_flow d WHERE d.river_id = daily_flow.river_id) GROUP BY river_id""")
def s19(v):
    """One JSON file per river and year is written; the newest of each river is found by its name and read back."""
    path = new_path(v.spark, "forecasts")
    d = v.daily_flow.select("river_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "discharge_cms")
    d = d.withColumns({"river": c("river_id"), "stamp": F.substring("day", 1, 4)})
    d.repartition("river", "stamp").write.partitionBy("river", "stamp").json(path)
    files = scans.newest_files(v.spark, path, r"river=(\d+)/stamp=(\d{4})/[^/]*\.json$")
    schema = T.StructType([T.StructField("river_id", T.IntegerType()), T.StructField("day", T.StringType()), T.StructField("discharge_cms", T.DoubleType())])
    rows = scans.rows_of_files(v.spark, path, files, schema)
    return rows.groupBy("river_id", "stamp").agg(F.count("*").alias("n"), F.max("day").alias("last_day"), F.round(F.max("discharge_cms"), 6).alias("peak_cms"))

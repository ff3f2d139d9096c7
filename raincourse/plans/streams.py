"""Streaming operators and their exact batch forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourse.operators import fusion
from raincourse.operators import learning as L
from raincourse.operators import statistics as S
from raincourse.operators.ordered import last_known
from raincourse.plans.spatial import gauge_day
from raincourse.plans.water import cascade_factor, river_supply
from raincourse.registry import ORACLES, query
from raincourse.session import new_path
from raincourse.sources.sinks import merged_rows
from raincourse.streaming import pipelines as P
from raincourse.streaming import state as ST
from raincourse.views import SQL_VIEWS, Views

c = F.col
TTL = 6 * 3600


def stream(v: Views) -> DataFrame:
    """The events table as a file stream; watermarks need a timestamp with zone."""
    return P.table_stream(v.spark, v.folder, "events").withColumn("ts", c("ts").cast("timestamp"))


def slot_text(name: str, out: str) -> F.Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(out)


@query("t01_half_hour_stream", "SELECT station_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS slot, round(precip_mm, 6) AS rain FROM half_hour WHERE epoch_us(slot) + 1800000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM obs) - 35 * 60000000")
def t01(v):
    """Rain per station and half hour; the windows past the watermark at the end of the input."""
    r = stream(v).select(c("user_id").alias("station_id"), "ts", (c("value") / 5).alias("precip_mm"))
    t = P.run_to_table(P.windowed_rain(r, "station_id", "ts", "precip_mm"), "half-hour")
    return t.select("station_id", slot_text("start", "slot"), F.round("rain", 6).alias("rain"))


@query("t08_sliding_rain", "SELECT station_id, strftime(slot, '%Y-%m-%d %H:%M:%S') AS window_start, round(sum(precip_mm), 6) AS rain FROM (SELECT station_id, precip_mm, unnest([time_bucket(INTERVAL '30 minutes', ts) - i * INTERVAL 30 MINUTE for i in range(6)]) AS slot FROM obs) GROUP BY 1, 2")
def t08(v):
    """Three-hour sums every half hour."""
    t = P.windowed_rain(v.obs, "station_id", "ts", "precip_mm", "3 hours", "30 minutes")
    return t.select("station_id", slot_text("start", "window_start"), F.round("rain", 6).alias("rain"))


SQL_VIEWS["reading"] = "SELECT event_id, station_id, ts, CASE WHEN value >= 40 THEN value END AS x FROM obs"
SQL_GOOD = """SELECT event_id, round(coalesce(x, l), 6) AS value, CASE WHEN x IS NOT NULL THEN 'live' WHEN l IS NOT NULL THEN 'fallback' ELSE 'missing' END AS source FROM (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM reading)"""


@query("t02_last_good_batch", SQL_GOOD)
def t02(v):
    """A failed reading takes the last good one of its station, with a source flag."""
    r = v.obs.select("event_id", "station_id", "ts", F.when(c("value") >= 40, c("value")).alias("x"))
    k = last_known(r, ["station_id"], ["ts", "event_id"], "x", "l", 86400.0)
    return k.select("event_id", F.round("l", 6).alias("value"), F.when(c("x").isNotNull(), "live").when(c("l").isNotNull(), "fallback").otherwise("missing").alias("source"))


@query("t02_last_good_stream", SQL_GOOD)
def t02s(v):
    t = P.run_to_end(stream(v), "ts", lambda r: P.last_good_stream(r, "user_id", "ts", "event_id", F.when(c("value") >= 40, c("value"))), "last-good")
    return t.select("event_id", F.round("value", 6).alias("value"), "source")


SQL_SENT = f"""WITH RECURSIVE a AS (SELECT entity_id, alert_id, epoch_us(issued_at) AS us FROM alert WHERE severity IN ('high', 'critical')),
    s AS (SELECT entity_id, min(us) AS us FROM a GROUP BY 1 UNION ALL SELECT entity_id, us FROM (SELECT s.entity_id, min(a.us) AS us FROM s JOIN a ON a.entity_id = s.entity_id AND a.us >= s.us + {TTL * 1000000} GROUP BY s.entity_id, s.us))
    SELECT s.entity_id, min(a.alert_id) AS alert_id, s.us AS sent_us FROM s JOIN a ON a.entity_id = s.entity_id AND a.us = s.us GROUP BY 1, 3"""


@query("t03_alert_suppression_batch", SQL_SENT)
def t03(v):
    """Silence counts from the last alert that was sent, not the last that was seen."""
    return ST.suppress_repeats(v.alert.filter(c("severity").isin("high", "critical")), "entity_id", "issued_at", "alert_id", TTL)


@query("t03_alert_suppression_stream", SQL_SENT)
def t03s(v):
    a = stream(v).filter("value >= 100").select(c("user_id").alias("entity_id"), c("event_id").alias("alert_id"), "ts")
    return P.run_to_end(a, "ts", lambda r: P.suppress_stream(r, "entity_id", "ts", "alert_id", TTL), "sent")


SQL_LIFE = """SELECT entity_id, alert_id, state AS level, CASE WHEN state = 'low' THEN 'resolve' ELSE 'create' END AS action FROM (SELECT *, lag(state, 1, 'low') OVER (PARTITION BY entity_id ORDER BY issued_at, alert_id) AS prev FROM (SELECT *, CASE WHEN severity = 'low' THEN 'low' ELSE strftime(issued_at, '%Y%m%d') || '-' || severity END AS state FROM alert)) WHERE state <> prev"""


def alert_state(level: F.Column, ts: str) -> F.Column:
    """Identity of an alert: day and level, so that a level that holds is issued anew each day."""
    return F.when(level == "low", "low").otherwise(F.concat_ws("-", F.date_format(ts, "yyyyMMdd"), level))


@query("t04_alert_lifecycle_batch", SQL_LIFE)
def t04(v):
    return ST.level_changes(v.alert, "entity_id", "issued_at", "alert_id", alert_state(c("severity"), "issued_at"), "low")


@query("t04_alert_lifecycle_stream", SQL_LIFE)
def t04s(v):
    x = c("value")
    level = F.when(x >= 150, "critical").when(x >= 100, "high").when(x >= 50, "medium").otherwise("low")
    a = stream(v).select(c("user_id").alias("entity_id"), c("event_id").alias("alert_id"), "ts", "value")
    return P.run_to_end(a, "ts", lambda r: P.lifecycle_stream(r, "entity_id", "ts", "alert_id", alert_state(level, "ts"), "low"), "lifecycle")


SQL_LATE = "SELECT station_id, count(*) FILTER (WHERE d <= 35) AS in_time, count(*) FILTER (WHERE d > 35) AS late FROM (SELECT station_id, (event_id * 37) % 100 AS d FROM obs) GROUP BY 1"


def with_arrival(rows: DataFrame) -> DataFrame:
    return rows.withColumn("arrived", F.timestamp_micros(F.unix_micros(c("ts").cast("timestamp")) + (c("event_id") * 37 % 100) * 60_000_000))


def late_counts(in_time: DataFrame, late: DataFrame) -> DataFrame:
    both = in_time.select("station_id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(late.select("station_id", F.lit(0), F.lit(1)))
    return both.groupBy("station_id").agg(F.sum("a").alias("in_time"), F.sum("b").alias("late"))


@query("t07_late_rows", SQL_LATE)
def t07(v):
    """Rows that arrive after the limit go to a side table; both tables together hold every row."""
    return late_counts(*ST.split_late(with_arrival(v.obs), "ts", "arrived", 35 * 60))


@query("t07_late_rows_stream", SQL_LATE)
def t07s(v):
    """The same from a stream with two sinks."""
    rows = with_arrival(stream(v).select(c("user_id").alias("station_id"), "event_id", "ts"))
    return late_counts(*P.split_stream(rows, "ts", 35 * 60, new_path(v.spark, "late"), "arrived"))


def as_stream(v: Views, rows: DataFrame, name: str) -> DataFrame:
    """A derived table written as files and read as a stream, some files a micro-batch."""
    path = new_path(v.spark, name)
    rows.repartition(6).write.parquet(path)
    return v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(path)


DECADE = "4000 days"  # the daily tables span years, and their files come in any order


@query("t05_storage_stream")
def t05s(v):
    """Storage carried from day to day on a stream of river flows; reservoirs are a table beside it, in blocks by river."""
    flows = as_stream(v, v.daily_flow.select("river_id", c("day").cast("timestamp").alias("ts"), "discharge_cms"), "flows")
    reservoirs = v.reservoir.select("river_id", c("reservoir_id").cast("long").alias("reservoir_id"), cascade_factor().alias("factor"), "capacity_m3", "dead_m3")
    r = P.beside(flows, reservoirs, "river_id", "reservoir_id")
    job = lambda x: P.storage_stream(x, "river_id", "reservoir_id", "ts", river_supply(c("discharge_cms")), c("factor"), 240.0, c("capacity_m3"), c("dead_m3"), 24.0, 0.65)
    t = P.run_to_end(r, "ts", job, "storage", DECADE)
    return t.groupBy("reservoir_id").agg(F.count("*").alias("steps"), F.round(F.max_by("storage", "us"), 0).alias("last_m3"), F.round(F.min("storage"), 0).alias("low_m3"), F.round(F.max("storage"), 0).alias("high_m3"))


@query("t06_ratio_filter_stream")
def t06s(v):
    """The bias ratio of each station filtered on a stream of days."""
    g = gauge_day(v).select(c("gauge_id").cast("long").alias("station_id"), c("day").cast("timestamp").alias("ts"), fusion.gauge_ratio(c("rain"), c("sat")).alias("ratio"))
    job = lambda x: P.ratio_filter_stream(x, "station_id", "ts", c("ratio"), fusion.PROCESS_NOISE, fusion.OBSERVATION_NOISE)
    t = P.run_to_end(as_stream(v, g, "ratios"), "ts", job, "ratio", DECADE)
    last = F.max_by(F.struct("state", "variance"), "us").alias("last")
    return t.groupBy("station_id").agg(F.count("*").alias("steps"), last).select("station_id", "steps", F.round("last.state", 8).alias("state"), F.round("last.variance", 8).alias("variance"))


for streamed, batch in (("t05_storage_stream", "t05_storage_series"), ("t06_ratio_filter_stream", "t06_ratio_filter")):
    ORACLES[streamed] = ORACLES[batch]


@query("t09_monthly_history_trend", "SELECT watershed_id, count(*) AS months, round(regr_slope(v, t), 6) AS slope FROM (SELECT watershed_id, CASE WHEN month = (SELECT max(month) FROM monthly) THEN p_mm + 5 ELSE p_mm END AS v, (year(month) * 12 + month(month)) / 12.0 - 1990 AS t FROM monthly) GROUP BY 1")
def t09(v):
    """A new month is merged into the history (same month replaced), then the trend is fitted anew."""
    m = v.monthly.select("watershed_id", "month", "p_mm")
    last = m.agg(F.max("month")).scalar()
    update = m.filter(c("month") == last).withColumn("p_mm", c("p_mm") + 5)
    h = merged_rows(m, update, ["watershed_id", "month"], "month")
    t = (F.year("month") * 12 + F.month("month")) / 12.0 - 1990
    return L.linear_trend(h.withColumn("t", t), ["watershed_id"], "p_mm", "t").select("watershed_id", c("n").alias("months"), F.round("slope", 6).alias("slope"))


@query("t10_test_window_extension", """SELECT e AS test_id, 14 + 7 * (e % 4)::INT + CASE WHEN d = 'INCONCLUSIVE' AND e % 4 < 2 THEN 7 ELSE 0 END AS window_days, (e % 4)::INT + CASE WHEN d = 'INCONCLUSIVE' AND e % 4 < 2 THEN 1 ELSE 0 END AS extensions, CASE WHEN d IS NULL OR (d = 'INCONCLUSIVE' AND e % 4 < 2) THEN 'ACTIVE' ELSE 'CONCLUDED' END AS status
    FROM (SELECT entity_id AS e, CASE WHEN entity_id % 5 = 4 THEN NULL WHEN b > a * 1.1 THEN 'ROLLBACK' WHEN b < a * 0.95 THEN 'PROMOTE' ELSE 'INCONCLUSIVE' END AS d FROM (SELECT entity_id, coalesce(avg(error) FILTER (WHERE role = 'champion'), 0) AS a, coalesce(avg(error) FILTER (WHERE role <> 'champion'), 0) AS b FROM err GROUP BY 1))""")
def t10(v):
    e = v.err
    k = c("entity_id")
    tests = e.select(k.alias("test_id")).distinct().select("test_id", (14 + 7 * (c("test_id") % 4)).cast("int").alias("window_days"), (c("test_id") % 4).cast("int").alias("extensions"))
    a, b = (F.coalesce(F.avg(F.when(p, c("error"))), F.lit(0.0)) for p in (c("role") == "champion", c("role") != "champion"))
    r = e.filter(k % 5 != 4).groupBy(k.alias("test_id")).agg(a.alias("a"), b.alias("b"))
    d = F.when(c("b") > c("a") * 1.1, "ROLLBACK").when(c("b") < c("a") * 0.95, "PROMOTE").otherwise("INCONCLUSIVE")
    return ST.extend_tests(tests, r.select("test_id", d.alias("decision")))

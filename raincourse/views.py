"""Domain tables derived from the given parquet tables.

Every view exists twice: as a DataFrame (``Views``) and as the SQL text of the
same derivation (``SQL_VIEWS``), so a query and its oracle read the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SQL_VIEWS: dict[str, str] = {
    "obs": """SELECT event_id, user_id AS station_id, ts, event_type AS variable, value,
        value / 5 AS precip_mm, CAST(json_extract_string(props, '$.k') AS INTEGER) AS aux
        FROM events""",
    "half_hour": """SELECT station_id, time_bucket(INTERVAL '30 minutes', ts) AS slot,
        sum(precip_mm) AS precip_mm FROM obs GROUP BY 1, 2""",
    "hourly": """SELECT station_id, date_trunc('hour', ts) AS ts, sum(precip_mm) AS precip_mm,
        avg(value) AS temp_c, max(aux) AS humidity FROM obs GROUP BY 1, 2""",
    "daily": """SELECT station_id, CAST(ts AS DATE) AS day, sum(precip_mm) AS precip_mm,
        avg(value) AS temp_c, count(*) AS n_obs, sum(aux) AS aux_sum FROM obs GROUP BY 1, 2""",
    "daily_met": """SELECT station_id, day, 26 + (aux_sum % 10) AS tmax_c, 18 + (aux_sum % 7) AS tmin_c,
        55 + (aux_sum % 40) AS rh_pct, 0.5 + (n_obs % 5) * 0.7 AS wind_u2_ms,
        2 + (aux_sum % 9) AS sunshine_hr, -11 + ((station_id * 37) % 1700) / 100.0 AS lat_deg,
        CAST((station_id * 13) % 1500 AS DOUBLE) AS elev_m, precip_mm
        FROM daily""",
    "station": """SELECT station_id, -11 + ((station_id * 37) % 1700) / 100.0 AS lat,
        95 + ((station_id * 61) % 4600) / 100.0 AS lon, CAST(station_id % 25 AS INTEGER) AS nation_id,
        5 + station_id % 26 AS slope_deg, 0.38 + (station_id % 13) / 100.0 AS porosity,
        0.10 + (station_id % 35) / 100.0 AS soil_moisture, 15 + station_id % 76 AS area_km2,
        CAST((station_id * 13) % 1500 AS DOUBLE) AS elev_m
        FROM (SELECT DISTINCT user_id AS station_id FROM events)""",
    "watershed": """SELECT n_nationkey AS watershed_id, n_name AS name, n_regionkey AS region_id,
        100.0 + n_nationkey * 40 AS area_km2, 20.0 + n_nationkey * 3 AS threshold_cms FROM nation""",
    "flow": """SELECT o_orderkey AS flow_id, CAST(o_custkey % 25 AS INTEGER) AS river_id, o_custkey AS gauge_id,
        CAST(o_orderdate AS DATE) AS day, o_totalprice / 1000 AS discharge_cms FROM orders""",
    "daily_flow": """SELECT river_id, day, avg(discharge_cms) AS discharge_cms, count(*) AS n
        FROM flow GROUP BY 1, 2""",
    "monthly": """SELECT CAST(l_suppkey % 25 AS INTEGER) AS watershed_id,
        CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
        sum(l_quantity) AS p_mm, sum(l_discount) * 100 AS et_mm, sum(l_tax) * 100 AS q_mm,
        avg(l_discount) * 4 + 0.1 AS theta
        FROM lineitem GROUP BY 1, 2""",
    "cell": """SELECT p_partkey AS cell_id, -11 + ((p_partkey * 37) % 1700) / 100.0 AS lat,
        95 + ((p_partkey * 61) % 4600) / 100.0 AS lon, p_retailprice / 100 AS value, p_size,
        p_brand, p_type FROM part""",
    "reservoir": """SELECT s_suppkey AS reservoir_id, s_name AS name, CAST(s_suppkey % 25 AS INTEGER) AS river_id,
        1e6 * (10 + s_suppkey) AS capacity_m3, 5e4 * (10 + s_suppkey) AS dead_m3,
        100.0 AS fsl_m, 104.0 AS mwl_m, 400.0 AS max_release_cms, 60.0 AS normal_release_cms,
        s_nationkey AS nation_id FROM supplier""",
    "err": """SELECT event_id, ts, user_id AS entity_id, event_type AS model_id,
        CASE WHEN event_id % 5 = 0 THEN 'challenger' ELSE 'champion' END AS role,
        CAST(user_id % 5 AS INTEGER) AS region_id, value AS error FROM events""",
    "calib": """SELECT event_id, event_type AS model_id, value AS y_true,
        value + (CAST(json_extract_string(props, '$.k') AS INTEGER) - 50) * 0.8 AS y_pred,
        value + (CAST(json_extract_string(props, '$.k') AS INTEGER) - 50) * 0.8 - 25 AS q_lo,
        value + (CAST(json_extract_string(props, '$.k') AS INTEGER) - 50) * 0.8 + 25 AS q_hi
        FROM events""",
    "feature": """SELECT vec_id, label, label < 5 AS is_ref, CAST(idx AS INTEGER) AS idx,
        CAST(embedding[idx + 1] AS DOUBLE) AS x
        FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS idx)""",
    "alert": """SELECT event_id AS alert_id, event_type AS alert_type, user_id AS entity_id,
        CAST(user_id % 25 AS INTEGER) AS province_id, ts AS issued_at, value,
        CASE WHEN value >= 150 THEN 'critical' WHEN value >= 100 THEN 'high'
             WHEN value >= 50 THEN 'medium' ELSE 'low' END AS severity,
        event_id % 3 <> 0 AS is_active FROM events""",
}


def half_hour_slot(ts: Column) -> Column:
    """Start of the 30-minute slot of ``ts``."""
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / 1800) * 1800)


class Views:
    """Lazy stand-in tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @property
    def obs(self) -> DataFrame:
        return self.events.select(
            "event_id", F.col("user_id").alias("station_id"), "ts", F.col("event_type").alias("variable"),
            "value", (F.col("value") / 5).alias("precip_mm"),
            F.get_json_object("props", "$.k").cast("int").alias("aux"))

    @property
    def half_hour(self) -> DataFrame:
        return (self.obs.groupBy("station_id", half_hour_slot(F.col("ts")).alias("slot"))
                .agg(F.sum("precip_mm").alias("precip_mm")))

    @property
    def hourly(self) -> DataFrame:
        return (self.obs.groupBy("station_id", F.date_trunc("hour", "ts").alias("ts"))
                .agg(F.sum("precip_mm").alias("precip_mm"), F.avg("value").alias("temp_c"),
                     F.max("aux").alias("humidity")))

    @property
    def daily(self) -> DataFrame:
        return (self.obs.groupBy("station_id", F.to_date("ts").alias("day"))
                .agg(F.sum("precip_mm").alias("precip_mm"), F.avg("value").alias("temp_c"),
                     F.count("*").alias("n_obs"), F.sum("aux").alias("aux_sum")))

    @property
    def daily_met(self) -> DataFrame:
        a, s = F.col("aux_sum"), F.col("station_id")
        return self.daily.select(
            "station_id", "day", (26 + a % 10).alias("tmax_c"), (18 + a % 7).alias("tmin_c"),
            (55 + a % 40).alias("rh_pct"), (0.5 + (F.col("n_obs") % 5) * 0.7).alias("wind_u2_ms"),
            (2 + a % 9).alias("sunshine_hr"), (-11 + ((s * 37) % 1700) / 100.0).alias("lat_deg"),
            ((s * 13) % 1500).cast("double").alias("elev_m"), "precip_mm")

    @property
    def station(self) -> DataFrame:
        s = F.col("station_id")
        return (self.table("events").select(F.col("user_id").alias("station_id")).distinct().select(
            "station_id", (-11 + ((s * 37) % 1700) / 100.0).alias("lat"),
            (95 + ((s * 61) % 4600) / 100.0).alias("lon"), (s % 25).cast("int").alias("nation_id"),
            (5 + s % 26).alias("slope_deg"), (0.38 + (s % 13) / 100.0).alias("porosity"),
            (0.10 + (s % 35) / 100.0).alias("soil_moisture"), (15 + s % 76).alias("area_km2"),
            ((s * 13) % 1500).cast("double").alias("elev_m")))

    @property
    def watershed(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            k.alias("watershed_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_id"),
            (100.0 + k * 40).alias("area_km2"), (20.0 + k * 3).alias("threshold_cms"))

    @property
    def region(self) -> DataFrame:
        return self.table("region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region"))

    @property
    def flow(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("flow_id"), (F.col("o_custkey") % 25).cast("int").alias("river_id"),
            F.col("o_custkey").alias("gauge_id"), F.to_date("o_orderdate").alias("day"),
            (F.col("o_totalprice") / 1000).alias("discharge_cms"))

    @property
    def daily_flow(self) -> DataFrame:
        return (self.flow.groupBy("river_id", "day")
                .agg(F.avg("discharge_cms").alias("discharge_cms"), F.count("*").alias("n")))

    @property
    def monthly(self) -> DataFrame:
        return (self.table("lineitem")
                .groupBy((F.col("l_suppkey") % 25).cast("int").alias("watershed_id"),
                         F.trunc(F.to_date("l_shipdate"), "month").alias("month"))
                .agg(F.sum("l_quantity").alias("p_mm"), (F.sum("l_discount") * 100).alias("et_mm"),
                     (F.sum("l_tax") * 100).alias("q_mm"), (F.avg("l_discount") * 4 + 0.1).alias("theta")))

    @property
    def cell(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            k.alias("cell_id"), (-11 + ((k * 37) % 1700) / 100.0).alias("lat"),
            (95 + ((k * 61) % 4600) / 100.0).alias("lon"), (F.col("p_retailprice") / 100).alias("value"),
            "p_size", "p_brand", "p_type")

    @property
    def reservoir(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("reservoir_id"), F.col("s_name").alias("name"), (k % 25).cast("int").alias("river_id"),
            (1e6 * (10 + k)).alias("capacity_m3"), (5e4 * (10 + k)).alias("dead_m3"),
            F.lit(100.0).alias("fsl_m"), F.lit(104.0).alias("mwl_m"), F.lit(400.0).alias("max_release_cms"),
            F.lit(60.0).alias("normal_release_cms"), F.col("s_nationkey").alias("nation_id"))

    @property
    def err(self) -> DataFrame:
        return self.events.select(
            "event_id", "ts", F.col("user_id").alias("entity_id"), F.col("event_type").alias("model_id"),
            F.when(F.col("event_id") % 5 == 0, "challenger").otherwise("champion").alias("role"),
            (F.col("user_id") % 5).cast("int").alias("region_id"), F.col("value").alias("error"))

    @property
    def calib(self) -> DataFrame:
        pred = F.col("value") + (F.get_json_object("props", "$.k").cast("int") - 50) * 0.8
        return self.events.select(
            "event_id", F.col("event_type").alias("model_id"), F.col("value").alias("y_true"),
            pred.alias("y_pred"), (pred - 25).alias("q_lo"), (pred + 25).alias("q_hi"))

    @property
    def feature(self) -> DataFrame:
        return (self.table("embeddings")
                .select("vec_id", "label", (F.col("label") < 5).alias("is_ref"),
                        F.posexplode("embedding").alias("idx", "x"))
                .withColumn("x", F.col("x").cast("double")))

    @property
    def alert(self) -> DataFrame:
        v = F.col("value")
        return self.events.select(
            F.col("event_id").alias("alert_id"), F.col("event_type").alias("alert_type"),
            F.col("user_id").alias("entity_id"), (F.col("user_id") % 25).cast("int").alias("province_id"),
            F.col("ts").alias("issued_at"), "value",
            F.when(v >= 150, "critical").when(v >= 100, "high").when(v >= 50, "medium")
            .otherwise("low").alias("severity"),
            (F.col("event_id") % 3 != 0).alias("is_active"))

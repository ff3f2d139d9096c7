"""Explicit schemas of the domain tables and feeds."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, getattr(T, t)(), not n.endswith("!")) if not n.endswith("!")
                         else T.StructField(n[:-1], getattr(T, t)(), False)
                         for n, t in (p.split() for p in text.split(","))])


STATION_OBS = _struct("station_id StringType, ts TimestampType, lat DoubleType, lon DoubleType, elev_m DoubleType,"
                      "temperature_c DoubleType, humidity_pct DoubleType, wind_speed_mps DoubleType,"
                      "rainfall_mm DoubleType, pressure_hpa DoubleType")
GAUGE_RAIN = _struct("station_id StringType, lat DoubleType, lon DoubleType, precip_mm_30min DoubleType, ts TimestampType")
GAUGE_FLOW = _struct("station_id StringType, river_id StringType, discharge_m3s DoubleType, water_level_m DoubleType,"
                     "ts TimestampType, source StringType")
GRID = _struct("ts TimestampType, lat_idx IntegerType, lon_idx IntegerType, lat DoubleType, lon DoubleType, value DoubleType")
# Relational tables: "!" marks columns that must have a value.
CLIMATE_OBSERVATIONS = _struct("station_id! StringType, observed_at! TimestampType, variable! StringType, value DoubleType,"
                               "quality IntegerType, source StringType")
CLIMATE_ALERTS = _struct("alert_id! StringType, alert_type! StringType, severity! StringType, affected_area StringType,"
                         "latitude DoubleType, longitude DoubleType, radius_km DoubleType, issued_at! TimestampType,"
                         "expires_at TimestampType, source_agent StringType, is_active BooleanType")
DEFORESTATION_EVENTS = _struct("event_id! StringType, detected_at! TimestampType, area_ha! DoubleType, lat DoubleType,"
                               "lon DoubleType, province StringType, district StringType, confidence DoubleType,"
                               "previous_cover StringType, current_cover StringType")
TABLES = {"climate_observations": (CLIMATE_OBSERVATIONS, ["station_id", "observed_at", "variable"]),
          "climate_alerts": (CLIMATE_ALERTS, ["alert_id"]), "deforestation_events": (DEFORESTATION_EVENTS, ["event_id"])}
DEFAULTS = {"quality": 0, "source": "station", "is_active": True, "source_agent": "unknown"}

"""Column expressions for evapotranspiration, irrigation, drought and soil moisture."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from raincourse.operators.rollup import classify, clip

# Crop coefficients (initial, mid, end) of the reference-ET method.
KC = {"rice": (1.05, 1.20, 0.90), "corn": (0.30, 1.20, 0.60), "sugarcane": (0.40, 1.25, 0.75),
      "cassava": (0.30, 1.05, 0.95), "oil_palm": (1.00, 1.00, 1.00)}
# Basal coefficients and stage lengths in days (ini, dev, mid, late).
STAGES = ["ini", "dev", "mid", "late"]
KCB = {"rice": (1.05, 1.10, 1.15, 0.90), "corn": (0.30, 0.75, 1.15, 0.55),
       "sugarcane": (0.40, 0.80, 1.20, 0.70), "soybean": (0.40, 0.80, 1.10, 0.50),
       "dryland_rice": (0.80, 1.00, 1.10, 0.80)}
STAGE_DAYS = {"rice": (30, 40, 60, 30), "corn": (25, 35, 45, 25), "sugarcane": (50, 70, 220, 60),
              "soybean": (20, 30, 45, 25), "dryland_rice": (25, 35, 55, 25)}
# Second calendar, stage ends in days since planting.
STAGE_ENDS = {"rice": (20, 50, 110, 140), "corn": (20, 40, 90, 120), "sugarcane": (35, 60, 190, 230),
              "soybean": (15, 30, 70, 90), "dryland_rice": (15, 35, 75, 100)}
# Drought classes by standardised index and the share of area affected.
DROUGHT_LIMITS = [(-0.5, "NORMAL"), (-1.0, "MILD_DROUGHT"), (-1.5, "MODERATE_DROUGHT"),
                  (-2.0, "SEVERE_DROUGHT")]
DROUGHT_LEVELS = ["NORMAL", "MILD_DROUGHT", "MODERATE_DROUGHT", "SEVERE_DROUGHT", "EXTREME_DROUGHT"]
DROUGHT_AREA_SHARE = [0.0, 0.15, 0.35, 0.60, 0.85]
DEFICIT_LEVELS = ["NORMAL", "WATCH", "WARNING", "EMERGENCY"]
# Soil moisture normals by month.
MOISTURE_MEAN = [0.35, 0.34, 0.33, 0.30, 0.27, 0.24, 0.21, 0.20, 0.22, 0.26, 0.30, 0.34]
MOISTURE_STD = [0.06, 0.06, 0.07, 0.07, 0.07, 0.08, 0.08, 0.08, 0.07, 0.07, 0.06, 0.06]
ADVISORY_LEVELS = ["FAVORABLE", "CAUTION", "DEFICIT", "CRITICAL"]


def by_month(values: list[float], month: Column) -> Column:
    """Value of a 12-entry table for a month number."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), month.cast("int"))


def saturation_kpa(t: Column) -> Column:
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def _aero_terms(tmax: Column, tmin: Column, rh: Column, elev_m: Column):
    mean = (tmax + tmin) / 2
    gamma = 0.000665 * 101.3 * F.pow((293.0 - 0.0065 * elev_m) / 293.0, 5.26)
    delta = 4098.0 * saturation_kpa(mean) / F.pow(mean + 237.3, 2)
    es = 0.5 * (saturation_kpa(tmax) + saturation_kpa(tmin))
    ea = es * rh / 100.0
    heat = 4.903e-9 * 0.5 * (F.pow(tmax + 273.16, 4) + F.pow(tmin + 273.16, 4))
    return mean, gamma, delta, es, ea, heat


def penman_monteith(tmax: Column, tmin: Column, rh: Column, wind: Column, sun_hr: Column,
                    lat_deg: Column, elev_m: Column, doy: Column) -> dict[str, Column]:
    """Daily reference ET with radiation estimated from sunshine hours."""
    mean, gamma, delta, es, ea, heat = _aero_terms(tmax, tmin, rh, elev_m)
    deficit = F.greatest(es - ea, F.lit(0.0))
    lat = F.radians(lat_deg)
    season = 2 * math.pi * doy / 365.0
    decl = 0.409 * F.sin(season - 1.39)
    sunset = F.acos(-F.tan(lat) * F.tan(decl))
    ra = F.greatest(24.0 * 60.0 / math.pi * 0.082 * (1 + 0.033 * F.cos(season)) * (
        sunset * F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.sin(sunset)), F.lit(0.0))
    daylight = F.greatest(24.0 / math.pi * sunset, F.lit(0.01))
    rs = F.greatest((0.25 + 0.50 * sun_hr / daylight) * ra, F.lit(0.0))
    clear = F.greatest((0.75 + 2e-5 * elev_m) * ra, F.lit(0.01))
    cloud = clip(1.35 * rs / clear - 0.35, 0.05, 1.0)
    rn = 0.77 * rs - heat * (0.34 - 0.14 * F.sqrt(ea)) * cloud
    top = 0.408 * delta * rn + gamma * 900.0 / (mean + 273.0) * wind * deficit
    bottom = F.greatest(delta + gamma * (1 + 0.34 * wind), F.lit(1e-6))
    return {"et0_mm": F.greatest(top / bottom, F.lit(0.0)), "rs": rs, "rn": rn, "gamma": gamma,
            "delta": delta, "deficit_kpa": deficit}


def penman_monteith_measured(tmax: Column, tmin: Column, solar_mj: Column, rh: Column, wind: Column,
                             elev_m: Column) -> Column:
    """Daily reference ET from measured solar radiation."""
    mean, gamma, delta, es, ea, heat = _aero_terms(tmax, tmin, rh, elev_m)
    cloud = 1.35 * F.least(solar_mj / 18.0, F.lit(1.0)) - 0.35
    rn = 0.77 * solar_mj - heat * (0.34 - 0.14 * F.sqrt(ea)) * cloud
    top = 0.408 * delta * rn + gamma * 900.0 / (mean + 273.0) * wind * (es - ea)
    return F.greatest(top / (delta + gamma * (1 + 0.34 * wind)), F.lit(0.0))


def table_value(table: dict[str, tuple], key: Column, position: Column, default: str | None = None) -> Column:
    """Entry ``position`` (1-based) of the row ``key`` of a small fixed table."""
    chain = None
    for name, row in table.items():
        arr = F.element_at(F.array(*[F.lit(x) for x in row]), position.cast("int"))
        chain = F.when(key == name, arr) if chain is None else chain.when(key == name, arr)
    if default is None:
        return chain
    return chain.otherwise(F.element_at(F.array(*[F.lit(x) for x in table[default]]), position.cast("int")))


def growth_stage(crop: Column, days: Column) -> Column:
    """Stage from days since planting: running ends of the stage lengths, late afterwards."""
    ends = {c: tuple(sum(d[: i + 1]) for i in range(4)) for c, d in STAGE_DAYS.items()}
    end = [table_value(ends, crop, F.lit(i), "rice") for i in (1, 2, 3)]
    return (F.when(days <= end[0], "ini").when(days <= end[1], "dev")
            .when(days <= end[2], "mid").otherwise("late"))


def calendar_stage(crop: Column, days: Column) -> Column:
    """Stage by the second calendar; a new cycle starts after the last end."""
    end = [table_value(STAGE_ENDS, crop, F.lit(i), "rice") for i in (1, 2, 3, 4)]
    return (F.when(days < end[0], "initial").when(days < end[1], "development")
            .when(days < end[2], "mid_season").when(days < end[3], "late").otherwise("initial"))


def net_irrigation(kcb: Column, et0: Column, theta: Column, rain_mm: Column,
                   field_capacity: float = 0.30) -> dict[str, Column]:
    """Daily need: crop ET less effective rain less storage, with the recommendation."""
    fraction = theta / field_capacity
    ks = F.least(fraction, F.lit(1.0))
    ke = F.least(0.15 * (rain_mm / F.greatest(rain_mm + 5.0, F.lit(1.0))), F.lit(0.20))
    etc = (kcb * ks + ke) * et0
    effective = F.when(rain_mm > 5, rain_mm * 0.75).otherwise(0.0)
    storage = (theta - field_capacity * 0.85) * 250.0 * 0.10
    need = F.greatest(etc - effective - storage, F.lit(0.0))
    advice = (F.when(fraction > 1.0, "FIELD_SATURATED").when(need <= 0, "NO_IRRIGATION")
              .when(need <= 10, "IRRIGATE_SOON").otherwise("IRRIGATE_NOW"))
    return {"etc_mm": etc, "need_mm": need, "effective_rain_mm": effective, "ks": ks, "ke": ke,
            "stress": fraction < 0.50, "recommendation": advice,
            "application_mm": F.when(need > 0, F.round(need * 1.15, 2)).otherwise(0.0)}


def district_level(need_mm: Column) -> Column:
    return (F.when(need_mm > 10, "CRITICAL_DEFICIT").when(need_mm > 3, "MODERATE_DEFICIT")
            .when(need_mm > 0, "ADEQUATE").otherwise("SURPLUS"))


def spi_proxy(observed: Column, normal: Column) -> Column:
    return (observed - normal) / F.greatest(normal * 0.25, F.lit(1.0))


def spei_proxy(observed: Column, normal: Column, pet: Column) -> Column:
    return (observed - normal) / F.greatest(F.abs(normal - pet) * 0.30, F.lit(1.0))


def drought_class(index: Column) -> Column:
    return classify(index, DROUGHT_LIMITS, "EXTREME_DROUGHT")


def water_deficit_pct(theta: Column, field_capacity: Column, wilting: Column) -> Column:
    span = field_capacity - wilting
    return (F.when(span <= 0, 0.0)
            .otherwise(clip((field_capacity - theta) / F.nullif(span, F.lit(0.0)) * 100, 0, 100)))


def deficit_class(pct: Column) -> Column:
    return classify(pct, [(60.0, "EMERGENCY"), (40.0, "WARNING"), (20.0, "WATCH")], "NORMAL")


def relative_wetness(theta: Column, wilting: Column, field_capacity: Column) -> Column:
    span = field_capacity - wilting
    return (F.when(span <= 0, 0.5)
            .otherwise(clip((theta - wilting) / F.nullif(span, F.lit(0.0)), 0, 1)))


def moisture_anomaly(theta: Column, month: Column) -> Column:
    return (theta - by_month(MOISTURE_MEAN, month)) / by_month(MOISTURE_STD, month)


def moisture_risk(sigma: Column) -> Column:
    """Risk 0-4 from the anomaly in sigma, -1 without data."""
    return (F.when(sigma.isNull(), -1).when(sigma < -1.64, 4).when(sigma < -1.28, 3)
            .when(sigma < -0.84, 2).when(sigma < -0.52, 1).otherwise(0))


def seasonal_advisory(ratio: Column) -> Column:
    """Share of normal rain: the stated intent is that a low share is critical."""
    return (F.when(ratio < 0.55, "CRITICAL").when(ratio < 0.75, "DEFICIT")
            .when(ratio < 0.90, "CAUTION").otherwise("FAVORABLE"))


def harmonic_value(c0: Column, a1: Column, b1: Column, a2: Column, b2: Column, month: Column) -> Column:
    year, half = 2 * math.pi * month / 12, 2 * math.pi * month / 6
    return c0 + a1 * F.cos(year) + b1 * F.sin(year) + a2 * F.cos(half) + b2 * F.sin(half)

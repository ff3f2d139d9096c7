"""Column expressions for flash floods, river forecasts, stage and inundation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from raincourse.operators.rollup import classify, clip

# Warning limits as published for the indicators.
FLASH_LEVELS = ["CLEAR", "WATCH", "WARNING", "EMERGENCY"]
FLASH_LIMITS = [(1.00, "EMERGENCY"), (0.70, "WARNING"), (0.50, "WATCH"), (0.00, "CLEAR")]
RIVER_LEVELS = ["GREEN", "YELLOW", "ORANGE", "RED"]
RIVER_LIMITS = [(1.00, "RED"), (0.90, "ORANGE"), (0.70, "YELLOW"), (0.00, "GREEN")]
PERSISTENCE_EXPONENT = 0.45


def guidance_3h_mm(soil_moisture: Column, porosity: Column, slope_deg: Column,
                   soil_depth_mm: float = 250.0, wilting_point: float = 0.10) -> Column:
    """Rain in 3 hours that the soil can still take (floor 5 mm; 5 mm when nearly saturated)."""
    terrain = F.when(slope_deg > 15, 0.55).when(slope_deg > 5, 0.80).otherwise(1.0)
    free = 1 - F.least(soil_moisture / porosity, F.lit(1.0))
    room = soil_depth_mm * (porosity - wilting_point) * free * terrain * 0.30
    return (F.when(soil_moisture > 0.85 * porosity, F.lit(5.0))
            .otherwise(F.greatest(F.round(F.round(room, 9), 2), F.lit(5.0))))


def flash_index(rain_3h_mm: Column, guidance_mm: Column) -> Column:
    return F.when(guidance_mm <= 0, 9.99).otherwise(F.round(rain_3h_mm / guidance_mm, 4))


def flash_level(index: Column) -> Column:
    return classify(index, FLASH_LIMITS, "CLEAR")


def onset_minutes(area_km2: Column, slope_deg: Column, index: Column) -> Column:
    """Minutes to onset: concentration time shortened as the index passes 0.7, at least 10."""
    slope = F.radians(F.greatest(slope_deg, F.lit(1.0)))
    concentration = F.greatest(F.floor(20.0 * F.pow(area_km2, 0.35) / F.sqrt(F.tan(slope))), F.lit(10))
    share = F.greatest(1.0 - F.greatest(index - 0.7, F.lit(0.0)) * 2.0, F.lit(0.15))
    return F.greatest(F.floor(concentration * share), F.lit(10)).cast("int")


def river_level(peak_cms: Column, threshold_cms: Column) -> Column:
    return classify(peak_cms / F.greatest(threshold_cms, F.lit(0.01)), RIVER_LIMITS, "GREEN")


def rational_discharge(rain_mm: Column, theta: Column, area_km2: Column, base_cms: Column) -> Column:
    """Current discharge by the rational method, at least half of base flow."""
    c = F.least(0.3 + theta / 0.4 * 0.4, F.lit(0.9))
    return F.greatest(c * (rain_mm / 0.5) * area_km2 * 100.0 / 360.0, base_cms * 0.5)


def persistence_forecast(current: Column, rain_mm: Column, theta: Column, area_km2: Column,
                         base: Column, tc_hr: Column, lead_hr: Column) -> Column:
    """Rise within the concentration time, half-life decay to base flow after it."""
    c = F.least(0.3 + theta / 0.4 * 0.45, F.lit(0.9))
    peak = c * (rain_mm * 2.0 / lead_hr) * area_km2 * 100.0 / 360.0
    rising = current + lead_hr / tc_hr * F.greatest(peak - current, F.lit(0.0))
    falling = base + (current - base) * F.pow(F.lit(0.5), (lead_hr - tc_hr) / tc_hr)
    flow = F.when(lead_hr <= tc_hr, rising).otherwise(falling)
    scaled = flow * F.pow(F.greatest(flow, F.lit(0.01)) / F.greatest(base, F.lit(0.01)), PERSISTENCE_EXPONENT)
    return F.greatest(F.round(scaled, 2), base * 0.1)


def forecast_confidence(rain_mm: Column, theta: Column, horizon_hr: Column) -> Column:
    base = (F.greatest(90.0 - horizon_hr * 1.1, F.lit(50.0))
            - F.when(rain_mm > 20, 10.0).otherwise(0.0) - F.when(theta > 0.35, 5.0).otherwise(0.0))
    return clip(base, 40.0, 95.0)


def rating_stage(q: Column, a: Column, b: Column) -> Column:
    """Stage from discharge by the power-law rating curve a*Q^b."""
    return a * F.pow(F.greatest(q, F.lit(0.01)), b)


def recession_forecast(current: Column, rain_6h: Column, theta: Column, bankfull: Column) -> dict[str, Column]:
    """Discharge after 6, 12 and 24 hours: decayed present flow plus a rain term."""
    wet = 1.0 + F.greatest((theta - 0.25) / 0.15, F.lit(0.0))
    rain = rain_6h * wet * bankfull / 180.0
    return {"q_6h": current * 0.92 + rain,
            "q_12h": current * 0.82 + rain * 0.65,
            "q_24h": current * 0.68 + rain * 0.65 * 0.50}


def bankfull_stage_cm(q: Column, bankfull: Column, lowest_alert_cm: Column) -> Column:
    """Stage scaled so that bankfull discharge meets the lowest alert stage (at least 100 cm)."""
    return F.greatest(lowest_alert_cm / F.pow(bankfull, 0.45) * F.pow(F.greatest(q, F.lit(0.1)), 0.45),
                      F.lit(100.0))


def gauge_stage_cm(q: Column) -> Column:
    """Calibrated gauge: 82.4*Q^0.43, 400 cm at no flow."""
    return F.when(q <= 0, 400.0).otherwise(82.4 * F.pow(q, 0.43))


def siaga(stage_cm: Column, third: Column, second: Column, first: Column) -> Column:
    return (F.when(stage_cm >= first, "siaga1").when(stage_cm >= second, "siaga2")
            .when(stage_cm >= third, "siaga3").otherwise("none"))


def gev_exceedance(stage: Column, shape: Column, location: Column, scale: Column) -> Column:
    """Annual exceedance probability of a generalised extreme value law (shape xi)."""
    t = 1 + shape * (stage - location) / scale
    cdf = (F.when(shape == 0, F.exp(-F.exp(-(stage - location) / scale)))
           .when(t <= 0, F.when(shape > 0, 0.0).otherwise(1.0))
           .otherwise(F.exp(-F.pow(F.greatest(t, F.lit(1e-12)), -1 / F.nullif(shape, F.lit(0.0))))))
    return clip(1 - cdf, 0.0, 1.0)


def manning_depth(q: Column, width: Column, slope: Column, n: Column) -> Column:
    """Normal depth of a wide rectangular channel."""
    return (F.when((q <= 0) | (slope <= 0), 0.0)
            .otherwise(F.pow(q * n / (width * F.sqrt(slope)), 0.6)))


def inundation(q: Column, width: Column, floodplain: Column, bank_m: Column, slope: Column,
               n_channel: Column, n_plain: Column) -> dict[str, Column]:
    """Depth, width, length (km) and area (km2) of the wet reach for a discharge."""
    depth = manning_depth(q, width, slope, n_channel)
    over = depth > bank_m
    plain = F.greatest(depth - bank_m, manning_depth(q * 0.3, floodplain, slope, n_plain))
    total = F.round(width + F.least(plain / bank_m * floodplain, floodplain), 1)
    wet_width = F.when(over, total).otherwise(width * 1.2)
    length = F.when(over, F.greatest(total * 3.0 / 1000.0, F.lit(5.0))).otherwise(10.0)
    return {"depth_m": F.round(depth, 2), "overbank": over,
            "plain_depth_m": F.when(over, F.round(plain, 2)).otherwise(0.0),
            "flood_width_m": wet_width, "flood_length_km": length,
            "area_km2": wet_width * length * 1000 / 1e6}


def analytical_inundation(stage: Column, bankfull: Column, channel_m: Column, valley_m: Column,
                          length_km: Column) -> dict[str, Column]:
    """Area growing linearly with stage above bankfull, and mean depth."""
    excess = F.greatest(stage - bankfull, F.lit(0.0))
    width = F.when(excess > 0, F.least(channel_m + excess / bankfull * valley_m, valley_m)).otherwise(channel_m)
    return {"area_km2": F.round(width / 1000.0 * length_km, 3), "mean_depth_m": F.round(excess * 0.4, 3)}


def curve_number(cn2: Column, soil_water_mm: Column) -> Column:
    """Curve number moved to the dry or wet moisture class, kept within 30-99."""
    ratio = clip(soil_water_mm / 300.0, 0.0, 1.0)
    cn = (F.when(ratio < 0.35, 4.2 * cn2 / (10 - 0.058 * cn2))
          .when(ratio > 0.70, 23 * cn2 / (10 + 0.13 * cn2)).otherwise(cn2))
    return clip(cn, 30.0, 99.0)


def curve_number_runoff(rain_mm: Column, cn: Column) -> Column:
    s = 25400.0 / cn - 254.0
    return F.when(rain_mm <= 0.2 * s, 0.0).otherwise(
        F.pow(rain_mm - 0.2 * s, 2) / (rain_mm + 0.8 * s))

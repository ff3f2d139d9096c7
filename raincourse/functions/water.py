"""Column expressions for reservoirs, balances, water quality, coast and groundwater."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from raincourse.operators.rollup import classify, clip

# Reservoir zones as shares of active capacity, and gate states.
MINIMUM_LEVEL, TARGET_LEVEL, FULL_LEVEL, SPILL_LEVEL = 0.05, 0.60, 0.90, 1.00
GATE_STATES = ["NORMAL", "ALERT", "EMERGENCY"]
BALANCE_LIMIT = 0.15
# Water quality limits and categories.
TURBIDITY_LOW, TURBIDITY_MID, TURBIDITY_HIGH = 10.0, 50.0, 200.0
CHLA_LOW, CHLA_MID, CHLA_HIGH = 2.0, 10.0, 50.0
QUALITY_LIMITS = [(90.0, "excellent"), (70.0, "good"), (50.0, "fair"), (25.0, "poor")]
QUALITY_LEVELS = ["excellent", "good", "fair", "poor", "very_poor"]
# Salt intrusion categories and sea level rise in m/yr.
INTRUSION_LIMITS = [(1.20, "CRITICAL"), (0.70, "HIGH"), (0.30, "MODERATE"), (0.00, "SAFE")]
COAST_LEVELS = ["LOW", "MODERATE", "HIGH", "EXTREME"]
SEA_RISE_M_YR = 0.003
GROUNDWATER_LEVELS = ["NORMAL", "WATCH", "WARNING", "CRITICAL", "EMERGENCY"]


def next_storage(storage: Column, inflow: Column, outflow: Column, capacity: Column, dead: Column,
                 hours: float) -> Column:
    """Storage after one step, kept between dead storage and capacity plus dead storage."""
    moved = storage + (inflow - outflow) * hours * 3600.0
    return F.greatest(F.least(moved, capacity + dead), dead)


def gate_state(fraction: Column) -> Column:
    return classify(fraction, [(SPILL_LEVEL, "EMERGENCY"), (FULL_LEVEL, "ALERT")], "NORMAL")


def reservoir_level_m(fraction: Column, full_m: Column, max_m: Column) -> Column:
    return F.least(full_m - 10 + fraction / FULL_LEVEL * 10, max_m)


def gate_release(fraction: Column, capacity: Column, normal: Column, largest: Column) -> Column:
    """Rule curve: half, scaled, pre-release of 10 % in 6 hours, then everything."""
    scaled = normal * (1 + (fraction - TARGET_LEVEL) / (FULL_LEVEL - TARGET_LEVEL))
    rule = (F.when(fraction < TARGET_LEVEL, normal * 0.5).when(fraction < FULL_LEVEL, scaled)
            .when(fraction < SPILL_LEVEL, normal + capacity * 0.10 / 21600.0).otherwise(largest))
    return F.least(rule, largest)


def release_alert(fraction: Column) -> Column:
    return classify(fraction, [(SPILL_LEVEL, "MWL_BREACH"), (FULL_LEVEL, "FSL_EXCEEDED")], "NONE")


def release_impact(release: Column, largest: Column) -> Column:
    return classify(release / F.greatest(largest, F.lit(1.0)),
                    [(0.80, "CRITICAL"), (0.60, "HIGH"), (0.35, "MODERATE")], "LOW")


def balance_fraction(residual: Column, p: Column) -> Column:
    return F.when(p > 0, F.abs(residual / F.nullif(p, F.lit(0.0)))).otherwise(0.0)


def closure_error_pct(computed: Column, observed: Column) -> Column:
    return (F.when(observed != 0, F.abs(computed - observed) / F.abs(F.nullif(observed, F.lit(0.0))) * 100)
            .when(F.abs(computed) < 1, 0.0).otherwise(100.0))


def discharge_mm_month(q: Column, days: Column, area_km2: Column) -> Column:
    """Monthly depth from m3/s, with the factor the indicator states (q*86400*days/area)."""
    return F.round(q * 86400 * days * 1e3 / (area_km2 * 1e6) * 1e3, 2)


def turbidity_ntu(red: Column, nir: Column) -> Column:
    """Natural log inside a power of ten, as the indicator is defined."""
    ratio = F.greatest(red / F.greatest(nir, F.lit(1e-6)), F.lit(0.01))
    return F.pow(F.lit(10.0), 1.1317 * F.ln(ratio) + 1.0848)


def chlorophyll_ug_l(r443: Column, r555: Column) -> Column:
    ratio = F.greatest(r443 / F.greatest(r555, F.lit(1e-6)), F.lit(0.01))
    return F.greatest(F.pow(F.lit(10.0), 0.2424 - 2.7423 * F.log10(ratio)), F.lit(0.0))


def cdom(r412: Column, r555: Column) -> Column:
    return r412 / F.greatest(r555, F.lit(1e-6))


def turbidity_score(n: Column) -> Column:
    lo, mid, hi = TURBIDITY_LOW, TURBIDITY_MID, TURBIDITY_HIGH
    return (F.when(n < lo, 100.0).when(n < mid, 100 - (n - lo) / (mid - lo) * 50)
            .when(n < hi, 50 - (n - mid) / (hi - mid) * 25)
            .otherwise(F.greatest(25 - (n - hi) / 200 * 25, F.lit(0.0))))


def chlorophyll_score(c: Column) -> Column:
    lo, mid, hi = CHLA_LOW, CHLA_MID, CHLA_HIGH
    return (F.when(c < lo, 100.0).when(c < mid, 100 - (c - lo) / (mid - lo) * 40)
            .when(c < hi, 60 - (c - mid) / (hi - mid) * 35)
            .otherwise(F.greatest(25 - (c - hi) / 100 * 25, F.lit(0.0))))


def cdom_score(v: Column) -> Column:
    return F.when(v > 1, F.greatest(100 - (v - 1) * 50, F.lit(0.0))).otherwise(100.0)


def temperature_score(d: Column) -> Column:
    return (F.when(d < 1, 100.0).when(d < 2, 100 - (d - 1) * 40).when(d < 4, 60 - (d - 2) * 20)
            .otherwise(F.greatest(20 - (d - 4) * 5, F.lit(0.0))))


def quality_index(turbidity: Column, chla: Column, dissolved: Column, temp_anomaly: Column) -> Column:
    return (turbidity_score(turbidity) * 0.40 + chlorophyll_score(chla) * 0.35
            + cdom_score(dissolved) * 0.15 + temperature_score(F.abs(temp_anomaly)) * 0.10)


def quality_category(index: Column) -> Column:
    return classify(index, QUALITY_LIMITS, "very_poor")


def trophic_state(chla: Column) -> Column:
    return (F.when(chla < CHLA_LOW, "OLIGOTROPHIC").when(chla < CHLA_MID, "MESOTROPHIC")
            .when(chla < CHLA_HIGH, "EUTROPHIC").otherwise("HYPEREUTROPHIC"))


def bloom_probability(chla: Column) -> Column:
    return F.least(F.pow(chla / CHLA_HIGH, 0.8), F.lit(1.0))


def intrusion(prism_m3: Column, efficiency: Column, tide_m: Column, river_cms: Column,
              subsidence_mm: Column, wells: Column) -> dict[str, Column]:
    """Salt intrusion index, salinity, reach and wells affected."""
    tidal = prism_m3 * efficiency * tide_m / 21600.0
    rise = (subsidence_mm / 1000.0 + SEA_RISE_M_YR) * tide_m
    index = F.round(tidal / F.greatest(river_cms, F.lit(0.1)) * (1 + rise), 4)
    reach = F.round(5.0 * F.pow(index, 0.6), 2)
    return {"sii": index, "category": classify(index, INTRUSION_LIMITS, "SAFE"),
            "salinity_ppt": F.round(35.0 * index / (1 + index), 2), "reach_km": reach,
            "wells_affected": F.floor(wells * F.least(reach / 20.0, F.lit(1.0))).cast("long")}


def backwater_km(n: Column, tide_m: Column, slope: Column, q: Column) -> Column:
    return F.round(n * (tide_m / F.greatest(slope, F.lit(1e-6))) / F.sqrt(F.greatest(q, F.lit(1.0))), 2)


def coastal_risk(category: Column, backwater: Column, rise_mm_yr: Column) -> Column:
    score = (F.when(category == "CRITICAL", 3).when(category == "HIGH", 2).when(category == "MODERATE", 1)
             .otherwise(0)
             + F.when(backwater > 25, 2).when(backwater > 15, 1).otherwise(0)
             + F.when(rise_mm_yr > 25, 1).otherwise(0))
    return classify(score, [(5, "EXTREME"), (3, "HIGH"), (1, "MODERATE")], "LOW")


def gate_advice(category: Column, backwater: Column, flushing: Column) -> Column:
    """Gate action code; ``flushing`` marks cities with a freshwater release rule."""
    return (F.when(flushing, "FLUSH_AND_CLOSE").when(category == "CRITICAL", "CLOSE_ALL")
            .when((category == "HIGH") | (backwater > 15), "REDUCE_HALF").otherwise("NORMAL"))


def aquifer_severity(anomaly_cm: Column, trend: Column) -> Column:
    return (F.when((anomaly_cm < -5) & (trend < -2), "CRITICAL")
            .when((anomaly_cm < -3) | ((anomaly_cm < -2) & (trend < -1)), "WARNING")
            .when((anomaly_cm < -1) | (trend < -0.5), "WATCH").otherwise("NORMAL"))


def availability_index(rain_anomaly_pct: Column, theta: Column, groundwater_cm: Column,
                       reservoir_pct: Column) -> Column:
    """Water availability 0-100 from four clipped scores (weights .40 .25 .20 .15)."""
    return F.round(clip(50 + rain_anomaly_pct * 0.5, 0, 100) * 0.40
                   + clip(theta / 0.50 * 100, 0, 100) * 0.25
                   + clip(50 + groundwater_cm * 1.5, 0, 100) * 0.20
                   + clip(reservoir_pct, 0, 100) * 0.15, 1)


def availability_class(index: Column) -> Column:
    return classify(index, [(80.0, "abundant"), (60.0, "sufficient"), (40.0, "moderate"), (20.0, "scarce")],
                    "critical")


def planting_advice(index: Column, season: Column, irrigated: Column) -> Column:
    risky = (season == "MT-II") & ~irrigated
    return (F.when(risky & (index < 30), "switch_to_palawija").when(risky & (index < 50), "delay_4_weeks")
            .when(index >= 75, "proceed_on_schedule").when(index >= 55, "proceed_with_caution")
            .when(index >= 40, "delay_2_weeks").otherwise("suspend_rain_fed"))


def farm_class(index: Column, reservoir_pct: Column, theta: Column) -> Column:
    """Farm water class from a signed index, reservoir fill and soil moisture."""
    return (F.when((index < -1.5) | (reservoir_pct < 20) | (theta < 0.15), "CRITICAL")
            .when((index < -0.5) | (reservoir_pct < 40), "DEFICIT")
            .when(index > 0.5, "SURPLUS").otherwise("ADEQUATE"))


def wet_season(month: Column) -> Column:
    return month.isin(10, 11, 12, 1, 2, 3)


def calendar_flag(farm: Column, month: Column) -> Column:
    season = F.when(wet_season(month), "MT_I").otherwise("MT_II")
    return (F.when(farm == "CRITICAL", "HOLD").when(farm == "DEFICIT", F.concat(season, F.lit("_DELAY")))
            .otherwise(F.concat(season, F.lit("_PROCEED"))))


def fill_estimate_pct(index: Column, theta: Column) -> Column:
    return clip(55 + index * 15 + (theta - 0.28) * 80, 5, 100)


def groundwater_level(anomaly_cm: Column) -> Column:
    return classify(anomaly_cm, [(-35.0, "EMERGENCY"), (-20.0, "CRITICAL"), (-10.0, "WARNING"),
                                 (-5.0, "WATCH")], "NORMAL", "<=")


def storage_loss_level(change_mm: Column) -> Column:
    return classify(change_mm, [(-15.0, "EMERGENCY"), (-10.0, "WARNING"), (-5.0, "WATCH")], "NORMAL", "<=")

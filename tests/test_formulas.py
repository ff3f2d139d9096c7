"""Formulas on hand-computed rows: a normal one, one on a limit and one without data."""

import pytest
from pyspark.sql import functions as F

from raincourse.functions import climate, flood, series, spectral, water
from raincourse.operators.rollup import classify, latest_per_key, worst


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def val(one, column):
    return one.select(column.alias("v")).first().v


L = F.lit


def test_flash_flood(one):
    # 250*(0.45-0.10)*(1-0.2/0.45)*0.55*0.30 = 8.0208 -> 8.02
    assert val(one, flood.guidance_3h_mm(L(0.2), L(0.45), L(20))) == 8.02
    assert val(one, flood.guidance_3h_mm(L(0.40), L(0.45), L(20))) == 5.0
    assert [val(one, flood.flash_level(L(x))) for x in (0.49, 0.5, 0.7, 1.0)] == ["CLEAR", "WATCH", "WARNING", "EMERGENCY"]
    assert val(one, flood.flash_index(L(4.01), L(8.02))) == 0.5
    assert val(one, flood.onset_minutes(L(25.0), L(18.0), L(1.2))) == 16


def test_river(one):
    assert [val(one, flood.river_level(L(x), L(100.0))) for x in (69.0, 70.0, 90.0, 100.0)] == ["GREEN", "YELLOW", "ORANGE", "RED"]
    assert val(one, flood.gauge_stage_cm(L(0.0))) == 400.0
    assert val(one, flood.bankfull_stage_cm(L(250.0), L(250.0), L(750.0))) == pytest.approx(750.0)
    assert val(one, flood.manning_depth(L(100.0), L(50.0), L(0.0004), L(0.035))) == pytest.approx(3.5 ** 0.6)
    assert val(one, flood.gev_exceedance(L(810.0), L(-0.12), L(810.0), L(95.0))) == pytest.approx(0.632121, abs=1e-6)
    assert val(one, flood.gev_exceedance(L(5000.0), L(-0.12), L(810.0), L(95.0))) == 0.0


def test_curve_number(one):
    assert val(one, flood.curve_number(L(75.0), L(150.0))) == 75.0
    assert val(one, flood.curve_number(L(75.0), L(0.0))) == pytest.approx(4.2 * 75 / (10 - 0.058 * 75))
    assert val(one, flood.curve_number(L(99.0), L(300.0))) == 99.0
    assert val(one, flood.curve_number_runoff(L(5.0), L(75.0))) == 0.0


def test_reference_et(one):
    # worked example of the published method: Brussels, 6 July, 50 deg 48 min N, 100 m
    et = climate.penman_monteith(L(21.5), L(12.3), L(73.5), L(2.078), L(9.25), L(50.80), L(100.0), L(187))["et0_mm"]
    assert val(one, et) == pytest.approx(3.9, abs=0.15)


def test_irrigation(one):
    n = climate.net_irrigation(L(1.15), L(5.0), L(0.30), L(0.0))
    assert val(one, n["need_mm"]) == pytest.approx(1.15 * 5 - 0.045 * 25) and val(one, n["recommendation"]) == "IRRIGATE_SOON"
    assert val(one, climate.net_irrigation(L(1.15), L(5.0), L(0.31), L(0.0))["recommendation"]) == "FIELD_SATURATED"
    assert [val(one, climate.growth_stage(L("rice"), L(d))) for d in (30, 31, 70, 131, 900)] == ["ini", "dev", "dev", "late", "late"]
    assert val(one, climate.calendar_stage(L("corn"), L(120))) == "initial"


def test_drought(one):
    assert val(one, climate.spi_proxy(L(150.0), L(200.0))) == -1.0
    assert [val(one, climate.drought_class(L(x))) for x in (-0.5, -0.51, -1.5, -2.01)] == ["NORMAL", "MILD_DROUGHT", "MODERATE_DROUGHT", "EXTREME_DROUGHT"]
    assert val(one, climate.water_deficit_pct(L(0.25), L(0.36), L(0.14))) == pytest.approx(50.0)
    assert val(one, climate.water_deficit_pct(L(0.25), L(0.14), L(0.14))) == 0.0
    assert val(one, climate.moisture_risk(L(None).cast("double"))) == -1
    assert [val(one, climate.seasonal_advisory(L(x))) for x in (0.54, 0.55, 0.75, 0.90)] == ["CRITICAL", "DEFICIT", "CAUTION", "FAVORABLE"]


def test_reservoir(one):
    assert val(one, water.next_storage(L(1e6), L(0.0), L(1e6), L(1e6), L(5e4), 1.0)) == 5e4
    assert [val(one, water.gate_state(L(x))) for x in (0.89, 0.9, 1.0)] == ["NORMAL", "ALERT", "EMERGENCY"]
    assert val(one, water.gate_release(L(0.75), L(1e8), L(60.0), L(400.0))) == pytest.approx(90.0)
    assert val(one, water.gate_release(L(0.95), L(1e8), L(60.0), L(400.0))) == 400.0


def test_balance(one):
    assert val(one, water.balance_fraction(L(15.0), L(100.0))) == 0.15
    assert val(one, water.balance_fraction(L(15.0), L(0.0))) == 0.0
    assert [val(one, water.closure_error_pct(L(a), L(b))) for a, b in ((90.0, 100.0), (0.5, 0.0), (2.0, 0.0))] == [pytest.approx(10.0), 0.0, 100.0]


def test_water_quality(one):
    assert [val(one, water.turbidity_score(L(x))) for x in (9.9, 30.0, 200.0)] == [100.0, 75.0, 25.0]
    assert [val(one, water.quality_category(L(x))) for x in (90.0, 70.0, 49.9, 24.9)] == ["excellent", "good", "poor", "very_poor"]
    assert val(one, water.chlorophyll_ug_l(L(0.01), L(0.01))) == pytest.approx(10 ** 0.2424)


def test_coast_and_groundwater(one):
    i = water.intrusion(L(1e6), L(0.6), L(1.0), L(27.7777777778), L(17), L(5000))
    assert val(one, i["sii"]) == 1.02 and val(one, i["category"]) == "HIGH" and val(one, i["salinity_ppt"]) == 17.67
    assert val(one, water.coastal_risk(L("CRITICAL"), L(26.0), L(10.0))) == "EXTREME"
    assert [val(one, water.groundwater_level(L(x))) for x in (-4.9, -5.0, -20.0, -35.0)] == ["NORMAL", "WATCH", "CRITICAL", "EMERGENCY"]
    assert val(one, water.aquifer_severity(L(-2.5), L(-1.5))) == "WARNING"


def test_availability(one):
    assert val(one, water.availability_index(L(0.0), L(0.25), L(0.0), L(50.0))) == 50.0
    assert val(one, water.availability_class(L(20.0))) == "scarce"
    assert val(one, water.planting_advice(L(29.0), L("MT-II"), L(False))) == "switch_to_palawija"
    assert val(one, water.planting_advice(L(29.0), L("MT-II"), L(True))) == "suspend_rain_fed"


def test_regime_and_indices(one):
    assert val(one, series.regime(L(True), L(False), L(0.4))) == "SEVERE_DRY"
    assert val(one, series.regime(L(False), L(False), L(0.39))) == "NEUTRAL"
    assert [val(one, e) for e in series.regime_factors(L("unknown"))] == [1.0, 0.0]
    assert val(one, spectral.humidity_deficit(L(25.0), L(100.0))) == 0.0


def test_rollup_helpers(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "x")], "k int, t int, v string")
    assert sorted(tuple(r) for r in latest_per_key(df, ["k"], ["t"]).collect()) == [(1, 3, "c"), (2, 1, "x")]
    assert df.agg(worst(F.col("v"), ["x", "a", "b", "c"]).alias("w")).first().w == "c"
    assert df.select(classify(F.col("t"), [(3, "high"), (2, "mid")], "low").alias("c")).distinct().count() == 3

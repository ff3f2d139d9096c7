import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from raincourse.operators import learning as L
from raincourse.operators import ranking as K
from raincourse.operators import statistics as S


@pytest.fixture(scope="module")
def two(spark):
    rng = np.random.default_rng(1)
    data = [(int(i % 3), True, float(v)) for i, v in enumerate(rng.normal(0, 1, 600))]
    data += [(k, False, x) for k, _, x in data]
    return spark.createDataFrame(data, "k int, is_ref boolean, x double").cache()


def test_equal_samples_show_no_drift(two):
    ref = F.col("is_ref")
    for fn in (S.psi_quantile, S.psi_width, S.psi_distinct):
        assert all(abs(r.psi) < 1e-12 for r in fn(two, ["k"], "x", ref).collect())
    assert all(r.ks == 0 and r.p_value == 1 for r in S.ks_two_sample(two, ["k"], "x", ref).collect())


def test_js_is_symmetric_and_bounded(spark):
    df = spark.createDataFrame([(1, 10, 0), (1, 0, 10), (2, 5, 7), (2, 9, 2)], "k int, a long, b long")
    ab = {r.k: r.js for r in S.js_divergence(df, ["k"], "a", "b").collect()}
    ba = {r.k: r.js for r in S.js_divergence(df, ["k"], "b", "a").collect()}
    assert ab == pytest.approx(ba) and ab[1] == pytest.approx(math.log(2), abs=1e-6) and 0 < ab[2] < math.log(2)


def test_tails_against_published_tables(spark):
    # t: 2.228 (df 10), 2.042 (df 30); F(1, 10) = 4.965, F(1, 20) = 4.351; z = 1.645, 1.96
    t = spark.createDataFrame([(2.228, 10.0), (2.042, 30.0)], "t double, df double")
    assert [r.p for r in t.select(S.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect()] == pytest.approx([0.05, 0.05], abs=2e-4)
    f = spark.createDataFrame([(4.965, 10.0), (4.351, 20.0)], "f double, d double")
    assert [r.p for r in f.select(S.f_upper_tail(F.col("f"), F.lit(1.0), F.col("d")).alias("p")).collect()] == pytest.approx([0.05, 0.05], abs=2e-4)
    z = spark.createDataFrame([(1.6448536,), (-1.9599640,), (0.0,), (5.0,)], "z double")
    want = [0.05, 0.975, 0.5, 2.866516e-7]
    assert [r.p for r in z.select(S.normal_upper_tail(F.col("z")).alias("p")).collect()] == pytest.approx(want, abs=1e-7)
    k = spark.createDataFrame([(1.3581,)], "z double").select(S.kolmogorov_tail(F.col("z")).alias("p")).first().p
    assert k == pytest.approx(0.05, abs=1e-4)


def test_perfect_forecast(spark):
    df = spark.range(50).select((F.col("id") * 1.5 + 2).alias("o"))
    r = df.agg(*[e.alias(n) for n, e in S.skill(F.col("o"), F.col("o")).items()]).first()
    assert r.nse == pytest.approx(1) and r.kge == pytest.approx(1, abs=1e-6) and r.rmse == 0 and r.pbias == pytest.approx(0)


def test_rank_test_against_direct_count(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 12, 40), rng.integers(0, 10, 30)
    df = spark.createDataFrame([(1, True, float(x)) for x in a] + [(1, False, float(x)) for x in b], "k int, a boolean, x double")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert S.mann_whitney(df, ["k"], "x", F.col("a")).first().u == pytest.approx(u)


def test_weights_sum_to_one(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 4.0), ("c", 0.5)], "model_id string, e double")
    w = {r.model_id: r.weight for r in L.inverse_error_weights(df).collect()}
    assert sum(w.values()) == pytest.approx(1) and w["c"] > w["a"] > w["b"]


def test_split_conformal_level(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(1, 11)], "k int, s double")
    assert L.split_conformal(df, ["k"], "s", 0.80).first().split_conformal == 9.0  # ceil(11 * 0.8) = 9th
    assert L.split_conformal(df, ["k"], "s", 0.99).first().split_conformal == 10.0  # capped at the largest


def test_ensemble_bounds(spark):
    m = spark.createDataFrame([(1, 10.0, 1.0, 3.0), (1, 20.0, 1.0, 3.0), (1, None, 5.0, 3.0)], "k int, x double, w double, q double")
    r = L.ensemble(m, ["k"], F.col("x"), F.col("w")).first()
    assert (r["mean"], r["std"]) == (15.0, 5.0) and r.upper == pytest.approx(15 + 1.645 * 5)
    assert L.ensemble(m, ["k"], F.col("x"), F.col("w"), F.col("q")).first().lower == 12.0


def test_interval_scale(spark):
    df = spark.createDataFrame([(1, float(i), 0.0, 4.0) for i in range(10)] + [(2, 1.0, 0.0, 4.0)] * 10, "k int, y_true double, q_lo double, q_hi double")
    assert {r.k: r.scale for r in L.interval_scale(df, ["k"]).collect()} == pytest.approx({1: 1.8, 2: 0.9})
    assert {r.k: r.scale for r in L.interval_scale(df, ["k"], "platt").collect()} == pytest.approx({1: 1.8, 2: 0.9})


def test_quantiles_of_large_and_small_keys(spark):
    """A key of 120,000 rows with a value that holds a third of them, keys of a few rows, nulls."""
    rng = np.random.default_rng(4)
    big = np.concatenate([rng.normal(0, 1, 80_000), np.full(40_000, 0.25)])
    small = [[3.0], [1.0, 5.0], [2.0, 2.0, 9.0, 4.0]]
    data = [(0, float(x)) for x in big] + [(k + 1, x) for k, part in enumerate(small) for x in part] + [(0, None), (9, None)]
    frame = spark.createDataFrame(data, "k int, x double").repartition(8)
    probs = {"p0": 0.0, "p01": 0.001, "p10": 0.1, "p50": 0.5, "p60": 0.6, "p999": 0.999, "p1": 1.0}
    found = {r.k: tuple(r)[1:] for r in K.quantiles(frame, ["k"], "x", probs).collect()}
    want = {k: tuple(np.quantile(part, list(probs.values()))) for k, part in enumerate([big, *small])}
    assert set(found) == set(want)
    assert all(found[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    whole = K.quantiles(frame, [], "x", {"m": 0.5}).first().m
    assert whole == pytest.approx(np.quantile([x for _, x in data if x is not None], 0.5))
    assert K.quantiles(frame.where("false"), ["k"], "x", probs).count() == 0


def test_only_few_values_are_shuffled_for_quantiles(spark):
    frame = spark.range(400_000).select((F.col("id") % 2).alias("k"), F.rand(3).alias("x"))
    found = K.quantiles(frame, ["k"], "x", {"a": 0.1, "b": 0.9})
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_count") >= 1 and "rangepartitioning" not in plan


def test_beta_tail_on_both_sides(spark):
    # closed forms: I_x(1, b) = 1 - (1 - x)^b, I_x(a, 1) = x^a, I_x(2, 2) = 3x^2 - 2x^3
    data = [(x, a, b) for x in (0.01, 0.3, 0.5, 0.9, 0.999) for a, b in ((1.0, 3.5), (4.5, 1.0), (2.0, 2.0), (1.0, 400.0))]
    got = [r.p for r in spark.createDataFrame(data, "x double, a double, b double").select(S.beta_tail(F.col("x"), F.col("a"), F.col("b")).alias("p")).collect()]
    want = [1 - (1 - x) ** b if a == 1 else x ** a if b == 1 else 3 * x ** 2 - 2 * x ** 3 for x, a, b in data]
    assert got == pytest.approx(want, abs=1e-9)
    g = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.5, 60.0)], "x double").select(S.log_gamma(F.col("x")).alias("g")).collect()
    assert [r.g for r in g] == pytest.approx([math.lgamma(x) for x in (0.5, 1.0, 2.5, 60.0)], abs=1e-12)

"""The two classifiers against slow versions with dictionaries and plain loops."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raincourse.llm import language, quality
from raincourse.llm.bytes_hash import Hasher, slices


@pytest.fixture(scope="module")
def texts(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 3000").orderBy("doc_id").limit(50).collect()
    return [(r["doc_id"], r["text"], r["lang"]) for r in rows] + [(9001, "", None), (9002, "one", None), (9003, "a a b a a a !! !! 7", None)]


def slow_quality(text):
    """Roots of shares of each run of one to three tokens, a token that repeats one of the four before it by its distance."""
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x09-\x0d\x20]+", text.encode())
    seen = [next((back for back in range(1, 5) if back <= k and tokens[k - back] == t), t) for k, t in enumerate(tokens)]
    grams = Counter(tuple(seen[k:k + n]) for n in (1, 2, 3) for k in range(len(seen) - n + 1))
    return {g: math.sqrt(c / sum(grams.values())) for g, c in grams.items()}


def test_quality_features_are_those_of_a_dictionary(texts):
    for low, high, data, rows in slices(pa.array([t for _, t, _ in texts])):
        owner, bucket, value = quality.features(data, rows, Hasher())
        for k in range(low, high):
            want, found = slow_quality(texts[k][1]), value[owner == k - low]
            assert sum(v * v for v in found) == pytest.approx(1 if want else 0)
            # Two runs may share a bucket; then their shares are added.
            assert len(want) - 10 <= len(found) <= len(want)
            if len(found) == len(want):
                assert np.allclose(np.sort(found), sorted(want.values()))


def slow_ftrl(examples):
    z, n, size = Counter(), Counter(), len(examples)
    good = sum(y for *_, y in examples)
    weight = [size / 2 / (size - good), size / 2 / good]

    def w(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    order = np.random.default_rng(1)
    for _ in range(quality.PASSES):
        for k in order.permutation(size):
            at, x, y = examples[k]
            now = {i: w(i) for i in at}
            p = 1 / (1 + math.exp(-min(max(sum(now[i] * v for i, v in zip(at, x, strict=True)), -30), 30)))
            for i, v in zip(at, x, strict=True):
                g = weight[y] * (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * now[i]
                n[i] += g * g
    return {i: w(i) for i in z}


def test_quality_weights_and_scores_are_those_of_plain_loops(spark, texts):
    examples = []
    for low, high, data, rows in slices(pa.array([t for _, t, _ in texts])):
        owner, bucket, value = quality.features(data, rows, Hasher())
        examples += [(np.append(bucket[owner == k], 1 << quality.BITS), np.append(value[owner == k], 1.0), (k * 7) % 3 % 2) for k in range(high - low)]
    want, found = slow_ftrl([(a.tolist(), x.tolist(), y) for a, x, y in examples]), quality.train_ftrl(examples)
    assert np.allclose([found[i] for i in want], list(want.values()), atol=1e-9) and np.count_nonzero(found) <= len(want)
    scores = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(texts, "doc_id long, text string, lang string"), found).select("row.doc_id", "score").collect()}
    for (doc, _, _), (at, x, _) in zip(texts, examples, strict=True):
        assert scores[doc] == pytest.approx(1 / (1 + math.exp(-sum(want[i] * v for i, v in zip(at.tolist(), x.tolist(), strict=True)))), abs=1e-9)


def slow_trigrams(text):
    data = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in text.encode())
    grams = Counter(data[k:k + 3] for k in range(len(data) - 2))
    out = Counter()
    for g, c in grams.items():
        out[(int.from_bytes(g, "big") * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - language.BITS] += c
    return {b: math.sqrt(c / sum(grams.values())) for b, c in out.items()}


def test_language_features_are_those_of_a_dictionary(texts):
    for low, high, data, rows in slices(pa.array([t for _, t, _ in texts])):
        owner, bucket, value = language.features(data, rows)
        for k in range(low, high):
            mine = owner == k - low
            assert dict(zip(bucket[mine].tolist(), value[mine].tolist(), strict=True)) == pytest.approx(slow_trigrams(texts[k][1]))


def slow_svm(given, signs):
    examples, w, mean, draw = [slow_trigrams(t) for t in given], Counter(), Counter(), np.random.default_rng(1)
    sides = [np.array([k for k, s in enumerate(signs) if s == side]) for side in (1, -1)]
    for step in range(1, language.STEPS + 1):
        rate = 1 / (language.DECAY * (step + 10 / language.DECAY / 10))
        change = Counter()
        for k in np.concatenate([draw.choice(s, language.BATCH // 2) for s in sides]).tolist():
            if signs[k] * (sum(w[b] * v for b, v in examples[k].items()) + w["bias"]) < 1:
                for b, v in examples[k].items():
                    change[b] += signs[k] * v
                change["bias"] += signs[k]
        for b in set(w) | set(change):
            w[b] = w[b] * (1 - rate * language.DECAY) + rate / language.BATCH * change[b]
        if step > language.STEPS // 2:
            for b, v in w.items():
                mean[b] += v
    return {b: v / (language.STEPS - language.STEPS // 2) for b, v in mean.items()}


def test_language_machine_is_that_of_plain_loops(texts, monkeypatch):
    monkeypatch.setattr(language, "STEPS", 30)
    given = [t[:200] for _, t, lang in texts if lang in ("en", "fr")]
    signs = [1 if lang == "en" else -1 for _, _, lang in texts if lang in ("en", "fr")]
    assert {1, -1} == set(signs)
    found, want = language.train_svm(pa.chunked_array([pa.array(given)]), np.array(signs)), slow_svm(given, signs)
    assert found[-1] == pytest.approx(want.pop("bias"), abs=1e-9)
    assert np.allclose([found[b] for b in want], list(want.values()), atol=1e-9)


def test_language_prediction_is_the_vote_of_its_machines(spark, texts):
    frame = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language.fit(frame.where(F.col("lang").isNotNull()))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(frame, model).collect()}
    sure = lambda m: 1 / (1 + math.exp(-min(max(4 * m, -30), 30)))
    for doc, text, _ in texts:
        if not re.search(r"[^\W\d_]", text):
            assert found[doc] == ("und", 0.0)
            continue
        x = slow_trigrams(text)
        margin = lambda w: sum(w[b] * v for b, v in x.items()) + w[-1]  # noqa: B023, E731
        family = max(sorted(model["family"]), key=lambda f: margin(model["family"][f]))
        members, wins, sums = model["languages"][family], Counter(), Counter()
        for i, a in enumerate(members):
            for b in members[i + 1:]:
                m = margin(model["pair"][a, b])
                wins[a if m >= 0 else b] += 1
                sums[a] += sure(m)
                sums[b] += sure(-m)
        best = max(members, key=lambda a: wins[a] + sums[a] / (len(members) + 1))
        chance = sums[best] / (len(members) - 1) if len(members) > 1 else 1
        assert found[doc][0] == best and found[doc][1] == pytest.approx(sure(margin(model["family"][family])) * chance, abs=1e-6)

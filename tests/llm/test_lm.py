"""Language-model scores against plain counting and a word-by-word network."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raincourse.llm import lm, recurrent
from raincourse.llm.bytes_hash import slices
from raincourse.llm.queries import QUERIES
from raincourse.llm.recurrent import Shape
from tests.llm.test_operators import docs, none, rows, words_of  # noqa: F401

SMALL = Shape(hidden=4, listed=12, groups=3, tails=4)


def random_net(shape, seed=0):
    rng = np.random.default_rng(seed)
    counts = rng.integers(1, 50, shape.listed + shape.tails).astype(float)
    return recurrent.start_weights(shape, counts) + rng.normal(0, 0.3, shape.total).astype(np.float32)


def slow_score(shape, flat, symbols):
    """Word by word, in double precision."""
    w = {k: v.astype(float) for k, v in shape.views(flat).items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    h, last, total, n = np.zeros(shape.hidden), recurrent.END, 0.0, shape.hidden
    for s in symbols:
        x, a = w["read"][last], h @ w["turn"]
        z, r = sigmoid(x[:n] + a[:n]), sigmoid(x[n:2 * n] + a[n:2 * n])
        new = np.tanh(x[2 * n:] + r * a[2 * n:])
        h = (1 - z) * new + z * h
        share = np.exp(h @ w["classes"] + w["class_bias"])
        share /= share.sum()
        if s < shape.listed:
            g, k = divmod(s, shape.each)
            inner = np.exp(h @ w["words"][g] + w["word_bias"][g])
            total += math.log(share[g]) + math.log(inner[k] / inner.sum())
        else:
            total += math.log(share[shape.groups + s - shape.listed])
        last = s
    return total


@pytest.mark.parametrize("steps,lanes", [(1, 1), (7, 3), (64, 96)])
def test_scores_are_those_of_a_plain_network(steps, lanes):
    rng = np.random.default_rng(3)
    flat, counts = random_net(SMALL), np.array([1, 40, 3, 1, 17, 90, 2])
    symbols = rng.integers(1, SMALL.listed + SMALL.tails, counts.sum())
    symbols[np.cumsum(counts) - 1] = recurrent.END
    found = recurrent.document_scores(SMALL, flat, symbols, counts, steps, lanes)
    want = [slow_score(SMALL, flat, s.tolist()) for s in np.split(symbols, np.cumsum(counts)[:-1])]
    assert np.allclose(found, want, rtol=1e-4)


def test_all_next_symbols_add_up_to_one():
    flat = random_net(SMALL, 5)
    for start in ([], [3], [13, 2]):
        total = sum(math.exp(slow_score(SMALL, flat, [*start, s]) - slow_score(SMALL, flat, start)) for s in range(SMALL.listed + SMALL.tails))
        assert abs(total - 1) < 1e-6


def test_gradients_are_slopes():
    rng, flat = np.random.default_rng(1), random_net(SMALL, 2)
    counts = np.array([5, 4, 3])
    symbols = rng.integers(1, SMALL.listed + SMALL.tails, counts.sum())
    symbols[np.cumsum(counts) - 1] = recurrent.END
    trainer = recurrent.Trainer(SMALL, flat, 0.0, steps=12, lanes=2, clip=1e9)
    trainer._adam = lambda scale: None
    trainer.learn(symbols, counts)
    gradient = trainer.grad.copy()
    loss = lambda f: -sum(slow_score(SMALL, f, s.tolist()) for s in np.split(symbols, np.cumsum(counts)[:-1]))
    for k in rng.choice(SMALL.total, 60, replace=False):
        step = np.zeros(SMALL.total)
        step[k] = 1e-4
        slope = (loss(flat + step) - loss(flat - step)) / 2e-4
        assert abs(slope - gradient[k]) < 1e-3 + 1e-2 * abs(slope)


def test_long_products_and_sums_of_rows():
    rng = np.random.default_rng(4)
    for n in (0, 1, recurrent.FEW, 3 * recurrent.FEW + 5):
        a, b, at = rng.normal(size=(n, 5)).astype(np.float32), rng.normal(size=(n, 12)).astype(np.float32), rng.integers(0, 7, n)
        assert np.allclose(recurrent.across(a, b[:, 2:8]), a.T.astype(float) @ b[:, 2:8], atol=1e-3)
        out, want = np.ones((7, 6), np.float32), np.ones((7, 6))
        recurrent.add_rows(out, at, b[:, 4:10])
        np.add.at(want, at, b[:, 4:10])
        assert np.allclose(out, want, atol=1e-4)


@pytest.mark.parametrize("clip", [1e9, 0.5])
def test_steps_of_adam_are_the_textbook_ones(clip):
    rng, shape = np.random.default_rng(6), Shape(hidden=8)
    flat, slopes = random_net(shape), [rng.normal(0, 1, shape.total) * 10.0 ** rng.integers(-6, 2, shape.total) for _ in range(4)]
    trainer, want, first, second = recurrent.Trainer(shape, flat, 0.01, clip=clip), flat.astype(float), 0, 0
    for turn, slope in enumerate(slopes, 1):
        trainer.grad[:] = slope
        trainer._adam(0.25)
        g = slope / 4 * min(1, clip / np.linalg.norm(slope / 4))
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        want = want - 0.01 * (first / (1 - 0.9 ** turn)) / (np.sqrt(second / (1 - 0.99 ** turn)) + 1e-6)
    assert np.allclose(trainer.flat, want, atol=1e-5)


def test_windows_work_in_memory_they_keep():
    """A window touches each array a step at a time and takes little new memory: 9.3 MB with whole-window arrays."""
    rng, shape = np.random.default_rng(7), Shape()
    counts = rng.integers(1, 100, 1500)
    symbols = rng.integers(1, shape.listed + shape.tails, counts.sum())
    symbols[np.cumsum(counts) - 1] = recurrent.END
    trainer, taken = recurrent.Trainer(shape, random_net(shape), 0.003), []
    window = trainer._window

    def measured(*args):
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        state = window(*args)
        taken.append(tracemalloc.get_traced_memory()[1] - before)
        return state

    trainer._window = measured
    tracemalloc.start()
    try:
        trainer.learn(symbols, counts)
    finally:
        tracemalloc.stop()
    assert trainer.seen == counts.sum() and len(taken) > 5
    assert max(taken[1:4]) < 4e6


def test_words_of_any_slice():
    rng = random.Random(8)
    for _ in range(300):
        texts = ["".join(rng.choice("aBz \t\n\r\x0b\u00e9\u3000") for _ in range(rng.choice([0, 0, 1, 2, 5, 9]))) for _ in range(rng.randint(1, 6))]
        for low, high, data, starts in slices(pa.array(texts), rng.choice([3, 20, 1000])):
            words, counts = lm.words_of(data, starts)
            want = [words_of(text) for text in texts[low:high]]
            assert counts.tolist() == [len(w) for w in want] and words.to_pylist() == [w for ws in want for w in ws]


def by_counting(data, learned):
    counts = Counter(t for _, text in learned for t in [*words_of(text), None])
    n, v = sum(counts.values()), len(counts)
    each = [(doc, [*words_of(text), None]) for doc, text in data]
    return [(doc, len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for doc, t in each]


def same(found, want):
    key = lambda r: repr(r[:4])
    found, want = sorted(found, key=lambda r: (key(r), r[4])), sorted(want, key=lambda r: (key(r), r[4]))
    assert [r[:4] for r in found] == [r[:4] for r in want]
    assert np.allclose([r[4] for r in found], [r[4] for r in want], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("shape,block", [(Shape(), lm.BLOCK), (SMALL, 300)])
def test_counts_of_awkward_rows(docs, none, shape, block):  # noqa: F811
    learned = docs.where("doc_id < 10 OR doc_id IS NULL")
    found = lm.score(docs, lm.train(learned, shape, block=block), block).collect()
    data = rows(docs.select("doc_id", "text"))
    same([tuple(r)[:5] for r in found], by_counting(data, [r for r in data if r[0] is None or r[0] < 10]))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert lm.score(none, lm.train(learned, SMALL)).count() == 0
    unknown = lm.score(docs, lm.train(none, SMALL)).collect()
    same([tuple(r)[:5] for r in unknown], by_counting(data, []))
    assert all(math.isfinite(r["score"]) for r in unknown)


def test_tail_words_share_what_their_class_has(spark):
    """With a network that knows no state the score is that of class, word list and counts."""
    texts = spark.createDataFrame([(k, text) for k, text in enumerate(["a a a b b", "xa ya xa zb", "qc", ""])], "doc_id long, text string")
    shape = Shape(hidden=2, listed=3, groups=1, tails=32)
    model = lm.train(texts, shape, rounds=(), warm=0)
    assert model.listed == ["a", "b"] and model.tokens == 14
    found = {r["doc_id"]: r["score"] for r in lm.score(texts, model).collect()}
    own = {"a": 3.1, "b": 2.1, None: 4.1}
    classes = {"head": 9.1, ord("a"): 3.1, ord("b"): 1.1, ord("c"): 1.1}
    whole = sum(classes.values()) + 29 * 0.1
    def p(word, c=0, n=0, types=0):
        return own[word] / 9.3 * classes["head"] / whole if word in own else classes[ord(word[-1])] / whole * (c + 0.1) / (n + 0.1 * (types + 1))
    assert found[3] == pytest.approx(math.log10(p(None)), abs=1e-5)
    assert found[2] == pytest.approx(math.log10(p("qc", 1, 1, 1) * p(None)), abs=1e-5)
    assert found[1] == pytest.approx(math.log10(p("xa", 2, 3, 2) ** 2 * p("ya", 1, 3, 2) * p("zb", 1, 1, 1) * p(None)), abs=1e-5)


def test_query(spark, folder):
    found = QUERIES["op13_lm_score"](spark, folder).collect()
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    out = {doc: zlib.crc32(str(doc).encode()) % 10 == 0 for doc, _ in data}
    assert {r["doc_id"]: r["held_out"] for r in found} == out
    same([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in found], by_counting(data, [r for r in data if not out[r[0]]]))
    far = [r for r in found if r["held_out"]]
    assert sum(r["score"] for r in far) > 0.97 * sum(r["base_score"] for r in far)

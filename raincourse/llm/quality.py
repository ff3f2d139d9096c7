"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader.

Tokens are words (letters and digits of any script) and runs of other signs. A word that
repeats one of the few before it is replaced by a mark of the distance, so repetition is a feature
whatever the words are. Features are hashed runs of one to three tokens with relative frequency.
Training rows are a bounded sample of the labelled ones; shards of them learn in parallel and
their weights are averaged. Scoring is one sparse dot product per document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourse.llm.bytes_hash import Hasher, U, mix, runs, slices
from raincourse.llm.learn import drawn, remainder
from raincourse.session import sized

BITS = 18
ORDERS = 3
BACK = 4
SAMPLE = 16_384
SHARDS = 8
PASSES = 4
PER_SHARD = 2_048
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-4


def _kinds() -> np.ndarray:
    table = np.full(256, 2, np.uint8)  # other signs
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[48:58] = table[65:91] = table[97:123] = table[128:] = 1
    return table


def features(data: np.ndarray, rows: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice, sorted by row: row, bucket and value of each different n-gram. The value is the root of its share."""
    starts, ends, row = runs(_kinds()[data], rows)
    token = hasher.intervals(data, starts, ends)
    seen = token.copy()
    for back in range(BACK, 0, -1):
        same = np.zeros(len(token), bool)
        same[back:] = (token[back:] == token[:-back]) & (row[back:] == row[:-back])
        seen[same] = U(back)
    value, owners, buckets = mix(seen + U(1)), [], []
    for order in range(ORDERS):
        at = np.arange(max(0, len(seen) - order))
        at = at[row[at] == row[at + order]]
        if order:
            value[at] = mix(value[at] * U(3) + seen[at + order])
        owners.append(row[at])
        buckets.append((value[at] >> U(64 - BITS)).astype(np.int64))
    key, count = np.unique(np.concatenate(owners) << BITS | np.concatenate(buckets), return_counts=True)
    owner = key >> BITS
    total = np.bincount(owner, count, len(rows) - 1)
    return owner, key & ((1 << BITS) - 1), np.sqrt(count / total[owner])


def train_ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights after ``PASSES`` over (buckets, values, label) in a fixed mixed order; the last weight is the bias."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(1)
    good = sum(y for _, _, y in examples)
    # Both labels weigh the same, so 0.5 is the border whatever their share.
    weight = [len(examples) / 2 / max(1, len(examples) - good), len(examples) / 2 / max(1, good)]

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(z[at]) <= L1] = 0
        return w

    for _ in range(PASSES):
        for k in order.permutation(len(examples)):
            at, x, y = examples[k]
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = weight[y] * (p - y) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(np.arange(size))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, held_out: int = 1, parts: int = 3) -> np.ndarray:
    """Weights from labelled rows whose id has not the held-out remainder.

    At most about ``sample`` labelled ids are drawn by hash. Ids with null or differing labels
    are left out. Without any usable row the weights are zero and every score is 0.5.
    """
    ids = labels.where("quality IN (0, 1)").where(remainder("doc_id", parts) != held_out).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z")).where("y = z AND doc_id IS NOT NULL")
    ids = sized(ids.select(F.col("doc_id").alias("label_id"), F.col("y").cast("int").alias("y")), "labelled")
    rate = sample / max(sample, ids.count())
    chosen = sized(ids.where(drawn(F.lit(rate), "label_id")), "chosen")
    rows = docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("label_id"))
    # A repeated id may stand on many rows; the draw by row keeps the bound for them.
    rows = sized(rows.select("label_id", "text", "y"), "training")
    number = rows.count()
    rows = rows.where(drawn(F.lit(sample / max(sample, number)), "label_id", "text"))
    shards = min(SHARDS, max(1, min(number, sample) // PER_SHARD))
    shard = F.pmod(F.xxhash64("label_id", F.lit("shard")), F.lit(shards)).alias("shard")

    def train(table: pa.Table) -> pa.Table:
        hasher, examples = Hasher(), []
        y = table["y"].to_numpy()
        for low, high, data, where in slices(table["text"]):
            owner, bucket, value = features(data, where, hasher)
            edges = np.searchsorted(owner, np.arange(high - low + 1))
            for k in range(high - low):
                mine = slice(edges[k], edges[k + 1])
                examples.append((np.append(bucket[mine], 1 << BITS), np.append(value[mine], 1.0), int(y[low + k])))
        return pa.table({"n": [len(examples)], "w": [train_ftrl(examples).astype(np.float32).tobytes()]})

    found = rows.select(shard, "text", "y").groupBy("shard").applyInArrow(train, "n long, w binary").collect()
    if not found:
        return np.zeros((1 << BITS) + 1)
    return np.average([np.frombuffer(r["w"], np.float32) for r in found], axis=0, weights=[r["n"] for r in found])


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with a column ``quality_score`` in the struct beside the row: (row, doc_id, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float64))

    def run(batches):
        hasher, w = Hasher(), sent.value
        for batch in batches:
            scores = []
            for low, high, data, where in slices(batch.column(1)):
                owner, bucket, value = features(data, where, hasher)
                margin = np.bincount(owner, w[bucket] * value, high - low) + w[-1]
                scores.append(1 / (1 + np.exp(-np.clip(margin, -30, 30))))
            values = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["row", "score"])

    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string"))
    return rows.mapInArrow(run, f"row {docs.select(F.struct(*docs.columns).alias('row')).schema['row'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` (doc_id, text) to (row, score, held_out, predicted), row with all columns of ``docs``.

    Null and empty texts score by the bias alone; repeated rows score alike; a null id counts as
    not held out unless crc32 of the empty text says so; extra columns stay in ``row``. An empty
    table gives an empty result.
    """
    scored = score(docs, fit(docs, labels, sample))
    return scored.select("row", "score", (remainder("row.doc_id", 3) == 1).alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted"))

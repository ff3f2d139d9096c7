"""Language identification in two steps: family, then one-versus-one linear SVMs inside it.

Features are hashed byte trigrams of the text in lower case (A-Z), with word borders, as roots of
their shares scaled to length one. Family machines are one against the rest, each on a bounded
sample; machines of a family separate every pair of its languages and vote.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourse.llm.bytes_hash import lowered, slices
from raincourse.llm.learn import drawn, remainder
from raincourse.session import sized

BITS = 15
PER_LANGUAGE = 1_000
STEPS, BATCH, DECAY = 1_500, 64, 1e-3

# Families of languages by code. A language not listed here is in family "other".
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is"],
    "romance": ["fr", "es", "it", "pt", "ca", "ro", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "austronesian": ["id", "ms", "jv", "su", "tl"],
    "uralic": ["fi", "et", "hu"],
}


def family_of(language: str) -> str:
    return next((f for f, members in FAMILIES.items() if language.lower().split("-")[0] in members), "other")


def features(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice, sorted by row: row, bucket and value of each different trigram."""
    text = lowered(data).astype(np.uint64)
    table = np.isin(text, [9, 10, 11, 12, 13])
    text[table] = 32
    at = np.arange(max(0, len(text) - 2))
    row = np.searchsorted(rows, at, "right") - 1
    at = at[row == np.searchsorted(rows, at + 2, "right") - 1] if len(at) else at
    row = np.searchsorted(rows, at, "right") - 1
    code = text[at] << np.uint64(16) | text[at + 1] << np.uint64(8) | text[at + 2]
    bucket = ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int64)
    key, count = np.unique(row << BITS | bucket, return_counts=True)
    owner = key >> BITS
    total = np.bincount(owner, count, len(rows) - 1)
    return owner, key & ((1 << BITS) - 1), np.sqrt(count / total[owner])


def train_svm(texts: pa.ChunkedArray, sign: np.ndarray) -> np.ndarray:
    """Weights and bias of a linear SVM by averaged subgradient steps on balanced batches."""
    examples, signs = [], []
    for low, high, data, rows in slices(texts):
        owner, bucket, value = features(data, rows)
        edges = np.searchsorted(owner, np.arange(high - low + 1))
        examples += [(bucket[edges[k]:edges[k + 1]], value[edges[k]:edges[k + 1]]) for k in range(high - low)]
        signs += sign[low:high].tolist()
    signs = np.array(signs)
    sides = [np.flatnonzero(signs == s) for s in (1, -1)]
    w, mean, draw = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1), np.random.default_rng(1)
    if not all(len(s) for s in sides):
        w[-1] = 1.0 if len(sides[0]) else -1.0
        return w
    for step in range(1, STEPS + 1):
        rate = 1 / (DECAY * (step + 10 / DECAY / 10))
        picked = np.concatenate([draw.choice(s, BATCH // 2) for s in sides])
        change = np.zeros_like(w)
        for k in picked:
            at, x = examples[k]
            if signs[k] * (w[at] @ x + w[-1]) < 1:
                change[at] += signs[k] * x
                change[-1] += signs[k]
        w = w * (1 - rate * DECAY) + rate / BATCH * change
        if step > STEPS // 2:
            mean += w
    return mean / (STEPS - STEPS // 2)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, held_out: int = 2, parts: int = 4) -> dict:
    """{"family": {name: weights}, "pair": {(a, b): weights}, "languages": {family: [...]}} from text and lang.

    About ``per_language`` rows with a text and a lang are drawn for each language, by hash, from
    rows whose id has not the held-out remainder. The languages are a registry: the driver sees
    their names and one weight vector per machine, nothing that grows with the documents.
    """
    rows = docs.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL").where(remainder("doc_id", parts) != held_out)
    counts = sized(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    rate = F.least(F.lit(1.0), per_language / F.col("n"))
    sample = sized(rows.join(counts, "lang").where(drawn(rate, "doc_id", "text")).select("lang", "text"), "sample")
    groups: dict[str, list[str]] = {}
    for row in sample.select("lang").distinct().orderBy("lang").collect():
        groups.setdefault(family_of(row["lang"]), []).append(row["lang"])
    tasks = []
    for family, members in groups.items():
        tasks += [(f"family {family}", lang, 1 if lang in members else -1) for each in groups.values() for lang in each]
        tasks += [(f"pair {a} {b}", lang, sign) for i, a in enumerate(members) for b in members[i + 1:] for lang, sign in ((a, 1), (b, -1))]
    model = {"languages": groups, "family": {}, "pair": {}}
    if not tasks:
        return model
    work = docs.sparkSession.createDataFrame(tasks, "task string, lang string, sign int")

    def train(table: pa.Table) -> pa.Table:
        weights = train_svm(table["text"], table["sign"].to_numpy())
        return pa.table({"task": [table["task"][0].as_py()], "w": [weights.astype(np.float32).tobytes()]})

    for row in sample.join(work, "lang").select("task", "text", "sign").groupBy("task").applyInArrow(train, "task string, w binary").collect():
        kind, _, name = row["task"].partition(" ")
        model[kind][tuple(name.split(" ")) if kind == "pair" else name] = np.frombuffer(row["w"], np.float32).astype(np.float64)
    return model


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, lang_pred, score (0 to 1), one row per row.

    Null texts and texts without a letter of any script give ``und`` with score 0, as does a model
    without languages. Score is the product of the two steps' logistic margins. Repeated rows are
    predicted alike; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import re

        letter, model = re.compile(r"[^\W\d_]"), sent.value
        families, languages = sorted(model["family"]), model["languages"]
        sure = lambda m: 1 / (1 + np.exp(-np.clip(4 * m, -30, 30)))
        for batch in batches:
            texts, out_lang, out_score = batch.column(1), [], []
            for low, high, data, rows in slices(texts):
                n = high - low
                owner, bucket, value = features(data, rows)
                margin = lambda w: np.bincount(owner, w[bucket] * value, n) + w[-1]  # noqa: B023, E731
                lang, score = np.full(n, "und", object), np.zeros(n)
                if families:
                    each = np.stack([margin(model["family"][f]) for f in families])
                    best, first = each.argmax(axis=0), sure(each.max(axis=0))
                    for k, family in enumerate(families):
                        members = languages[family]
                        votes, sums = np.zeros((len(members), n)), np.zeros((len(members), n))
                        for i, a in enumerate(members):
                            for j in range(i + 1, len(members)):
                                m = margin(model["pair"][a, members[j]])
                                votes[i] += m >= 0
                                votes[j] += m < 0
                                sums[i] += sure(m)
                                sums[j] += sure(-m)
                        winner = (votes + sums / (len(members) + 1)).argmax(axis=0)
                        chance = sums[winner, np.arange(n)] / max(1, len(members) - 1) if len(members) > 1 else np.ones(n)
                        here = best == k
                        lang[here] = np.array(members, object)[winner[here]]
                        score[here] = (first * chance)[here]
                for k in range(n):
                    text = texts[low + k].as_py()
                    if text is None or letter.search(text) is None:
                        lang[k], score[k] = "und", 0.0
                out_lang += lang.tolist()
                out_score += score.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out_lang, pa.string()), pa.array(out_score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")

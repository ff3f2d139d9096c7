"""The training-data operators against brute force, on small tables with awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from raincourse.llm import exact_dedup, language, minhash, mix, pack, pii, quality, token_counts, vectors, warc
from raincourse.llm.common import components, rank_within
from raincourse.llm.queries import ORACLES, QUERIES, tokenizer
from raincourse.llm.tokens import WordTokens
from tests.oracle_check import compare, sql_connection

WORDS = [f"w{k}x" for k in range(400)]
BASE = " ".join(WORDS[:120])
NEAR = " ".join([*WORDS[:60], "changed", *WORDS[61:120]])
FAR = " ".join(WORDS[200:320])
LONG = " ".join(WORDS[(k * 7) % 400] for k in range(12_000))
# (doc_id, text, source): nulls in every column, empty and long texts, ties, repeated rows.
ROWS = [
    (1, BASE, "a"), (2, NEAR, "a"), (3, FAR, "b"), (4, BASE, None), (5, "", "b"), (6, None, "c"), (7, "one two", "c"), (8, "ONE\ttwo\n", "c"),
    (None, BASE, "a"), (10, LONG, "a"), (11, "one two", None), (11, "one two", None), (12, "  \n ", "é"), (13, "!!! ### 123", "a"), (14, "日本 é's", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, source string").repartition(3)
    clash = ["row", "size", "digest", "cls", "_rank", "key", "score", "length", "kept", "label_id"]  # names that operators use themselves
    return frame.withColumns({c: F.lit("extra") for c in clash}).withColumn("lang", F.when(F.col("doc_id") < 4, "en").otherwise(F.when(F.col("doc_id") < 12, "fr")))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def rows(df):
    return [tuple(r) for r in df.collect()]


def words_of(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return {n: top(n) for n in nodes}


def test_ranks_are_those_of_a_sort(spark):
    frame = spark.range(2000).select(F.lit("g").alias("g"), (F.col("id") % 7).alias("o"), F.md5(F.col("id").cast("string").cast("binary")).alias("tie"))
    found = sorted(rows(rank_within(frame, ["g"], ["o"], "tie")), key=lambda r: r[-1])
    assert [r[-1] for r in found] == list(range(2000))
    keys = [(r[1] if isinstance(r[1], int) else r[0], r) for r in found]
    assert [k for k, _ in keys] == sorted(k for k, _ in keys)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    want = groups(edges, {n for e in edges for n in e if e[0] != e[1]})
    assert {frozenset(n for n in found if found[n] == r) for r in found.values()} == {frozenset(n for n in want if want[n] == r) for r in want.values()}
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


PII = [
    "mail a.b@c.de and a@b c@d.e_f@g.h x@y@z.org", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 001.002.003.255.", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 12345678901234567890",
    "call +1 (415) 555-2671 or +49 30 1 or +1234567890123456", "é😀 a@b.cd +1 415 555 2671", "", None, "9" * 30_000, "a." * 5_000 + "@b" + ".c" * 5_000, "1.2.3.4" * 500,
]


def test_base_spans_are_those_of_the_rules(spark):
    def luhn(number):
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(number))]
        return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0

    found = {r["doc_id"]: r for r in pii.digest(pii.find_pii(spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string"))).collect()}
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for k, text in enumerate(PII):
        want = []
        for kind, rule in rules.items():
            for m in re.finditer(rule, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
                want += [f"{kind}:{m.start()}:{m.end()}"] if ok else []
        assert found[k]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), text
        assert set(want) <= set(found[k]["spans"].split(",")) | {""}


def added_spans(spark, texts, **more):
    """Texts of the spans that no base rule has, by document."""
    found = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **more).collect()
    out = {r["doc_id"]: sorted((pii.KINDS[x["k"]], texts[r["doc_id"]][x["s"]:x["e"]]) for x in r["spans"] if not x["base"]) for r in found}
    assert all(x["v"] == texts[r["doc_id"]][x["s"]:x["e"]] for r in found for x in r["spans"])
    return {k: v for k, v in out.items() if v}


def test_contexts_find_what_no_rule_knows(spark):
    texts = [f"please reach me: user{k}@mail{k}.example.org today" for k in range(20)] + ["please reach me: hidden@localhost today", "nothing at night@home here"]
    assert added_spans(spark, texts) == {20: [("email", "hidden@localhost")]}


def test_what_is_found_supports_new_contexts(spark):
    """Seeds give a context, it gives instances, they give another context, that gives a new value, and so on."""
    seeds = [f"no{k} reach me: user{k}@mail{k}.example.org x{k}y" for k in range(20)]
    first = [f"a{k} reach me: known{k}@local b{k}" for k in range(8)]
    second = [f"c{k} write now to known{k}@local d{k}q" for k in range(8)] + ["e write now to new@local f"]
    third = [f"g{k}z copy for: {v} h{k}" for k, v in enumerate(["new@local", "known0@local", "known1@local", "known2@local", "known3@local", "last@local"])]
    texts = [*seeds, *first, *second, *third]
    want = {k: [("email", text.split(" " + mark + " ")[1].split()[0])] for k, text in enumerate(texts) for mark in ("reach me:", "write now to", "copy for:")
            if mark in text and "@mail" not in text}
    assert added_spans(spark, texts) == want and len(want) == 8 + 9 + 6
    assert set(added_spans(spark, texts, rounds=1)) == set(range(20, 28))


def test_words_before_anything_are_no_pattern(spark):
    """The same word before every kind of thing points to none of them."""
    values = [lambda k: f"user{k}@mail.example.org", lambda k: f"10.0.{k}.7", lambda k: f"+1 (555) 555-10{k:02d}", lambda k: f"room{k}"]
    texts = [f"w{k}p the {values[k % 4](k)} q{k}q" for k in range(80)] + ["x the hidden@localhost y", "z the 555-1234-99 u"]
    assert added_spans(spark, texts) == {}


def test_candidates_beside_base_spans_and_punctuation(spark):
    texts = [f"n{k} mail is user{k}@mail{k}.example.org, m{k}" for k in range(10)]
    texts += ["mail is bob@localhost 4111 1111 1111 1111 end", "mail is eve@localhost. end", "mail is " + "a" * 90 + "@localhost, end", "mail is amy@localhost 2024 end"]
    got = added_spans(spark, texts)
    assert {k: [v for kind, v in got[k] if kind == "email"] for k in range(10, 14)} == {10: ["bob@localhost"], 11: ["eve@localhost"], 12: ["a" * 90 + "@localhost"], 13: ["amy@localhost"]}


def test_pii_of_awkward_rows(docs, none):
    assert pii.find_pii(docs).count() == len(ROWS) and pii.find_pii(none).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_by_line(docs, none, rule):
    import public_tokenizers

    path = tokenizer("byte_bpe_50k.tiktoken")
    coder, ranks = token_counts.encoder(path, public_tokenizers.PATTERN)
    names = {n: t for t, n in ranks.items()}
    found = token_counts.count_tokens(docs, path, public_tokenizers.PATTERN, rule)
    got = Counter((r["doc_id"], r["section"], r["start"], r["end"], r["tokens"], r["doc_tokens"]) for r in found.collect())
    want = Counter()
    for doc, text, _ in ROWS:
        data, at, spans = (text or "").encode(), 0, []
        for number in coder.encode(text or "", disallowed_special=()):
            spans.append((at, at + len(names[number])))
            at = spans[-1][1]
        edges = [0] + [k + 1 for k, b in enumerate(data) if b == 10]
        ends = [*edges[1:], len(data)]
        counts = Counter()
        for a, b in spans:
            shares = [max(0, min(b, e) - max(a, s)) for s, e in zip(edges, ends, strict=True)]
            counts[max(k for k, s in enumerate(edges) if s <= a) if rule == "start" else shares.index(max(shares))] += 1
        for k, (s, e) in enumerate(zip(edges, ends, strict=True)):
            want[doc, k, len(data[:s].decode()), len(data[:e].decode()), counts[k], len(spans)] += 1
    assert got == want
    assert token_counts.count_tokens(none, path, public_tokenizers.PATTERN).count() == 0


def vector_rows():
    draw = np.random.default_rng(5)
    base = draw.standard_normal((60, 16))
    copies = base[draw.integers(0, 60, 240)] + draw.standard_normal((240, 16)) * 0.06
    x = np.concatenate([base, copies, copies[:20]]).astype(np.float32)
    out = [(k, v.tolist(), int(k % 2) if k % 11 else None) for k, v in enumerate(x)]
    return out + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] + [0.0] * 14, 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (None, x[1].tolist(), 1), (1, x[1].tolist(), 1)]


@pytest.mark.parametrize("leaf", [vectors.LEAF, 16])
def test_vector_links(spark, leaf):
    data = vector_rows()
    frame = spark.createDataFrame([(*r, "extra", "extra") for r in data], "vec_id long, embedding array<float>, label int, cid string, code string")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.link_vectors(frame, leaf=leaf).collect())
    usable = [k for k, (_, v, label) in enumerate(data) if label is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = {k: np.array(np.array(data[k][1], np.float32), float) for k in usable}
    pairs = [(a, b) for i, a in enumerate(usable) for b in usable[i + 1:] if data[a][2] == data[b][2] and len(unit[a]) == len(unit[b])
             and unit[a] @ unit[b] / np.linalg.norm(unit[a]) / np.linalg.norm(unit[b]) >= 0.98]
    top = groups(pairs, range(len(data)))
    links, want = Counter(k for p in pairs for k in p), Counter()
    for k, (vec, _, _) in enumerate(data):
        ids = [data[j][0] for j in top if top[j] == top[k] and data[j][0] is not None]
        least = min(ids) if ids else None
        want[vec, links[k], least, vec == least] += 1
    assert sum(links.values()) > 400 and got == want


def test_crowded_leaves_are_cut_differently_in_each_tree(spark):
    draw = np.random.default_rng(9)
    x = draw.standard_normal(64) / 8 + draw.standard_normal((3000, 64)) * 0.018
    classes = spark.createDataFrame([(f"{k:04}", v.tolist(), 64) for k, v in enumerate(x)], "cid string, embedding array<double>, dims int")
    leaves = classes.select("cid", F.explode(F.sequence(F.lit(0), F.lit(vectors.TREES - 1))).alias("t")).select("cid", F.shiftleft(F.col("t").cast("long"), 32).alias("code"))
    cut = vectors._split_crowded(leaves, classes, 1500).groupBy("code").agg(F.collect_set("cid").alias("cids")).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lost = np.triu(x @ x.T >= 0.98, 1)
    assert len(cut) > 2 * vectors.TREES and lost.sum() > 100_000
    for leaf in cut:
        at = np.array([int(c) for c in leaf["cids"]])
        lost[np.ix_(at, at)] = False
    assert not lost.any(), lost.sum()


def test_no_vectors(spark):
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_a_lost_batch_can_be_taken_in_again(spark, docs):
    index = "test_retry_" + hashlib.md5(repr(spark.sparkContext.applicationId).encode()).hexdigest()
    spark.sql(f"DROP TABLE IF EXISTS {index}")
    digests = exact_dedup.digests_of(docs)
    first = Counter(rows(exact_dedup.ingest(digests.where("doc_id < 3"), index, "a")))
    listed = Counter(rows(spark.table(index)))
    assert Counter(rows(exact_dedup.ingest(digests.where("doc_id < 3"), index, "a"))) == first
    assert Counter(rows(spark.table(index))) == listed
    second = Counter(rows(exact_dedup.ingest(digests, index, "b")))
    listed = Counter(rows(spark.table(index)))
    part = spark.table(index).where("batch = 'b'").limit(1).collect()  # an append that ended half way
    half = index + "_half"
    spark.sql(f"DROP TABLE IF EXISTS {half}")
    kept = spark.table(index).where("batch = 'a'").union(spark.createDataFrame(part, spark.table(index).schema))
    kept.write.bucketBy(4, "digest").sortBy("digest").saveAsTable(half)
    assert Counter(rows(exact_dedup.ingest(digests, half, "b", 4))) == second and Counter(rows(spark.table(half))) == listed
    for name in (index, half):
        spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("rounds", [0, 2])
def test_dense_cluster_is_counted_once_over_its_blocks(spark, rounds):
    draw = np.random.default_rng(4)
    x = draw.standard_normal(16) + draw.standard_normal((240, 16)) * 0.02  # far narrower than the spill: no split helps
    got = vectors.link_vectors(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int"), threshold=0.9996, leaf=32, rounds=rounds)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = ((unit @ unit.T) >= 0.9996).sum(axis=1) - 1
    assert [r["n_links"] for r in got.orderBy("vec_id").collect()] == want.tolist() and 1000 < want.sum() < 50_000


def test_codes_do_not_grow_with_blocks(spark):
    leaves = spark.range(400).select(F.col("id").cast("string").alias("cid"), F.lit(7).cast("long").alias("code"), F.lit(400).alias("m"))
    placed = vectors._block_pairs(leaves, 20)
    assert placed.select("leaf").distinct().count() == 1 and placed.count() == 400 * 40
    assert placed.where("alone").count() == 400


def test_mix_of_awkward_rows(docs, none):
    found = mix.mixed(docs).select("row.doc_id", "row.text", "row.source", "row.size", "size", "source_size", "target", "copies").collect()
    assert len(found) == len(ROWS) and {r[3] for r in found} == {"extra"}
    sizes = Counter()
    for _, text, source in ROWS:
        sizes[source] += len(words_of(text))
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight, target = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}
    while True:  # share what is left by weight until no source is above its limit
        left = 1.5 * sum(sizes.values()) - sum(target.values())
        rest = {s: left * weight[s] / sum(weight[o] for o in order if o not in target) for s in order if s not in target}
        over = [s for s in rest if rest[s] > 2 * sizes[s]]
        target |= {s: 2.0 * sizes[s] for s in over} or rest
        if not over or len(target) == len(order):
            break
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["copies"] <= 2
    assert mix.mixed(none).count() == 0
    assert rows(mix.mixed(docs).select("row.doc_id", "copies").orderBy("doc_id", "copies")) == rows(mix.mixed(docs.repartition(1)).select("row.doc_id", "copies").orderBy("doc_id", "copies"))
    assert mix.emit_copies(mix.mixed(docs)).columns == docs.columns


def test_mix_takes_its_targets(spark, folder):
    found = mix.mixed(spark.read.parquet(folder.replace("0.001", "0.1") + "/documents.parquet")).groupBy("row.source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("n")).collect()
    assert all(abs(r["n"] / r["t"] - 1) < 0.05 for r in found)


def near_groups(data, percent):
    sets = []
    for _, text, _ in data:
        w = words_of(text)
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    pairs = [(a, b) for a in range(len(data)) for b in range(a + 1, len(data)) if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    top, want = groups(pairs, range(len(data))), Counter()
    for k, (doc, _, _) in enumerate(data):
        ids = [data[j][0] for j in top if top[j] == top[k] and data[j][0] is not None]
        least = min(ids) if ids else None
        want[doc, len(sets[k]), least, doc == least] += 1
    return want


def test_near_copies_of_awkward_rows(docs, none):
    for percent in (80, 99):
        assert Counter(rows(minhash.near_duplicates(docs, percent).drop("cls"))) == near_groups(ROWS, percent)
    assert minhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("limit,block", [(minhash.REGION, minhash.BLOCK), (6, minhash.BLOCK), (6, 1_000), (minhash.REGION, 4_000)])
def test_a_large_group_of_near_copies(spark, limit, block):
    draw, data = np.random.default_rng(3), []
    for k in range(150):
        w = list(WORDS[:150]) if k % 3 else [*WORDS[:30], *(f"u{k}v{j}" for j in range(100))]
        for at in draw.integers(0, len(w), draw.integers(0, 5)):
            w[at] = f"n{k}"
        data.append((k, " ".join(w), "s"))
    data += [(1000, " ".join(WORDS[:150]), "s")] * 30
    frame = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    assert Counter(rows(minhash.near_duplicates(frame, 85, limit=limit, block=block).drop("cls"))) == near_groups(data, 85)


@pytest.mark.parametrize("block", [minhash.BLOCK, 5_000])
def test_pairs_inside_a_shared_template(spark, block):
    data = []
    for k in range(250):  # 0.77 between the documents of the template, 0.86 inside a pair
        tail = [f"u{k}v{j}" for j in range(14)]
        data += [(2 * k, " ".join([*WORDS[:100], *tail]), "s"), (2 * k + 1, " ".join([*WORDS[:100], *tail[:6], *(f"y{k}v{j}" for j in range(8))]), "s")]
    frame = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    found = rows(minhash.near_duplicates(frame, 85, limit=16, block=block).drop("cls"))
    assert sum(not r[3] for r in found) == 250 and Counter(found) == near_groups(data, 85)


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_links_of_a_block_join_what_a_brute_force_joins(percent):
    draw = np.random.default_rng(percent)
    sets = []
    for k in range(120):
        own = draw.choice(4000, draw.integers(1, 60), replace=False) if k % 4 == 0 else sets[draw.integers(0, len(sets))].astype(np.int64)
        own = own[draw.random(len(own)) > 0.06]
        sets.append(np.unique(np.append(own, draw.integers(0, 4000, 2))).astype(np.uint64))
    roots = np.array([str(k if k % 10 else 0) for k in range(120)])
    found = minhash.set_links(sets, roots, percent)
    linked = lambda x, y: 100 * len(set(sets[x]) & set(sets[y])) >= percent * len(set(sets[x]) | set(sets[y]))
    assert all(linked(x, y) for x, y in found) and len(found) < len(set(roots))
    same = [(0, k) for k in range(0, 120, 10)]
    assert groups(found + same, range(120)) == groups([(x, y) for x in range(120) for y in range(x) if linked(x, y)] + same, range(120))


def test_exact_copies_over_batches(spark, docs, none):
    index = "test_index_" + hashlib.md5(repr(spark.sparkContext.applicationId).encode()).hexdigest()
    spark.sql(f"DROP TABLE IF EXISTS {index}")
    got = Counter(rows(exact_dedup.dedup(exact_dedup.digests_of(docs), index, batches=3).drop("digest")))
    texts, want = [t or "" for _, t, _ in ROWS], Counter()
    for (doc, _, _), text in zip(ROWS, texts, strict=True):
        ids = [d for (d, _, _), t in zip(ROWS, texts, strict=True) if t == text and d is not None]
        want[doc, max(ids) if ids else None, texts.count(text), doc == (max(ids) if ids else None)] += 1
    assert got == want
    again = exact_dedup.ingest(exact_dedup.digests_of(docs), index, "later")
    assert again.where("NOT known").count() == 0 and spark.table(index).count() == len(set(texts))
    plan = spark.table(index).groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # the index is read by bucket
    assert exact_dedup.dedup(exact_dedup.digests_of(none), index).count() == 0
    spark.sql(f"DROP TABLE {index}")


def test_quality_learns_and_holds_out(spark, folder):
    folder = folder.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = {r["doc_id"]: r for r in quality.classify(docs, labels).select("row.doc_id", "held_out", "score", "predicted").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in found.items())
    held = [(found[r["doc_id"]]["predicted"], r["quality"]) for r in labels.collect() if found[r["doc_id"]]["held_out"]]
    assert np.mean([a == b for a, b in held]) > 0.95
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    same = {r["doc_id"]: r["score"] for r in quality.classify(docs, turned).select("row.doc_id", "score").collect()}
    assert all(same[d] == r["score"] for d, r in found.items())  # held-out labels change nothing


def test_quality_of_awkward_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (5, 0), (5, 1), (10, 1)], "doc_id long, quality int")
    found = quality.classify(docs, labels).select("row.*", F.col("score").alias("s"), "predicted")
    assert found.count() == len(ROWS) and found.where("s BETWEEN 0 AND 1").count() == len(ROWS) and found.columns[:-2] == docs.columns
    assert quality.classify(none, labels).count() == 0
    assert {r[0] for r in quality.classify(docs, labels.where("false")).select("score").collect()} == {0.5}


def test_language(spark, folder, docs, none):
    data = spark.read.parquet(folder.replace("0.001", "0.01") + "/documents.parquet")
    model = language.fit(data)
    found = data.select("doc_id", "lang").join(language.predict(data, model), "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    assert found.where("lang = lang_pred").count() > 0.95 * found.count()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, language.fit(docs)).collect()}
    assert all(got[d] == ("und", 0.0) for d in (5, 6, 12, 13)) and got[1][0] in ("en", "fr") and all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in language.predict(docs, language.fit(none)).collect()} == {"und"} and language.predict(none, model).count() == 0


def test_one_language(docs):
    only = docs.withColumn("lang", F.lit("en"))
    assert {r["lang_pred"] for r in language.predict(only, language.fit(only)).collect()} == {"en", "und"}


def test_ids_equal_the_tokenizer(spark, folder):
    tokens = WordTokens(tokenizer("word_bpe_49k.json"), most=50)
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    texts += ["", " \n", "it's", "A1b22!!  x", "İstanbul é", "é J̌", "<|endoftext|> a", "\0a", "a b c", "ß² ½", "日本 é", "a\x1cb", "Σς ΟΔΟΣ", LONG]
    for text, ids in zip(texts, tokens.batch(pa.array(texts)), strict=True):
        assert ids.tolist() == tokens.slow.encode(text, add_special_tokens=False).ids, text[:80]


def test_packing_of_awkward_rows(docs, none):
    found = pack.pack(pack.cut(docs, tokenizer("word_bpe_49k.json"), 64), 64).collect()
    slow = WordTokens(tokenizer("word_bpe_49k.json")).slow
    want = Counter()
    for doc, text, _ in ROWS:
        ids = [*slow.encode(text or "", add_special_tokens=False).ids, 1]
        for k, start in enumerate(range(0, len(ids), 64)):
            part = ids[start:start + 64]
            want[doc, k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in found], 64)
    assert pack.pack(pack.cut(none, tokenizer("word_bpe_49k.json"))).count() == 0


def check_places(places, capacity):
    ends = {}
    for sequence, offset, length in sorted(places):
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    assert max(ends.values()) <= capacity
    return len(ends)


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit_decreasing(seed):
    draw = np.random.default_rng(seed)
    sizes = draw.integers(1, 41, 300).tolist()
    places = []
    for length, low, first, offset, each, high in pack.plan(Counter(sizes), 40).tolist():
        places += [(first + k // each, offset + k % each * length, length) for k in range(high - low)]
    assert Counter(p[2] for p in places) == Counter(sizes)
    bins = []
    for size in sorted(sizes, reverse=True):  # item by item, into the fullest bin that holds it
        fit = [k for k, room in enumerate(bins) if room >= size]
        if fit:
            bins[min(fit, key=lambda k: bins[k])] -= size
        else:
            bins.append(40 - size)
    assert check_places(places, 40) == len(bins)


def test_fixity(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k}</p>" * (k % 5)) for k in range(300)] + [(None, None, None), (5, "http://x/5", "again")], "page_id long, url string, html string").withColumns({"file": F.lit(1), "at": F.lit("x")})
    good = warc.response_records(pages).persist()
    assert warc.audit_replicas(good, good, 40).count() == 0
    bad = good.withColumn("record", F.when(F.col("page_id").isin(17, 203), F.concat(F.expr("substring(record, 1, 40)"), F.lit("?").cast("binary"), F.expr("substring(record, 42)"))).otherwise(F.col("record")))
    assert sorted(r["page_id"] for r in warc.audit_replicas(good, bad, 40).collect()) == [17, 203]
    assert warc.audit_replicas(good.where("false"), good.where("false")).count() == 0


def test_missing_and_added_records_are_located(spark):
    pages = spark.createDataFrame([(k, f"http://x/{k}", f"<p>{k}</p>" * (k % 5)) for k in range(3000)] + [(None, None, None), (None, None, "a"), (5, "http://x/5", "again"), (9000, "http://long", "é" * 200_000)],
                                  "page_id long, url string, html string")
    good = warc.response_records(pages).persist()
    kinds = lambda first, second: sorted(((r["kind"], r["page_id"]) for r in warc.audit_replicas(first, second, 1024).collect()), key=repr)
    less = good.where("page_id NOT IN (17, 1500) OR page_id IS NULL")
    assert kinds(good, less) == [("missing", 1500), ("missing", 17)]
    assert kinds(less, good) == [("added", 1500), ("added", 17)]
    longer = less.withColumn("record", F.when(F.col("page_id") == 40, F.concat("record", F.lit("more").cast("binary"))).otherwise(F.col("record")))
    assert kinds(good, longer) == [("changed", 40), ("missing", 1500), ("missing", 17)]
    twice = good.union(good.where("page_id = 40"))
    assert kinds(good, twice) == [("added", 40)] and kinds(twice, good) == [("missing", 40)]
    assert kinds(good, good.where("page_id IS NOT NULL")) == [("missing", None), ("missing", None)]
    assert len(kinds(good, good.where("false"))) == 3004


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, folder, name):
    verdict = compare(QUERIES[name](spark, folder), sql_connection(folder), ORACLES[name])
    assert verdict.startswith("ok"), verdict

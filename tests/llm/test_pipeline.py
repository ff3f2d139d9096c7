"""The pipeline stage by stage against what each must keep."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import near_groups


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder.replace('0.001', '0.01')}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, folder.replace("0.001", "0.01")).persist()
        assert docs.columns == columns
        seen[name] = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        was = [tuple(r) for r in before.select("doc_id", "text", "source").collect()]
        assert set(seen[name]) <= set(was) and seen[name]
        if name == "exact_dedup":
            last = {}
            for doc, text, _ in was:
                last[text or ""] = max(doc, last.get(text or "", doc))
            assert sorted(last.values()) == sorted(r[0] for r in seen[name])
        if name == "near_dedup":
            kept = {doc for doc, _, _, stays in near_groups(was, 80) if stays}
            assert {r[0] for r in seen[name]} == kept and len(seen[name]) == len(kept) < len(was)
        if name == "mix":
            assert max(Counter(r[0] for r in seen[name]).values()) == 2
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r[0] for r in seen["mix"])


def test_near_copies_with_shared_and_null_ids(spark, folder):
    def text(name, change=None):
        return " ".join(change if change and k == 30 else f"{name}{k}" for k in range(120))

    rows = [(1, text("a"), "x"), (2, text("a", "new"), "x"), (2, text("b"), "x"),  # an id with a near copy and a unique text
            (None, text("a", "other"), "x"), (None, text("c"), "x"),  # the same of the null id
            (5, text("d"), "x"), (5, text("d", "new"), "x"), (None, text("e"), "x"), (None, text("e", "new"), "x"),  # groups of one id
            (7, text("f"), "x"), (7, text("f") + " ", "x"), (8, " ", "x"), (8, text("f"), "x")]  # equal words, no words
    found = corpus_pipeline.keep_one_of_near(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), folder)
    assert found.columns == ["doc_id", "text", "source"]
    got = Counter((r["doc_id"], (r["text"].split() or [""])[0]) for r in found.collect())
    assert got == Counter([(1, "a0"), (2, "b0"), (None, "c0"), (5, "d0"), (None, "e0"), (7, "f0"), (8, "")])


def test_stages_on_awkward_rows(spark, folder):
    rows = [(1, "a b", None), (1, "a b", None), (None, None, "s"), (2, "", "s"), (3, "a b", "s"), (4, "x " * 5000, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, folder).persist()
            frame.count()
            if name == "exact_dedup":
                texts = [r["text"] or "" for r in frame.collect()]
                assert len(texts) == len(set(texts))


def test_stages_with_columns_of_any_name(spark, folder):
    text = [" ".join(f"{name}{k}" if k != at else "new" for k in range(60)) for name, at in (("a", -1), ("a", 9), ("b", -1), ("b", -1), ("c", -1))]
    docs = spark.createDataFrame([(k, t, f"s{k % 2}") for k, t in enumerate(text)], "doc_id long, text string, source string")
    names = ["_id", "_of", "_cls", "id", "of", "row", "cls", "root", "words_of", "digest", "text_digest", "keep", "best", "stays", "n", "size", "score", "key", "lang"]
    docs = docs.withColumns({c: F.lit(f"kept {c}") for c in names})
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder).persist()
        sizes.append(out.count())
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r[c] == f"kept {c}" for r in out.collect() for c in names)
            docs = out if name != "quality" else docs  # the tiny table has no labels to learn from
    assert sizes[1] == 4 and sizes[2] == 3

"""The fill-in-middle operator against a plain reading of its rules."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from raincourse.llm import infill
from raincourse.llm.queries import QUERIES
from tests.llm.test_operators import docs, none, rows  # noqa: F401

UNIT = re.compile("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+")


def by_rule(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or h[2] % 100 >= 50 or any(x in text for x in infill.MARKS):
        return doc, len(units), "plain", None, None, text, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return doc, len(units), "spm" if h[3] % 100 < 80 else "psm", len(p), len(m), out, text


@pytest.mark.parametrize("seed", [0, 1])
def test_descent_stands_on_every_rank(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 90, 40)
    counts[[0, 7, 39]] = 0, 3000, 0
    widths = rng.integers(1, 9, counts.sum())
    lists = infill.SkipLists(counts, widths)
    first = np.concatenate([[0], np.cumsum(counts)])
    document = np.repeat(np.arange(40), counts + 1)
    rank = np.concatenate([np.arange(n + 1) for n in counts])
    total = np.concatenate([[0], np.cumsum(widths)])
    assert len(lists.units) > 3
    assert (lists.cut(document, rank) == total[first[document] + rank] - total[first[document]]).all()


def test_no_documents():
    assert len(infill.SkipLists(np.zeros(0, np.int64), np.zeros(0, np.int64)).cut(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_cuts_of_awkward_rows(docs, none):  # noqa: F811
    extra = docs.sparkSession.createDataFrame(
        [(k, text) for k in range(100, 140) for text in ("é ü  ñ\t日本 語\n", "a <P> b", "x<S y <M z >", "one", "\n", "<<S <P >> <M<")], "doc_id long, text string")
    every = docs.select("*").unionByName(extra, allowMissingColumns=True)
    found = infill.fill_in_middle(every).withColumn("text", infill.restored())
    want = [by_rule(doc, text) for doc, text in rows(every.select("doc_id", "text"))]
    assert sorted(rows(found), key=repr) == sorted(want, key=repr)
    assert {r[2] for r in want} == {"plain", "spm", "psm"}
    assert rows(infill.fill_in_middle(none)) == []


def test_all_or_none_are_cut(docs):  # noqa: F811
    assert {r["form"] for r in infill.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    whole = infill.fill_in_middle(docs.where("text != ''"), rate=100, suffix_first=0).select("form").distinct()
    assert rows(whole) == [("psm",)]


def test_query_cuts_about_half(spark, folder):
    assert QUERIES["op11_infill"](spark, folder).where(F.col("form") != "plain").count() > 50

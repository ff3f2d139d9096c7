"""Token counts of sections by offset-mapped attribution.

A document is encoded once as a whole. Token spans are byte ranges that cover the text without
gaps; sections are the lines. Both are sorted, so the interval join of a document
is a merge by binary search. A token that crosses a border is allocated by an explicit rule:

- ``start``: to the section that holds its first byte;
- ``most``: to the section that holds most of its bytes, the earlier one on a tie.

Sections cover the text, so counts add up to the document's tokens.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = ("start", "most")


def encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


def attribute(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> np.ndarray:
    """Place in ``edges`` (sorted section starts from 0) of each token span [start, end)."""
    first = np.searchsorted(edges, starts, "right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(edges, np.maximum(ends, starts + 1) - 1, "right") - 1
    out = first.copy()
    for at in np.flatnonzero(last > first):
        bounds = np.concatenate([[starts[at]], edges[first[at] + 1:last[at] + 1], [ends[at]]])
        out[at] = first[at] + int(np.argmax(np.diff(bounds)))
    return out


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "start") -> DataFrame:
    """``docs`` (doc_id, text) to one row per line of each document.

    Columns: doc_id, section (from 0), start and end in characters (the line feed is part of its
    line), tokens, crossing (tokens of the section that reach beyond its end), doc_tokens. A null
    or empty text has one section without tokens; repeated rows give their sections again; other
    columns are ignored. ``path`` and ``pattern`` describe a byte-level vocabulary.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches):
        coder, ranks = encoder(path, pattern)
        width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, number in ranks.items():
            width[number] = len(token)
        names = ["doc_id", "section", "start", "end", "tokens", "crossing", "doc_tokens"]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            done, parts, rows = 0, [], 0
            while done < len(ids):
                text = texts[done].as_py() or ""
                data = np.frombuffer(text.encode(), np.uint8)
                ends = np.cumsum(width[coder.encode_to_numpy(text, disallowed_special=())])
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                edges = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
                place = attribute(starts, ends, edges, rule)
                closes = np.append(edges[1:], len(data))
                crossing = np.bincount(place[ends > closes[place]], minlength=len(edges))
                letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters before each byte
                k = len(edges)
                parts.append((np.full(k, done), np.arange(k), letters[edges], letters[closes], np.bincount(place, minlength=k), crossing, np.full(k, len(ends))))
                rows, done = rows + k, done + 1
                if rows > 50_000 or done == len(ids):
                    columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    doc = pa.array(ids, pa.int64()).take(pa.array(columns[0]))
                    yield pa.RecordBatch.from_arrays([doc, *[pa.array(c.astype(np.int64)) for c in columns[1:]]], names)
                    parts, rows = [], 0

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, section long, start long, end long, tokens long, crossing long, doc_tokens long")

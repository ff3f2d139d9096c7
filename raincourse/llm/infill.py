"""Fill-in-middle transformation over an indexable skip list.

A text is a row of units: a word with the white space before it, or the white space at the end.
Over the borders between units lies a skip list. Lane 0 links each border to the next one; a
border that a hash of its place lifts to height k is in lanes 0 to k. Every link carries two
widths, how many units and how many code points it spans; a lane's widths are sums of those one lane below. A cut at a
rank descends from the head: it follows a lane while the units passed stay within the rank, then
goes one lane down. At lane 0 it stands on the rank exactly, and the code points passed are the place to cut.

The lists of all documents of a slice are built and descended together, in numpy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourse.llm.bytes_hash import U, mix, runs, slices, word_kinds

MARKS = ("<P>", "<S>", "<M>")
LIFT = 2  # hash bits a border spends to reach the next lane: one in four does


def units_of(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a slice: units of each row, and code points of each unit."""
    n = len(rows) - 1
    _, ends, row = runs(word_kinds(data), rows)
    last = np.zeros(n, np.int64)
    np.maximum.at(last, row, ends)
    tail = np.flatnonzero(np.maximum(last, rows[:-1]) < rows[1:])
    ends, row = np.concatenate([ends, rows[tail + 1]]), np.concatenate([row, tail])
    order = np.argsort(ends, kind="stable")
    ends, row = ends[order], row[order]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.bincount(row, minlength=n), np.diff(points[np.concatenate([[0], ends])])


class SkipLists:
    """Skip lists over the unit borders of several documents, each with a head in every lane."""

    def __init__(self, counts: np.ndarray, widths: np.ndarray):
        """``counts``: units of each document; ``widths``: code points of each unit, document after document."""
        heads = np.concatenate([[0], np.cumsum(counts + 1)])[:-1]
        size = int(counts.sum()) + len(counts)
        place = np.arange(size) - np.repeat(heads, counts + 1)
        head = place == 0
        spans = np.zeros(size, np.int64)  # what the link from each border spans; none from a document's last border
        inner = np.ones(size, bool)
        inner[heads + counts] = False
        spans[inner] = widths
        code = mix(place.astype(U))
        lane, self.units, self.points, self.down = np.arange(size), [inner.astype(np.int64)], [spans], [np.arange(size)]
        lanes = [lane]
        while True:
            up = np.flatnonzero(head[lane] | ((code[lane] & U((1 << LIFT * len(lanes)) - 1)) == 0))
            if len(up) in (len(heads), len(lane)):
                break
            self.units.append(np.add.reduceat(self.units[-1], up))
            self.points.append(np.add.reduceat(self.points[-1], up))
            self.down.append(up)
            lane = lane[up]
            lanes.append(lane)
        for borders, units in zip(lanes, self.units, strict=True):  # from a document's last border of a lane no link goes on
            units[np.append(head[borders[1:]], True)[:len(borders)]] = size + 1
        self.top = np.flatnonzero(head[lane])

    def cut(self, document: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code points before the border after ``rank`` units, for each pair of document and rank."""
        at, passed, points = self.top[document], np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for lane in range(len(self.units) - 1, -1, -1):
            units, widths = self.units[lane], self.points[lane]
            moving = np.arange(len(rank))
            while len(moving):
                here = at[moving]
                moving = moving[passed[moving] + units[here] <= rank[moving]]
                here = at[moving]
                passed[moving] += units[here]
                points[moving] += widths[here]
                at[moving] += 1
            if lane:
                at = self.down[lane][at]
        return points


def draws(seed: int, groups: int = 4) -> list[F.Column]:
    """The first 8-digit groups of the hex sha256 of ``seed:doc_id``, as numbers; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(groups)]


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n (units), form, prefix_chars, middle_chars and output.

    ``rate`` percent of the texts are cut at two drawn unit borders; of these ``suffix_first``
    percent become ``<S>``suffix``<P>``prefix``<M>``middle (form spm), the rest
    ``<P>``prefix``<S>``suffix``<M>``middle (psm). Other texts, empty ones and those that contain a
    marker stay as they are: form plain, no lengths. A null text counts as empty. Draws follow the
    id alone, so repeated rows give equal rows; a null id draws as the empty id. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            ids, texts, draw = batch.column(0), batch.column(1), [batch.column(k).to_numpy() for k in range(2, 6)]
            for low, high, data, rows in slices(texts):
                n, widths = units_of(data, rows)
                one, two, h3, h4 = (d[low:high] for d in draw)
                lists = SkipLists(n, widths)
                every = np.arange(high - low)
                first, second = one % (n + 1), two % (n + 1)
                starts, ends = lists.cut(every, np.minimum(first, second)), lists.cut(every, np.maximum(first, second))
                forms, outputs, prefix, middle = [], [], [], []
                for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                    text = texts[low + k].as_py() or ""
                    if not text or h3[k] % 100 >= rate or any(m in text for m in MARKS):
                        form, output, a, b = "plain", text, None, None
                    elif h4[k] % 100 < suffix_first:
                        form, output = "spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
                    else:
                        form, output = "psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
                    forms.append(form)
                    outputs.append(output)
                    prefix.append(a)
                    middle.append(None if a is None else b - a)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(low, high - low), pa.array(n.astype(np.int64)), pa.array(forms, pa.string()),
                    pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(outputs, pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *draws(seed)).mapInArrow(
        run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored() -> F.Column:
    """The text that ``output`` was made of, by ``form``; a cut text holds each marker once."""
    part = F.split("output", "<[PSM]>", -1)
    return (F.when(F.col("form") == "plain", F.col("output"))
            .when(F.col("form") == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1])))

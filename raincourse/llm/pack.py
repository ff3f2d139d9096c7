"""Best-fit packing planned on the histogram of lengths.

A length is at most the capacity, so the histogram has at most 4096 rows. Best fit runs over
counts: bins with the same room are one bundle, and a length fills bundles from the least room
that holds it. The plan says which ranks of a length go to which bundle; pieces find their place
by rank within length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourse.llm.common import rank_within
from raincourse.llm.tokens import WordTokens
from raincourse.session import sized

CAPACITY = 4096
END_ID = 1


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``docs`` (doc_id, text) to its pieces (doc_id, piece, start, length, ids_crc32).

    A null text is empty and gives one piece with only the end id; only documents longer than
    ``capacity`` are cut. Repeated rows give their pieces again; other columns are ignored.
    """

    def run(batches):
        tokens = WordTokens(tokenizer)
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for row, found in enumerate(tokens.batch(batch.column(1))):
                found = np.append(found, end_id).astype("<u4")
                for piece, start in enumerate(range(0, len(found), capacity)):
                    part = found[start:start + capacity]
                    out.append((ids[row], piece, start, len(part), zlib.crc32(part.tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, per sequence, last rank) of a best-fit decreasing packing.

    Rank r of a length, from the first to before the last rank, goes to sequence first +
    (r - first rank) // per sequence, at offset + ((r - first rank) % per sequence) * length.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> bundles of (first sequence, sequences)
    made, rows = 0, []

    def fill(length, rank, left, first, bins, space):
        """Put up to ``left`` items in a bundle; gives how many went in."""
        each = space // length
        used = min(left, bins * each)
        whole, rest = divmod(used, each)
        rows.append((length, rank, first, capacity - space, each, rank + used))
        for at, number, now in ((first, whole, space - each * length), (first + whole, int(rest > 0), space - rest * length), (first + whole + (rest > 0), bins - whole - (rest > 0), space)):
            if number and now:
                room.setdefault(now, []).append((at, number))
        return used

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        for space in sorted(s for s in room if s >= length):
            bundles = room.pop(space)
            while bundles and left:
                first, bins = bundles.pop()
                used = fill(length, rank, left, first, bins, space)
                rank, left = rank + used, left - used
            if bundles:
                room.setdefault(space, []).extend(bundles)
            if not left:
                break
        if left:
            bins = -(-left // (capacity // length))
            fill(length, rank, left, made, bins, capacity)
            made += bins
    return np.array(rows, np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset. No sequence exceeds ``capacity``; offsets have no gaps.

    Rows equal in all columns each get a place of their own. The driver sees only the histogram
    (at most ``capacity`` rows) and the plan, whose size depends on lengths, not on documents.
    """
    pieces = sized(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = plan(histogram, capacity)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    sent = pieces.sparkSession.sparkContext.broadcast(steps)
    names = pieces.columns
    tie = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in names]))
    ranked = rank_within(pieces.withColumn("_tie", tie), ["length"], [], "_tie").drop("_tie")

    def run(batches):
        steps = sent.value
        keys = steps[:, 0] * (1 << 48) + steps[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_rank"))
            step = steps[np.searchsorted(keys, length * (1 << 48) + rank, "right") - 1] if len(rank) else steps[:0]
            turn = rank - step[:, 1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names]
                + [pa.array(step[:, 2] + turn // step[:, 4]), pa.array(step[:, 3] + turn % step[:, 4] * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)

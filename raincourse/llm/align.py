"""Alignment of two tokenizers by pointer jumping.

Both encode the same octets. Every token points to the token of the other side that overlaps it
and reaches farthest right, which is the one that holds its last octet; a token of A that ends
where a token of B ends points to itself. Doubling the pointers (each takes its successor's
successor) until nothing changes leads every token to the last token of its component, which names the
group. All documents of a block are one row of octets, so a block is aligned at once in numpy.

How often two ids are linked is counted over the corpus. A block lists its pairs once and gets
their counts back by block (``blocks``), so neither the documents' links are shuffled
nor the table of counts is sent to every task.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourse.llm.blocks import Numbers, packed, steps, unpacked
from raincourse.llm.bytes_hash import slices
from raincourse.llm.tokens import byte_alphabet
from raincourse.session import sized

BLOCK = 2 << 20
PAIR = 1 << 31  # a pair of ids as one number: a * PAIR + b


class ByteTokens:
    """A byte-level tokenizer file of library tokenizers; the same merges run in tiktoken, which is faster."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["id"] for t in model.get("added_tokens", [])}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): number for token, number in model["model"]["vocab"].items() if number not in special}
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, number in ranks.items():
            self.width[number] = len(token)
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class PieceTokens:
    """A sentencepiece model with byte fallback; it puts a space before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.width = np.array([len(p) for p in self.pieces], np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Ends:
    """Where the tokens of one side end on a row of octets, to be looked up by octet."""

    def __init__(self, ends: np.ndarray, size: int):
        self.at = np.zeros(size + 1, bool)
        self.at[ends] = True
        self.rank = np.cumsum(self.at, dtype=np.int32) - self.at

    def holder(self, end: np.ndarray) -> np.ndarray:
        """The token that holds the last octet before each ``end``."""
        return self.rank[end].astype(np.int64)


def jump(ends_a: np.ndarray, ends_b: np.ndarray, a: Ends, b: Ends) -> tuple[np.ndarray, np.ndarray]:
    """Group (from 0, left to right) of each token of A and of B, given where they end on one row of octets."""
    n = len(ends_a)
    last = b.at[ends_a]
    to = np.concatenate([np.where(last, np.arange(n), n + b.holder(ends_a)), a.holder(ends_b)])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        to = further
    group = np.cumsum(last) - 1
    return group[to[:n]], group[to[n:]]


def decimals(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Digits of 0 to ``size`` - 1 from the left, with one free place after them, and how many there are."""
    texts = np.array([str(k) for k in range(size)], "S")
    width = texts.dtype.itemsize + 1
    return np.ascontiguousarray(np.array(texts, f"S{width}")).view(np.uint8).reshape(size, width), np.char.str_len(texts)


def written(ids_a, ids_b, groups_a, groups_b, doc_of_group, digits, lengths):
    """``a1,a2|b1;a3|b2,b3`` of all documents as octets, and how many octets each token takes, in order of writing, with its document."""
    count = len(doc_of_group)
    before_b = np.concatenate([[0], np.cumsum(np.bincount(groups_b, minlength=count))])
    before_a = np.concatenate([[0], np.cumsum(np.bincount(groups_a, minlength=count))])
    at_a, at_b = np.arange(len(ids_a)) + before_b[groups_a], np.arange(len(ids_b)) + before_a[groups_b + 1]
    n = len(ids_a) + len(ids_b)
    ids, group, side = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, bool)
    ids[at_a], ids[at_b], group[at_a], group[at_b], side[at_b] = ids_a, ids_b, groups_a, groups_b, True
    doc = doc_of_group[group]
    mark = np.full(n, ord(","), np.uint8)
    mark[:-1][side[1:] != side[:-1]] = ord("|")
    mark[:-1][group[1:] != group[:-1]] = ord(";")
    closes = np.ones(n, bool)
    closes[:-1] = doc[1:] != doc[:-1]
    rows, length = digits[ids], lengths[ids]
    rows[np.arange(n), length] = mark
    length = length + ~closes
    return rows[np.arange(rows.shape[1]) < length[:, None]], length, doc


def aligned(docs: DataFrame, path_a: str, pattern: str, path_b: str, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text) to one row per row with the groups of both tokenizers' tokens.

    Columns: doc_id, n_a, n_b, n_groups, n_links and ``groups``, the ids of A and B of each group in
    order. A text that is null or empty, or whose tokens do not give back its octets with a space
    before them, has no tokens: zeros and an empty string. For ``count_links`` there are
    also block, places and times (the pairs that the document links, as places in the block's
    list, and how often) and, on one row of each block, the list itself as pairs and sums.
    Repeated rows give equal groups; other columns are ignored.
    """

    def run(batches):
        a, b, number = ByteTokens(path_a, pattern), PieceTokens(path_b), Numbers()
        digits, lengths = decimals(max(len(a.width), len(b.width)))
        for batch in batches:
            for low, high, _, _ in slices(batch.column(1), block):
                m = high - low
                texts = [t or "" for t in batch.column(1).slice(low, m).to_pylist()]
                side_a, side_b = [], []
                for text, two in zip(texts, b.ids(texts), strict=True):
                    whole = b" " + text.encode()
                    one = a.ids(" " + text) if text and b"".join([b.pieces[k] for k in two]) == whole else np.zeros(0, np.int64)
                    one = one if a.width[one].sum() == len(whole) else one[:0]
                    side_a.append(one)
                    side_b.append(np.array(two if len(one) else [], np.int64))
                n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (side_a, side_b))
                ids_a, ids_b = np.concatenate(side_a), np.concatenate(side_b)
                ends_a, ends_b = np.cumsum(a.width[ids_a]), np.cumsum(b.width[ids_b])
                size = int(ends_a[-1]) if len(ends_a) else 0
                on_a, on_b = Ends(ends_a, size), Ends(ends_b, size)
                doc_a = np.repeat(np.arange(m), n_a)
                groups_a, groups_b = jump(ends_a, ends_b, on_a, on_b)
                doc_of_group = doc_a[on_b.at[ends_a]]
                data, length, doc = written(ids_a, ids_b, groups_a, groups_b, doc_of_group, digits, lengths)
                edges = np.concatenate([[0], np.cumsum(np.bincount(doc, length, m))]).astype(np.int32)
                names = pa.StringArray.from_buffers(m, pa.py_buffer(edges), pa.py_buffer(data))
                # A link is a stretch between neighbouring token ends; no two stretches hold the same two tokens.
                cuts = np.flatnonzero(on_a.at | on_b.at)
                first = on_a.holder(cuts)
                doc_of_link, wide = doc_a[first], len(b.width)
                held, times = np.unique((doc_of_link * len(a.width) + ids_a[first]) * wide + ids_b[on_b.holder(cuts)], return_counts=True)
                owner, held = np.divmod(held, len(a.width) * wide)
                pairs, held = np.unique(held, return_inverse=True)
                bounds = np.searchsorted(owner, np.arange(m + 1))
                spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
                lists = [(pairs // wide * PAIR + pairs % wide).tolist(), np.bincount(held, times, len(pairs)).astype(np.int64).tolist()]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, m), pa.array(n_a), pa.array(n_b), pa.array(np.bincount(doc_of_group, minlength=m)),
                    pa.array(np.bincount(doc_of_link, minlength=m)), names, pa.array(np.full(m, number())),
                    pa.array([packed(steps(held[x:y])) for x, y in spans], pa.binary()), pa.array([packed(times[x:y]) for x, y in spans], pa.binary()),
                    *[pa.array([x] + [None] * (m - 1), pa.list_(pa.int64())) for x in lists]],
                    ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "block", "places", "times", "pairs", "sums"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, block long, places binary, times binary, pairs array<long>, sums array<long>")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, count, best): links of each pair of ids in all ``rows`` of ``aligned``, and whether no pair with that id of B has more."""
    lists = rows.where("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", "sums")))
    counts = sized(lists.groupBy(F.col("pairs").alias("pair")).agg(F.sum("sums").alias("count")), "pairs")
    of_b = (F.col("pair") % PAIR).alias("b")
    most = counts.groupBy(of_b).agg(F.max("count").alias("most"))  # a row for each id of B at most, so it may be broadcast
    return counts.withColumn("b", of_b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def count_links(rows: DataFrame) -> DataFrame:
    """``rows`` of ``aligned``, kept in a table, with n_best and count_sum in place of the block columns.

    n_best: links of the document whose pair is as frequent as any with its id of B, ties included;
    count_sum: the corpus-wide counts of its links added up.
    """
    keep = [c for c in rows.columns if c not in ("block", "places", "times", "pairs", "sums")]
    lists = rows.where("pairs IS NOT NULL").select(F.col("block").alias("home"), F.posexplode("pairs").alias("place", "pair"))
    answers = lists.join(sized(pair_counts(rows), "counts"), "pair").select("home", "place", "count", "best")

    def finish(docs: pa.Table, found: pa.Table) -> pa.Table:
        places = found["place"].to_numpy()
        count, best = np.zeros(len(places), np.int64), np.zeros(len(places), bool)
        count[places], best[places] = found["count"].to_numpy(), found["best"].to_numpy()
        n_best, sums = [], []
        for held, times in zip(docs["places"], docs["times"], strict=True):
            at, times = np.cumsum(unpacked(held.as_py())), unpacked(times.as_py())
            n_best.append(int(times[best[at]].sum()))
            sums.append(int((times * count[at]).sum()))
        return docs.select(keep).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    docs = rows.select(*keep, "block", "places", "times")
    return docs.groupBy("block").cogroup(answers.groupBy("home")).applyInArrow(finish, f"{fields}, n_best long, count_sum long")

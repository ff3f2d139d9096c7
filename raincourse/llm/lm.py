"""Log-likelihood of documents under a recurrent language model trained on the corpus.

Tokens are words in lower case (A-Z) and one end for each document. Counts of all words come from
all training documents. The most frequent words are listed: the network (``recurrent``) names them. Every other
word belongs to a tail class by its last octet; the network predicts the class, and the counts
share its probability among the words of the class and one word never seen. So each
text has a proper probability, whatever its words.

Weights start at the listed words' shares, then from a bounded number of documents, then each task trains on
its part of the training documents and the parts are averaged, once for a quarter of the documents
and once for the rest: every training document is learned from once. Counts of words that are not listed reach the
documents by block (``blocks``), so no task holds the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourse.llm.blocks import Numbers, packed, unpacked
from raincourse.llm.bytes_hash import lowered, slices, word_kinds
from raincourse.llm.learn import drawn, remainder
from raincourse.llm.recurrent import END, Shape, Trainer, document_scores, start_weights
from raincourse.session import sized

BLOCK = 8 << 20
WARM = 256  # documents of the first step of training
ROUNDS = ((0, 16, 0.006), (16, 64, 0.003))  # of 64 parts by hash: from, to, rate
PIECE = 2048


def words_of(data: np.ndarray, rows: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Of a slice: its words in lower case, document after document, as a dictionary array, and how many each row has."""
    text = lowered(data)
    inside, first = word_kinds(text).view(bool), rows[:-1][rows[:-1] < len(data)]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[first] = inside[first]
    end[:-1] &= ~inside[1:]
    end[first[first > 0] - 1] = inside[first[first > 0] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(text[inside])])
    return words.dictionary_encode(), np.diff(np.searchsorted(starts, rows))


def with_ends(values: np.ndarray, counts: np.ndarray, end) -> np.ndarray:
    """``values`` of each document's words followed by ``end``."""
    out = np.full(len(values) + len(counts), end, np.int64)
    out[np.arange(len(values)) + np.repeat(np.arange(len(counts)), counts)] = values
    return out


def tail_class(word: str = "word") -> F.Column:
    """Number of a word's tail class by its last octet, out of as many as the shape has; see ``symbols_of``."""
    return F.conv(F.hex(F.substring(F.col(word).cast("binary"), -1, 1)), 16, 10).cast("int")


@dataclass
class Model:
    """``counts``: table (word, c) of the training documents, a null word for their ends. The arrays are of bounded size."""

    shape: Shape
    counts: DataFrame
    listed: list[str]
    listed_counts: np.ndarray  # of END, then of ``listed``
    tokens: int
    types: int
    tail_tokens: np.ndarray
    tail_types: np.ndarray
    weights: np.ndarray

    def base(self, c):
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.types + 1)))

    def within(self, c, tail):
        return np.log10((c + 0.1) / (self.tail_tokens[tail] + 0.1 * (self.tail_types[tail] + 1)))


def symbols_of(dictionary: pa.Array, listed: pa.Array, shape: Shape) -> np.ndarray:
    """Symbol of each word of a dictionary."""
    known = pc.fill_null(pc.index_in(dictionary, value_set=listed), -1).to_numpy() + 1
    edges, data = np.frombuffer(dictionary.buffers()[1], np.int64)[dictionary.offset:dictionary.offset + len(dictionary) + 1], dictionary.buffers()[2]
    last = np.frombuffer(data, np.uint8)[edges[1:] - 1].astype(np.int64) if len(dictionary) else np.zeros(0, np.uint8)
    return np.where(known > 0, known, shape.listed + last % shape.tails)


def encoded(batches, listed: list[str], shape: Shape, block: int):
    """Of each slice of (text, ...) batches: batch, first row, end row, symbols, words a row, the dictionary, its symbols and the words' places in it."""
    known = pa.array(listed, pa.large_string())
    for batch in batches:
        for low, high, data, rows in slices(batch.column(0), block):
            words, counts = words_of(data, rows)
            of_word = symbols_of(words.dictionary, known, shape)
            place = words.indices.to_numpy()
            yield batch, low, high, with_ends(of_word[place], counts, END), counts, words.dictionary, of_word, place


def word_counts(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, c) over all ``texts`` (text); the null word counts the documents."""

    def run(batches):
        for batch in batches:
            for low, high, data, rows in slices(batch.column(0), block):
                words, _ = words_of(data, rows)
                n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([words.dictionary.cast(pa.string()), pa.array([None], pa.string())]), pa.array(np.append(n, high - low).astype(np.int64))], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))


def averaged(parts: DataFrame, size: int) -> np.ndarray | None:
    """Mean of weights by the tokens they saw, from rows (piece, seen, w); pieces of equal number are added in one task, a batch at a time."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        seen: dict[int, int] = {}
        for batch in batches:
            for piece, n, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[piece] = sums.get(piece, 0) + n * np.frombuffer(w, np.float32).astype(np.float64)
                seen[piece] = seen.get(piece, 0) + n
        done = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32()), pa.array([(sums[k] / seen[k]).astype(np.float32).tobytes() for k in done], pa.binary())], ["piece", "w"])

    found = parts.repartition(F.col("piece")).mapInArrow(run, "piece int, w binary").collect()  # as many rows as pieces
    return np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(found, key=lambda r: r["piece"])]) if found else None


def train(docs: DataFrame, shape: Shape = Shape(), warm: int = WARM, rounds=ROUNDS, block: int = BLOCK) -> Model:
    """A model of all ``docs`` (doc_id, text). Without any, or with only empty texts, it knows the ends alone."""
    spark, docs = docs.sparkSession, docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = sized(word_counts(docs, block), "words")
    listed = counts.where("word IS NOT NULL").orderBy(F.desc("c"), "word").limit(shape.listed - 1).collect()
    ends = counts.where("word IS NULL").select("c").first()
    tokens, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tails = counts.where("word IS NOT NULL").groupBy((tail_class() % shape.tails).alias("tail")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    tail_tokens, tail_types = np.zeros(shape.tails), np.zeros(shape.tails)
    for r in tails:
        tail_tokens[r["tail"]], tail_types[r["tail"]] = r["c"], r["n"]
    for r in listed:
        tail = r["word"].encode()[-1] % shape.tails
        tail_tokens[tail] -= r["c"]
        tail_types[tail] -= 1
    own = np.full(shape.listed, -1.0)
    own[:len(listed) + 1] = [ends["c"] if ends else 0, *[r["c"] for r in listed]]
    names, weights = [r["word"] for r in listed], start_weights(shape, np.concatenate([own, tail_tokens]))
    if ends:
        some = docs.where(drawn(F.lit(min(1.0, warm / ends["c"])), "doc_id", "text")).repartition(1).sortWithinPartitions("doc_id", "text")
        weights = _trained(some, names, shape, weights, 0.01, 16, block, weights)
        for low, high, rate in rounds:
            part = F.pmod(F.xxhash64(F.lit("part"), "doc_id", "text"), F.lit(64))
            weights = _trained(docs.where((part >= low) & (part < high)), names, shape, weights, rate, 192, block, weights)
    return Model(shape, counts, names, own[:len(names) + 1], tokens, types, tail_tokens, tail_types, weights)


def _trained(docs: DataFrame, listed: list[str], shape: Shape, weights: np.ndarray, rate: float, lanes: int, block: int, otherwise: np.ndarray) -> np.ndarray:
    sent = docs.sparkSession.sparkContext.broadcast((listed, weights))

    def run(batches):
        names, flat = sent.value
        trainer = Trainer(shape, flat, rate, lanes=lanes)
        for _, _, _, symbols, counts, *_ in encoded(batches, names, shape, block):
            trainer.learn(symbols, counts + 1)
        if trainer.seen:
            cut = [trainer.flat[k:k + PIECE].tobytes() for k in range(0, len(flat), PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut)), pa.int32()), pa.array([trainer.seen] * len(cut), pa.int64()), pa.array(cut, pa.binary())], ["piece", "seen", "w"])

    found = averaged(docs.select("text").mapInArrow(run, "piece int, seen long, w binary"), shape.total)
    return otherwise if found is None else found


def score(docs: DataFrame, model: Model, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_tokens, n_known, train_tokens, base_score and score.

    Scores are log10 probabilities of the whole text with its end: base_score by the counts alone,
    score by the network. A null or empty text is its end. Repeated rows score alike up to rounding;
    other columns are ignored; a null id is kept.
    """
    shape, listed_counts = model.shape, model.listed_counts
    sent = docs.sparkSession.sparkContext.broadcast((model.listed, model.weights))
    head_base, head_known = model.base(np.maximum(listed_counts, 0)), listed_counts > 0

    def run(batches):
        (names, flat), number = sent.value, Numbers()
        for batch, low, high, symbols, counts, dictionary, of_word, place in encoded(batches, names, shape, block):
            m, n = high - low, counts + 1
            doc = np.repeat(np.arange(m), n)
            net = document_scores(shape, flat, symbols, n) / np.log(10)
            head = symbols < shape.listed
            base = np.bincount(doc[head], head_base[symbols[head]], m)
            known = np.bincount(doc[head], head_known[symbols[head]], m).astype(np.int64)
            # Words of the tail get their own places in the block's list.
            tail = np.flatnonzero(of_word >= shape.listed)
            own = np.full(len(of_word), -1)
            own[tail] = np.arange(len(tail))
            mine = own[place]
            owner = np.repeat(np.arange(m), counts)[mine >= 0]
            held, times = np.unique(owner * max(1, len(tail)) + mine[mine >= 0], return_counts=True)
            owner, held = np.divmod(held, max(1, len(tail)))
            bounds = np.searchsorted(owner, np.arange(m + 1))
            step = np.diff(held, prepend=0)  # places of each document as differences, which are small
            begin = bounds[:-1][np.diff(bounds) > 0]
            step[begin] = held[begin]
            spans = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            words = pa.ListArray.from_arrays(np.array([0] + [len(tail)] * m, np.int32), dictionary.take(pa.array(tail)).cast(pa.string()), mask=pa.array(np.arange(m) > 0))
            yield pa.RecordBatch.from_arrays([
                batch.column(1).slice(low, m), pa.array(n.astype(np.int64)), pa.array(known), pa.array(base), pa.array(net), pa.array(np.full(m, number())),
                pa.array([packed(step[x:y]) for x, y in spans], pa.binary()), pa.array([packed(times[x:y]) for x, y in spans], pa.binary()),
                words, pa.array([packed(of_word[tail] - shape.listed)] + [None] * (m - 1), pa.binary())],
                ["doc_id", "n_tokens", "known", "base", "net", "block", "places", "times", "words", "tails"])

    rows = sized(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(
        run, "doc_id long, n_tokens long, known long, base double, net double, block long, places binary, times binary, words array<string>, tails binary"), "scored")
    lists = rows.where("words IS NOT NULL").select(F.col("block").alias("home"), F.posexplode("words").alias("place", "word"))
    # A word that no training document has gets no answer: its count is 0.
    answers = lists.join(model.counts.where("word IS NOT NULL").hint("shuffle_hash"), "word").select("home", "place", "c")
    tokens, types, tail_tokens, tail_types = model.tokens, model.types, model.tail_tokens, model.tail_types
    small = Model(shape, None, [], None, tokens, types, tail_tokens, tail_types, None)

    def finish(docs: pa.Table, found: pa.Table) -> pa.Table:
        tails = np.concatenate([unpacked(t) for t in docs["tails"].to_pylist() if t is not None])
        c = np.zeros(len(tails), np.int64)
        c[found["place"].to_numpy()] = found["c"].to_numpy()
        table = np.stack([small.base(c), small.within(c, tails), c > 0], axis=1)
        sums = [unpacked(t) @ table[np.cumsum(unpacked(p))] for p, t in zip(docs["places"].to_pylist(), docs["times"].to_pylist(), strict=True)]
        base, net, known = np.array(sums).reshape(-1, 3).T
        return pa.table({"doc_id": docs["doc_id"], "n_tokens": docs["n_tokens"], "n_known": pa.array(docs["known"].to_numpy() + known.astype(np.int64)),
                         "train_tokens": pa.array(np.full(len(base), tokens)), "base_score": pa.array(docs["base"].to_numpy() + base), "score": pa.array(docs["net"].to_numpy() + net)})

    return rows.drop("words").groupBy("block").cogroup(answers.groupBy("home")).applyInArrow(
        finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out(parts: int = 10) -> F.Column:
    return remainder("doc_id", parts) == 0

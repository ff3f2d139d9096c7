"""Mixing sources to target weights by systematic sampling, in column expressions only.

Every document of a source has the same expected number of copies, target / size of the source.
Prefix sums of it over the documents in order of size, shifted by one offset per source, cross
whole numbers; each crossing emits the document once. Ordered by size, neighbours that share a
copy are about equally long, so the words taken stay within about one document of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raincourse.llm.common import WORD, rank_within
from raincourse.session import sized

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size); one row per source, null last.

    Targets are the least of ``most`` * size and level * weight, with the one level at which they
    add up to ``share`` of all words: what repeated sharing of the excess comes to. The windows
    without partitions hold one row per source.
    """
    per = sized(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level)
    # Sources are filled in order of cap / weight; from the first whose cap is not reached the level holds for the rest.
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    per = per.withColumn("final", F.first(fits, ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, 0)))
    return sized(per.select("source", "source_size", F.coalesce(F.least(F.col("final") * F.col("w"), F.col("cap")), "cap").alias("target")), "targets")


def mixed(docs: DataFrame, seed: str = "mix", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``docs`` (doc_id, text, source) with all its columns in struct ``row``, and size, source_size, target, copies.

    A null or empty text has size 0 and takes nothing but may be emitted; rows equal in id and
    text may swap their copies; a null source is a source of its own; a source without words has
    target 0. Reruns agree. An empty table gives an empty result. Other columns ride in ``row``,
    so their names clash with nothing.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    tie = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(text.cast("binary"))))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), tie.alias("tie"))
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    return _emit(rows.withColumn("key", key), source_targets(rows.select("source", "size"), weights, share, most), seed)


def _emit(rows: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 8), 16, 10).cast("double") / float(1 << 32)
    targets = targets.select(key.alias("key"), "source_size", "target", offset.alias("offset"))
    ranked = rank_within(rows, ["key"], ["size"], "tie")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor((F.col("_rank") + 1) * rate + F.col("offset")) - F.floor(F.col("_rank") * rate + F.col("offset"))
    return ranked.join(targets, "key").select("row", "size", "source_size", "target", crossed.alias("copies"))


def emit_copies(mix: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns it came with."""
    return mix.where("copies > 0").select(F.explode(F.expr("array_repeat(row, int(copies))")).alias("row")).select("row.*")

"""Filters that leave one row of each group of copies, with whatever columns the rows have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourse.llm import exact_dedup, minhash
from raincourse.session import sized


def keep_one_copy(docs: DataFrame, index: str) -> DataFrame:
    """One row of each text of ``docs``, by the digest table ``index``: the one with the largest doc_id.

    A null text counts as empty, a null doc_id comes after all others; of rows that repeat id and
    text one stays, whichever it is. Columns are those of ``docs``, whatever their names; an empty table stays empty.
    """
    groups = exact_dedup.dedup(exact_dedup.digests_of(docs), index).where("kept").select("digest", F.col("keep_id").alias("keep")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), exact_dedup.text_digest().alias("text_digest"))
    stays = rows.join(groups, (F.col("text_digest") == groups.digest) & F.col("row.doc_id").eqNullSafe(groups.keep))
    return stays.select("row", "text_digest").dropDuplicates(["text_digest"]).select("row.*")


def keep_one_of_near(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row of each group of near copies among ``docs`` (doc_id, text): the one with the least doc_id.

    A null doc_id comes after all others, rows that share the least id go by their word sequence,
    and of those with the same words the least digest stays. Null and empty texts and texts without words
    all stay. Columns are those of ``docs``, whatever their names; an empty table stays empty.
    """
    marks = sized(minhash.near_rows(docs.select("doc_id", "text"), percent).where("cls IS NOT NULL").select("root", "doc_id", "cls"), "marks")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "cls")
    best = sized(marks.groupBy("root").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "best"), "best")
    # Of groups with more than one row: each (id, words), whether it stays, and on how many rows it stands.
    each = marks.join(best, "root").groupBy(F.col("doc_id").alias("id"), F.col("cls").alias("of")).agg(
        F.first(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("cls") == F.col("best.cls"))).alias("stays"), F.count(F.lit(1)).alias("n"))
    each = sized(each.where("NOT stays OR n > 1"), "marks")
    rows = minhash.with_class(docs.select("text", F.struct(*docs.columns).alias("row")), "words_of").select("words_of", "row")
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("words_of") == F.col("of"))
    left = rows.join(each.select("id", "of"), same, "left_anti").select("row.*")
    several = rows.join(each.where("stays").select("id", "of"), same).groupBy("words_of").agg(F.min_by("row", F.struct(F.sha2("row.text", 256), F.to_json("row"))).alias("row"))
    return left.union(several.select("row.*"))

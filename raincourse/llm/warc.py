"""Fixity audit of WARC replicas with Merkle trees, in column expressions.

Records of a file, in order, are the leaves: SHA-256 of the record with its offset range. Each
level above hashes up to ``FANOUT`` neighbours and covers their range, up to one root per file. Two
replicas are compared from the roots down; a step joins only children of nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from raincourse.session import sized

FANOUT = 16
RECORDS = 1_024
DATE = "2024-01-01T00:00:00Z"


def response_records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``pages`` (page_id, url, html) to (page_id, record), record the octets of a WARC/1.1 response.

    A null url is written as an empty target, a null html as an empty body. The record id is made
    from the page id, so reruns give the same octets.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    block = F.concat(http, body)
    mark = F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).cast("binary"))
    name = F.concat_ws("-", *[F.substring(mark, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:"), name, F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
                    F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
                    F.octet_length(block).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    return pages.select("page_id", F.concat(head, block, F.lit("\r\n\r\n").cast("binary")).alias("record"))


def place(records: DataFrame, files: int) -> DataFrame:
    """Leaves (file, at, page_id, start, length, body, hash) of records dealt to ``files`` by a hash of page_id.

    Only lengths and hashes are sorted, per file. Records with equal ids follow each other by hash.
    """
    mark = F.conv(F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("long")
    leaves = records.select((mark % files).alias("file"), "page_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("body"))
    order = Window.partitionBy("file").orderBy(F.col("page_id").isNull(), "page_id", "body")
    leaves = leaves.select("file", (F.row_number().over(order) - 1).cast("long").alias("at"), "page_id", (F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")).alias("start"), "length", "body")
    return leaves.select("file", "at", "page_id", "start", "length", "body", F.sha2(F.concat_ws(":", "start", "length", "body"), 256).alias("hash"))


def tree(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the leaves to one node per file, each (file, at, start, length, hash), written to the shared folder."""
    levels = [sized(leaves, "leaves")]
    top = levels[0].agg(F.max("at")).first()[0]
    while top:
        down = levels[-1]
        up = (down.groupBy("file", F.floor(F.col("at") / fanout).alias("at"))
              .agg(F.min("start").alias("start"), F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("at", "hash"))).alias("kids"))
              .select("file", "at", "start", "length", F.sha2(F.array_join(F.col("kids.hash"), ""), 256).alias("hash")))
        levels.append(sized(up, "nodes"))
        top //= fanout
    return levels


def audit(first: list[DataFrame], second: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Records that differ: kind, file, at, page_id, start, length, expected, found.

    Roots are compared first; below them only children of differing nodes are read on. A record that is missing or
    of another length moves all later ones of its file, so their leaves differ as well: suspect leaves are
    matched by id and content first, and what only moved is not reported. The rest is matched
    by id: kind is ``changed``, or ``missing`` (found is null) or ``added`` (expected is null) where
    only one replica has the record; places are those of the first replica if it has it. Trees of
    different height are compared from the lower top. Equal replicas give an empty result.
    """
    if len(first) != len(second):
        height = min(len(first), len(second))
        first, second = first[:height], second[:height]
    suspects = None
    for level in range(len(first) - 1, -1, -1):
        a, b = ((side[level] if suspects is None else side[level].withColumn("up", F.floor(F.col("at") / fanout)).join(suspects, ["file", "up"], "left_semi")) for side in (first, second))
        if level == 0:
            return unmatched(a, b)
        a, b = (side.select("file", "at", F.col("hash").alias(tag)) for side, tag in ((a, "x"), (b, "y")))
        suspects = sized(a.join(b, ["file", "at"], "full").where(~F.col("x").eqNullSafe(F.col("y"))).select("file", F.col("at").alias("up")), "suspects")
    raise ValueError("a tree has at least its leaves")


def unmatched(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves of ``a`` and ``b`` without a partner of equal id and content in the other, paired by id where both have one."""
    def numbered(side: DataFrame, name: str, *keys: str) -> DataFrame:
        return side.withColumn(name, F.row_number().over(Window.partitionBy("file", "page_id", *keys).orderBy("at")))

    def paired(*keys: str):
        return [F.col("x.file") == F.col("y.file"), F.col("x.page_id").eqNullSafe(F.col("y.page_id")), *[F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys]]

    a, b = (sized(numbered(side.select("file", "at", "page_id", "start", "length", "body", "hash"), "copy", "body"), "suspect-leaves") for side in (a, b))
    only_a = a.alias("x").join(b.alias("y"), paired("body", "copy"), "left_anti")
    only_b = b.alias("x").join(a.alias("y"), paired("body", "copy"), "left_anti")
    both = numbered(only_a, "turn").alias("x").join(numbered(only_b, "turn").alias("y"), paired("turn"), "full")
    kind = F.when(F.col("y.hash").isNull(), "missing").when(F.col("x.hash").isNull(), "added").otherwise("changed")
    return both.select(kind.alias("kind"), *[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("file", "at", "page_id", "start", "length")],
                       F.col("x.hash").alias("expected"), F.col("y.hash").alias("found"))


def audit_replicas(first: DataFrame, second: DataFrame, per_file: int = RECORDS) -> DataFrame:
    """Differing records of two replicas given as (page_id, record), files of about ``per_file`` records."""
    files = max(1, -(-first.count() // per_file))
    return audit(tree(place(first, files)), tree(place(second, files)))

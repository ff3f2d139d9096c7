"""Embedding near-dedup with a forest of random-projection trees.

Equal vectors of a label are one class first. Every tree splits at the median of a random
projection, again and again; vectors within ``SPILL`` of a split go to both sides. The upper
splits are fitted on a bounded sample; a leaf that still holds more than ``LEAF`` classes is split
further on all its rows, and one that cannot be split is compared block by block. Vectors are
compared inside leaves, exactly. A pair that shares several leaves counts in the one with the least
name only, so links are counted without listing pairs; each leaf gives at most one edge per
vector to its local root. A vector carries the names of its leaves, not those of their blocks, so a row is
as wide in a dense cluster as elsewhere; a pair of one block counts where the block meets itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raincourse.llm.common import components
from raincourse.session import sized

TREES = 8
SPILL = 0.02
SHARED = 0.9  # a leaf with a side of a larger share is not split
SAMPLE = 16_384
FEWEST = 24
DEPTH = 12
LEAF = 2_048
ROUNDS = 24


def _normals(seed: int | list[int], dims: int) -> np.ndarray:
    normal = np.random.default_rng(seed).standard_normal(dims)
    return normal / np.linalg.norm(normal)


def fit(sample: np.ndarray, trees: int = TREES) -> list[list[tuple]]:
    """For each tree its nodes (normal, threshold, left, right); a leaf is -1 - its number."""
    forest = []
    for tree in range(trees):
        nodes, leaves = [], 0

        def grow(rows, depth, seed):
            nonlocal leaves
            normal = _normals(seed, sample.shape[1])
            at = sample[rows] @ normal
            middle = float(np.median(at)) if len(rows) else 0.0
            left, right = rows[at < middle + SPILL], rows[at >= middle - SPILL]
            if len(rows) <= FEWEST or depth == DEPTH or max(len(left), len(right)) > SHARED * len(rows):
                leaves += 1
                return -leaves
            here = len(nodes)
            nodes.append(None)
            nodes[here] = (normal.astype(np.float32), middle, grow(left, depth + 1, 2 * seed), grow(right, depth + 1, 2 * seed + 1))
            return here

        grow(np.arange(len(sample)), 0, (tree + 1) << (DEPTH + 1))
        forest.append(nodes)
    return forest


def route(x: np.ndarray, forest: list) -> list[tuple[np.ndarray, int]]:
    """(rows, code) of each leaf that rows of ``x`` reach."""
    out = []
    for tree, nodes in enumerate(forest):
        todo = [(0 if nodes else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if len(rows) == 0:
                continue
            if node < 0:
                out.append((rows, tree << 32 | -node))
                continue
            normal, middle, left, right = nodes[node]
            at = x[rows] @ normal.astype(np.float64)
            todo += [(left, rows[at < middle + SPILL]), (right, rows[at >= middle - SPILL])]
    return out


def unit(column: pa.Array, dims: int | None = None) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least reachable number of each of ``n`` nodes over the edges i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, i, low)
        np.minimum.at(now, j, low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def compare_leaf(table: pa.Table, threshold: float) -> pa.Table:
    """Links inside one leaf: for each class with links its count of linked vectors that count here, and its local root."""
    table = table.combine_chunks().sort_by("cid")
    cids, label = table["cid"].combine_chunks(), table["label"].to_numpy()
    weight, leaf = table["n"].to_numpy(), table["leaf"][0].as_py()
    block, alone = table["block"].to_numpy(), table["alone"][0].as_py()
    x = unit(table["embedding"].combine_chunks())
    m, step, found = len(x), max(1, (1 << 22) // max(1, len(x))), []
    for low in range(0, m, step):
        i, j = np.nonzero((x[low:low + step] @ x.T >= threshold) & (label[low:low + step, None] == label[None, :]))
        keep = i + low < j
        found.append((i[keep] + low, j[keep]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    lists = table["codes"].combine_chunks()
    owner = np.repeat(np.arange(m), np.diff(lists.offsets.to_numpy()))
    codes = lists.flatten().to_numpy()
    owner, codes = owner[codes < leaf], codes[codes < leaf]
    mine = alone | (block[i] != block[j])
    if len(codes) and len(i):
        names, place = np.unique(codes, return_inverse=True)
        shared = np.zeros((m, len(names)), bool)
        shared[owner, place] = True
        for low in range(0, len(i), 1 << 16):
            part = slice(low, low + (1 << 16))
            mine[part] &= ~(shared[i[part]] & shared[j[part]]).any(axis=1)
    linked = np.bincount(i[mine], weight[j[mine]], m) + np.bincount(j[mine], weight[i[mine]], m)
    root = roots(m, i, j)
    some = np.flatnonzero(np.bincount(np.concatenate([i, j]), minlength=m))
    return pa.table({"cid": cids.take(pa.array(some)), "linked": pa.array(linked[some].astype(np.int64)), "root": cids.take(pa.array(root[some]))})


def _leaves(classes: DataFrame) -> DataFrame:
    """(cid, code) of every leaf of every class, spill included."""

    rows = classes.orderBy("h", "cid").limit(SAMPLE).select("embedding", "dims").toArrow().combine_chunks()
    forests = {}
    for dims in sorted(set(rows["dims"].to_pylist())):
        part = rows.filter(pa.compute.equal(rows["dims"], dims))
        forests[dims] = fit(unit(part["embedding"].combine_chunks()))
    sent = classes.sparkSession.sparkContext.broadcast(forests)

    def run(batches):
        forests = sent.value
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                for rows, code in route(unit(part.column(1)), forests.get(d, [[]] * TREES)):
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), code | (int(d) & 0xFFFF) << 40))], ["cid", "code"])

    return classes.select("cid", "embedding", "dims").mapInArrow(run, "cid string, code long")


def _whole(leaves: DataFrame) -> DataFrame:
    """Leaves that one task compares: the group ``code`` is the leaf."""
    return leaves.select("cid", "code", F.col("code").alias("leaf"), F.lit(0).alias("block"), F.lit(True).alias("alone"))


def _block_pairs(leaves: DataFrame, leaf: int) -> DataFrame:
    """Leaves (cid, code, m classes) dealt to blocks by hash; the group ``code`` is a pair of blocks, ``alone`` a block with itself."""
    blocks = F.ceil(2 * F.col("m") / leaf).cast("int")
    rows = leaves.select("cid", "code", blocks.alias("blocks"), F.pmod(F.xxhash64("cid"), blocks).cast("int").alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("code", F.lit("block"), F.least("block", "other"), F.greatest("block", "other"))
    return rows.select("cid", pair.alias("code"), F.col("code").alias("leaf"), "block", (F.col("block") == F.col("other")).alias("alone"))


def _split_crowded(leaves: DataFrame, classes: DataFrame, leaf: int, rounds: int = ROUNDS) -> DataFrame:
    """Leaves of more than ``leaf`` classes split at exact row counts, level by level; the rest dealt to block pairs.

    Rows (cid, code of the group that is compared, leaf, block, alone). A leaf goes to block pairs when a
    split would leave nearly all of it on one side, or after ``rounds`` splits.
    """
    kept = None
    for turn in range(rounds + 1):
        sizes = leaves.groupBy("code").agg(F.count(F.lit(1)).alias("m"))
        crowded = sized(sizes.where(F.col("m") > leaf), "crowded")
        if crowded.isEmpty():
            break
        rest = _whole(leaves.join(crowded, "code", "left_anti"))
        kept = sized(rest if kept is None else kept.union(rest), "leaves")
        if turn == rounds:
            return kept.union(_block_pairs(leaves.join(crowded, "code"), leaf))
        rows = leaves.join(crowded, "code").join(classes.select("cid", "embedding", "dims"), "cid")

        def project(batches, turn=turn):
            for batch in batches:
                code, dims = batch.column(1).to_numpy(), batch.column(3).to_numpy()
                for d in np.unique(dims):
                    part, codes = batch.filter(pa.array(dims == d)), code[dims == d]
                    x, where = unit(part.column(2)), np.zeros(len(codes))
                    for c in np.unique(codes):  # a plane of its own, so that no pair is parted in all trees by the same one
                        where[codes == c] = x[codes == c] @ _normals([turn, int(c) & (1 << 64) - 1], int(d))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(where)], ["cid", "code", "at"])

        rows = sized(rows.select("cid", "code", "embedding", "dims").mapInArrow(project, "cid string, code long, at double"), "projected")
        middle = rows.groupBy("code").agg(F.percentile_approx("at", 0.5).alias("middle"))
        left, right = F.col("at") < F.col("middle") + SPILL, F.col("at") >= F.col("middle") - SPILL
        rows = rows.join(sized(middle, "middles"), "code")
        share = sized(rows.groupBy("code").agg(F.count(F.lit(1)).alias("m"), F.greatest(F.count_if(left), F.count_if(right)).alias("most")), "shares")
        rows = rows.join(share, "code")
        halves = F.array_compact(F.array(F.when(left, F.lit(0)), F.when(right, F.lit(1))))
        able = F.col("most") <= SHARED * F.col("m")
        kept = sized(kept.union(_block_pairs(rows.where(~able), leaf)), "leaves")
        leaves = sized(rows.where(able).withColumn("half", F.explode(halves)).select("cid", F.xxhash64("code", F.lit(turn), "half").alias("code")), "leaves")
    return _whole(leaves) if kept is None else kept.union(_whole(leaves))


def link_vectors(vectors: DataFrame, threshold: float = 0.98, leaf: int = LEAF, rounds: int = ROUNDS) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) to vec_id, n_links, component_id, kept; one row per row.

    Vectors of one label and length are linked when their cosine is at least ``threshold``. A row
    whose label or vector is null, whose vector is empty or zero or holds a null or non-finite
    component links with nothing: n_links 0, component_id its own vec_id, kept. Rows that repeat
    a vec_id are rows of their own. A null vec_id is never the id of a component that has another.
    Other columns are ignored. Links are those found in some leaf, see the measured recall.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    usable = F.coalesce(F.col("label").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
                        & F.exists("embedding", lambda x: x != 0), F.lit(False))
    cid = F.when(usable, F.concat_ws("-", F.hex(F.xxhash64("label", "embedding")), F.hex(F.xxhash64(F.lit(7), "label", "embedding"))))
    rows = sized(rows.select("vec_id", "label", "embedding", cid.alias("cid")), "vectors")
    classes = (rows.where("cid IS NOT NULL").groupBy("cid")
               .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
               .withColumn("dims", F.size("embedding")).withColumn("h", F.xxhash64("cid")))
    classes = sized(classes, "classes")
    leaves = _split_crowded(sized(_leaves(classes), "leaves"), classes, leaf, rounds)
    leaves = sized(leaves.distinct(), "leaves")
    codes = leaves.groupBy("cid").agg(F.collect_set("leaf").alias("codes"))
    names = sized(classes.select("label").distinct().select("label", F.xxhash64("label").alias("name")), "names")
    placed = (leaves.join(codes, "cid").join(classes.join(names, "label").select("cid", "n", F.col("name").alias("label"), "embedding", "dims"), "cid")
              .select("cid", "code", "leaf", "block", "alone", "codes", "n", "label", "embedding", "dims"))
    found = sized(placed.groupBy("code", "dims").applyInArrow(lambda t: compare_leaf(t, threshold), "cid string, linked long, root string"), "found")
    counts = found.groupBy("cid").agg(F.sum("linked").alias("linked"))
    labels = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    per = classes.select("cid", "least", "n").join(counts, "cid", "left").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    per = sized(per.select("cid", "least", "n", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "cid").alias("root")), "classes")
    least = per.groupBy("root").agg(F.min("least").alias("component_id"))
    per = sized(per.join(least, "root").select("cid", (F.col("n") - 1 + F.col("linked")).alias("n_links"), "component_id"), "classes")
    alone = rows.where("cid IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    joined = rows.where("cid IS NOT NULL").select("vec_id", "cid").join(per, "cid").select("vec_id", "n_links", "component_id")
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

"""MinHash near-dedup with an LSH forest.

A document is the set of its word shingles. Its signature has 128 values of 16 bits; tree t orders
documents by the signature rotated by 8 t values. Neighbours with a long common prefix in one of
the 16 orders are candidates. Depth adapts by region: documents that share ``FIRST`` values are a
region if there are at most ``REGION`` of them, else the region is cut at the next depth.

Texts with equal word sequences are one class before all this. Inside a region the signatures
give a spanning forest of likely pairs; classes that these pairs connect are a cluster, and so
are all classes of a region that had to be cut, whatever the cuts parted. The hashed shingles of
a cluster go to one task, once for each class, and the links are found there on full sets by an exact
prefix filter; only links that join something leave the task. A cluster too large for a task is
dealt to blocks that meet two by two. So no candidate pair is ever a row, and no pair of a
crowded region is lost to the cuts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from raincourse.llm.bytes_hash import Hasher, U, lowered, mix, runs, slices, word_kinds
from raincourse.llm.common import components
from raincourse.session import sized

WORDS = 5
TREES, WIDTH = 16, 8
VALUES = TREES * WIDTH
FIRST = 4
DEPTHS = (4, 5, 6, 7, 8, 10, 12, 16, 20, 28, 40, VALUES)
REGION = 256
BLOCK = 1 << 21  # shingles of a block
BLOOM = 1 << 26  # bits


def shingle_sets(data: np.ndarray, rows: np.ndarray, hasher: Hasher, words: int = WORDS):
    """Of a slice: (row of each shingle, its hash, hashes (n, 2) of each row's word sequence, words of each row).

    A row with fewer than ``words`` words but at least one has its whole sequence as one shingle.
    """
    text = lowered(data)
    starts, ends, row = runs(word_kinds(text), rows)
    n = len(rows) - 1
    word = hasher.intervals(text, starts, ends)
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    place = (np.arange(len(word)) - first[row]).astype(U)
    whole = np.zeros((n, 2), U)
    for side, seed in enumerate((U(0x243F6A8885A308D3), U(0x13198A2E03707344))):
        total = np.concatenate([[U(0)], np.cumsum(mix(mix(word + seed) + place), dtype=U)])
        whole[:, side] = mix((total[first[1:]] - total[first[:-1]]) ^ count.astype(U))
    full = np.flatnonzero(place.astype(np.int64) + words <= count[row]) if len(word) else np.zeros(0, np.int64)
    value = np.zeros(len(full), U)
    for k in range(words):
        value = mix(value * U(0x9E3779B97F4A7C15) + word[full + k])
    short = np.flatnonzero((count > 0) & (count < words))
    owner = np.concatenate([row[full], short])
    value = np.concatenate([value, whole[short, 0]])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new], whole, count


def signatures(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and their signature values, big-endian so that bytes sort like values."""
    factors = mix(np.arange(1, VALUES + 1, dtype=U)) | U(1)
    have, first = np.unique(owner, return_index=True)
    out = np.zeros((len(have), VALUES), ">u2")
    for k in range(VALUES if len(have) else 0):
        least = np.minimum.reduceat(mix(value * factors[k]) if k % 2 else value * factors[k], first)
        out[:, k] = (mix(least + U(k)) >> U(48)).astype(">u2")
    return have, out


def classes_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` (doc_id, text) to (doc_id, cls, n_shingles, sig); cls and sig are null without words."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for low, high, data, rows in slices(batch.column(1)):
                n = high - low
                owner, value, whole, count = shingle_sets(data, rows, hasher, words)
                have, sig = signatures(owner, value, n)
                cls = [w.tobytes() if c else None for w, c in zip(whole, count, strict=True)]
                sigs = [None] * n
                for at, s in zip(have.tolist(), sig, strict=True):
                    sigs[at] = s.tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(low, n), pa.array(cls, pa.binary()),
                    pa.array(np.bincount(owner, minlength=n).astype(np.int64)), pa.array(sigs, pa.binary())], ["doc_id", "cls", "n_shingles", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, cls binary, n_shingles long, sig binary")


def with_class(docs: DataFrame, name: str, words: int = WORDS) -> DataFrame:
    """``docs`` with its class as first column ``name``, null without words."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            cls = []
            for _, _, data, rows in slices(batch.column(0)):
                _, _, whole, count = shingle_sets(data, rows, hasher, words)
                cls += [w.tobytes() if c else None for w, c in zip(whole, count, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), *batch.columns[1:]], [name, *batch.schema.names[1:]])

    schema = StructType([StructField(name, BinaryType()), *docs.schema.fields])
    return docs.select(F.col("text").cast("string").alias(name), *docs.columns).mapInArrow(run, schema)


def _prefix(depth: int):
    """Key of tree t at a depth: hash of the first values of the rotated signature."""
    turned = F.concat(F.expr(f"substring(sig, int(t * {2 * WIDTH} + 1), {2 * VALUES})"), F.expr(f"substring(sig, 1, int(t * {2 * WIDTH}))"))
    return F.xxhash64(F.col("t"), F.lit(depth), F.substring(turned, 1, 2 * depth))


def regions(classes: DataFrame, limit: int = REGION) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions as rows (key, cls), each of 2 to ``limit`` classes, pairs (a, b) to check besides, and what was in crowd.

    Crowded regions of the first depth get their keys of all deeper depths at once. A key is a
    region when it holds few enough classes and the key above it too many; what stays in crowd to
    the last value of the signature is dealt to blocks. Where a region is crowded at the first
    depth, each of its classes is also paired with the centre: the class that stays in crowd the
    deepest, whose signature most others follow the longest. So members of a dense group that the
    deeper cuts part still meet what the group is made of. The last result has the members of the
    regions that are crowded at the first depth as rows (home, cls): they all meet in the end.
    """
    keyed = classes.select("cls", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")).select("cls", "t", _prefix(FIRST).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    level = sized(keyed.join(sizes, "key"), "level")
    found = level.where(F.col("n") <= limit).select("key", "cls")
    crowded = level.where(F.col("n") > limit).select("cls", "t", F.col("key").alias("home"), "n")
    if crowded.isEmpty():
        return found, level.select(F.col("cls").alias("a"), F.col("cls").alias("b")).where("false"), crowded.select("home", "cls")
    keys = crowded.join(classes, "cls").select("cls", "home", *[_prefix(depth).alias(f"k{depth}") for depth in DEPTHS[1:]])
    steps = [F.struct(F.lit(depth).alias("depth"), F.col(f"k{depth}").alias("key"), F.col("home" if above == FIRST else f"k{above}").alias("above"))
             for above, depth in zip(DEPTHS, DEPTHS[1:], strict=False)]
    deep = sized(keys.select("cls", "home", F.inline(F.array(*steps))), "deep")
    sizes = sized(deep.groupBy("home", "depth", "key", "above").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    crowds = sizes.where(F.col("n") > limit)
    cut = crowds.select(F.col("key").alias("above")).union(crowded.select(F.col("home").alias("above")).distinct())
    ready = sized(sizes.where(F.col("n") <= limit).join(cut, "above", "left_semi").select("key"), "ready")
    found = found.union(deep.join(ready, "key").select("key", "cls"))
    last = sized(crowds.where(F.col("depth") == VALUES).select("key", "n"), "last")
    if not last.isEmpty():
        block = F.pmod(F.xxhash64("cls"), F.ceil(2 * F.col("n") / limit))
        found = found.union(deep.where(F.col("depth") == VALUES).join(last, "key").select(F.xxhash64("key", block).alias("key"), "cls"))
    ranks = crowds.select("home", "depth", "n", "key").union(crowded.select("home", F.lit(FIRST).alias("depth"), "n", F.col("home").alias("key")))
    best = sized(ranks.groupBy("home").agg(F.max(F.struct("depth", "n", "key")).alias("best")).select("home", F.col("best.key").alias("key")), "best")
    inside = deep.select("home", "key", "cls").union(crowded.select("home", F.col("home").alias("key"), "cls"))
    centres = sized(inside.join(best, ["home", "key"]).groupBy("home").agg(F.max("cls").alias("hub")), "centres")
    pairs = crowded.join(centres, "home").where("cls != hub")
    return found, pairs.select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct(), crowded.select("home", "cls")


def likely(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree enough."""
    least = least_share(threshold)

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(len(batch), -1) for c in (batch.column(2), batch.column(3)))
            keep = (x == y).mean(axis=1) >= least
            yield batch.select([0, 1]).filter(pa.array(keep))

    a, b = (sigs.select(F.col("cls").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a binary, b binary")


def least_share(threshold: float) -> float:
    """Share of equal signature values four standard deviations below the threshold."""
    return threshold - 4 * (threshold * (1 - threshold) / VALUES) ** 0.5


def likely_pairs(grouped: DataFrame, threshold: float) -> DataFrame:
    """(a, b) from rows with ``members``, array of (cls, sig) of a region: a spanning forest of its likely pairs, the likeliest first.

    Likely: the share of equal signature values is within four standard deviations of the threshold or above.
    """
    least = least_share(threshold)

    def forest(sigs):
        m = len(sigs)
        i, j, share = [], [], []
        for p in range(m - 1):
            alike = (sigs[p] == sigs[p + 1:]).mean(axis=1)
            keep = np.flatnonzero(alike >= least)
            i.append(np.full(len(keep), p))
            j.append(keep + p + 1)
            share.append(alike[keep])
        if m < 2:
            return
        i, j, share = np.concatenate(i), np.concatenate(j), np.concatenate(share)
        parent, left = list(range(m)), m - 1

        def top(k):
            while parent[k] != k:
                parent[k] = k = parent[parent[k]]
            return k

        order = np.argsort(-share, kind="stable")
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            p, q = top(x), top(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                yield x, y
                left -= 1
                if left == 0:
                    return

    def run(batches):
        for batch in batches:
            a, b = [], []
            for members in batch.column(0):
                members = sorted(((x["cls"].as_py(), x["sig"].as_py()) for x in members.values), key=lambda x: x[0])
                sigs = np.frombuffer(b"".join(x[1] for x in members), np.uint16).reshape(len(members), -1)
                for p, q in forest(sigs):
                    a.append(members[p][0])
                    b.append(members[q][0])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return grouped.select("members").mapInArrow(run, "a binary, b binary").distinct()


def _marks(cls: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Places of each (class, id) in a Bloom filter of ``BLOOM`` bits, in four columns."""
    one = mix(cls[:, 0] ^ mix(ids.astype(np.int64).view(U) + U(1)))
    return (one[:, None] + np.arange(4, dtype=U) * (cls[:, 1] | U(1))[:, None]) % U(BLOOM)


def bloom(wanted: DataFrame) -> np.ndarray:
    """Bloom filter of ``wanted`` (cls, least) as octets; its size is fixed, so it may be sent to every task."""

    def run(batches):
        for batch in batches:
            cls = np.frombuffer(b"".join(batch.column(0).to_pylist()), U).reshape(-1, 2)
            places = np.unique(_marks(cls, batch.column(1).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array((places >> U(5)).astype(np.int32)), pa.array((np.int64(1) << (places & U(31)).astype(np.int64)))], ["word", "bits"])

    filled = wanted.select("cls", F.coalesce("least", F.lit(0)).alias("least")).mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BLOOM // 32, "<u4")
    out[filled["word"].to_numpy()] = filled["bits"].to_numpy()
    return out.view(np.uint8)


def shingles_of(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(cls, shingles) of the classes in ``wanted`` (cls, least), each from the row with its least doc_id.

    Rows that the Bloom filter of ``wanted`` excludes leave their task with nothing, so what is
    shuffled follows ``wanted`` and not the corpus.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bloom(wanted))

    def run(batches):
        hasher, bits = Hasher(), sent.value
        for batch in batches:
            for low, high, data, rows in slices(batch.column(1)):
                owner, value, whole, count = shingle_sets(data, rows, hasher, words)
                ids = batch.column(0).slice(low, high - low)
                at = _marks(whole, ids.fill_null(0).to_numpy(zero_copy_only=False))
                some = np.flatnonzero(((bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1).all(axis=1) & (count > 0))
                edges = np.searchsorted(owner, np.arange(high - low + 1))
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array(some)), pa.array([whole[k].tobytes() for k in some], pa.binary()),
                    pa.array([value[edges[k]:edges[k + 1]].tobytes() for k in some], pa.binary())], ["doc_id", "cls", "shingles"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, cls binary, shingles binary")
    found = found.join(wanted.select("cls", "least"), "cls").where(F.col("doc_id").eqNullSafe(F.col("least")))
    return found.groupBy("cls").agg(F.first("shingles").alias("shingles"))


def set_links(sets: list[np.ndarray], roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of ``sets`` (sorted hashes) that meet the threshold and join different ``roots``: no more than there are roots, less one.

    A set's shingles are ordered by how many sets of the block have them, rarest first. Of two sets at the threshold, the
    first ones of both, as many as the threshold lets them differ by and one more, have a shingle
    in common, so only sets that meet there are compared; the comparison itself is on whole sets.
    """
    m, size = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), size)
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    edges = np.concatenate([[0], np.cumsum(size)])
    order = np.lexsort((token, often[token], owner))
    place = np.arange(len(order)) - edges[owner]
    first = order[place < (size + percent * -size // 100 + 1)[owner]]
    first = first[often[token[first]] > 1]
    # Sets by size, and under each shingle those that have it among their first, smallest first.
    rank = np.empty(m, np.int64)
    rank[np.argsort(size, kind="stable")] = np.arange(m)
    by_token = first[np.lexsort((rank[owner[first]], token[first]))]
    starts, lengths = np.searchsorted(token[by_token], np.arange(len(often))), np.bincount(token[by_token], minlength=len(often))
    holders = owner[by_token]
    begin = np.searchsorted(owner[np.sort(first)], np.arange(m + 1))
    first = np.sort(first)
    label, links = np.unique(roots, return_inverse=True)[1], []
    have, met = np.zeros(len(often), bool), np.zeros(m, bool)
    for x in np.argsort(size, kind="stable").tolist():
        mine = token[first[begin[x]:begin[x + 1]]]
        near = [holders[starts[t]:starts[t] + lengths[t]] for t in mine.tolist() if lengths[t] > 1]
        if not near:
            continue
        met[np.concatenate(near)] = True
        near = np.flatnonzero(met)
        met[near] = False
        near = near[(rank[near] < rank[x]) & (100 * size[near] >= percent * size[x]) & (label[near] != label[x])]
        if not len(near):
            continue
        have[token[edges[x]:edges[x + 1]]] = True
        while len(near):  # some at a time: a link makes other comparisons needless
            now, near = near[:64], near[64:]
            where = np.concatenate([token[edges[y]:edges[y + 1]] for y in now])
            both = np.add.reduceat(have[where].astype(np.int64), np.cumsum(size[now]) - size[now])
            for y in now[100 * both >= percent * (size[now] + size[x] - both)].tolist():
                if label[y] != label[x]:
                    links.append((x, y))
                    label[label == label[y]] = label[x]
            near = near[label[near] != label[x]]
        have[token[edges[x]:edges[x + 1]]] = False
    return links


def block_links(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between different roots inside each block of ``blocks`` (key, cls, root, shingles)."""

    def run(table: pa.Table) -> pa.Table:
        names, roots = table["cls"].to_pylist(), table["root"].to_pylist()
        sets = [np.frombuffer(s.as_py(), U) for s in table["shingles"]]
        found = set_links(sets, np.array([r.hex() for r in roots]), percent)
        return pa.table({"a": pa.array([names[x] for x, _ in found], pa.binary()), "b": pa.array([names[y] for _, y in found], pa.binary())})

    return blocks.select("key", "cls", "root", "shingles").groupBy("key").applyInArrow(run, "a binary, b binary")


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose shingle sets meet the threshold, by exact integer comparison."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(*([np.frombuffer(s.as_py(), U) for s in batch.column(k)] for k in (2, 3)), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("cls").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def blocks_of(members: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Blocks (key, cls, root) in which every two of ``members`` (cls, cluster, n) of a cluster meet, and links found on the way.

    A cluster of at most ``block`` shingles is one block. In a larger one the likely ``pairs`` are
    checked first; a component that fills blocks has blocks of its own, the rest shares blocks, and
    each two blocks meet, but for two of the same component.
    """
    weigh = members.groupBy("cluster").agg(F.sum("n").alias("whole"))
    large = sized(weigh.where(F.col("whole") > block), "large")
    small = members.join(large, "cluster", "left_anti").select(F.col("cluster").alias("key"), "cls", F.col("cls").alias("root"))
    if large.isEmpty():
        return small, pairs.select("a", "b").where("false")
    inside = sized(members.join(large, "cluster").select("cls", "cluster", "n"), "inside")
    links = sized(linked_pairs(pairs.join(inside.select(F.col("cls").alias("a")), "a", "left_semi"), sets, percent), "links")
    roots = components(links).withColumnRenamed("node", "cls")
    inside = sized(inside.join(roots, "cls", "left").select("cls", "cluster", "n", F.coalesce("root", "cls").alias("root")), "inside")
    weights = inside.groupBy("cluster", "root").agg(F.sum("n").alias("own")).withColumn("pure", F.col("own") > block // 2)
    weights = sized(weights, "weights")
    rest = sized(weights.where("NOT pure").groupBy("cluster").agg(F.sum("own").alias("mixed")), "rest")
    half = block // 2
    own = F.xxhash64("root", F.pmod(F.xxhash64("cls"), F.ceil(F.col("own") / half)))
    shared = F.xxhash64("cluster", F.pmod(F.xxhash64("root"), F.ceil(F.col("mixed") / half)))
    dealt = inside.join(weights, ["cluster", "root"]).join(rest, "cluster", "left")
    dealt = sized(dealt.select("cluster", "cls", "root", F.when(F.col("pure"), own).otherwise(shared).alias("block"), F.when(F.col("pure"), F.col("root")).alias("of")), "dealt")
    each = sized(dealt.select("cluster", "block", "of").distinct(), "blocks")
    left, right = (each.select("cluster", F.col("block").alias(f"b{k}"), F.col("of").alias(f"of{k}")) for k in "12")
    meet = left.join(right, "cluster").where("b1 <= b2 AND (of1 IS NULL OR of2 IS NULL OR of1 != of2)").withColumn("pair", F.xxhash64("b1", "b2"))
    # As binary, like the names of the small clusters.
    meet = sized(meet.select(F.unhex(F.hex("pair")).alias("key"), "cluster", F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block")), "meet")
    return small.union(dealt.join(meet, ["cluster", "block"]).select("key", "cls", "root")), links


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, limit: int = REGION, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_shingles, component_id, kept and cls; one row per row.

    Documents with 100 * intersection >= ``percent`` * union of their shingle sets are linked;
    component_id is the least doc_id reachable over links, itself included. A null text, or one
    without words, has no shingles, links with nothing and keeps its own id. Texts with the same
    words are linked. Repeated rows share a component; among rows that repeat the least id all
    are marked kept. A null doc_id names a component only if no other id is in it. Other columns
    are ignored.
    """
    result = near_rows(docs, percent, words, limit, block)
    return result.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "cls")


def near_rows(docs: DataFrame, percent: int = 80, words: int = WORDS, limit: int = REGION, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, cls and root of each row; root is the component itself, whatever ids are in it."""
    rows = sized(classes_of(docs, words), "signatures")
    classes = sized(rows.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"), F.max("n_shingles").alias("n"), F.min("sig").alias("sig")), "classes")
    sigs = classes.select("cls", "sig")
    members, star, crowd = regions(sigs, limit)
    grouped = members.distinct().join(sigs, "cls").groupBy("key").agg(F.collect_list(F.struct("cls", "sig")).alias("members"))
    pairs = sized(likely_pairs(grouped, percent / 100).union(likely(star, sigs, percent / 100)).distinct(), "pairs")
    # All likely pairs of a region, and all classes of a crowded one, lie in one cluster.
    first = sized(crowd.groupBy("home").agg(F.min("cls").alias("a")), "first")
    clusters = components(pairs.union(crowd.join(first, "home").select("a", F.col("cls").alias("b"))))
    wanted = sized(clusters.join(classes, clusters.node == classes.cls).select("cls", F.col("root").alias("cluster"), "least", "n"), "clusters")
    sets = sized(shingles_of(docs, wanted, words), "shingles")
    blocks, links = blocks_of(wanted, pairs, sets, percent, block)
    links = links.union(sized(block_links(blocks.join(sets, "cls"), percent), "links"))
    linked = components(links).withColumnRenamed("node", "cls").join(classes.select("cls", "least"), "cls")
    least = sized(linked.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    linked = sized(linked.join(least, "root").select("cls", "component_id", "root"), "components")
    per = classes.select("cls", "least").join(linked, "cls", "left").select(
        "cls", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "cls").alias("root"))
    joined = rows.where("cls IS NOT NULL").select("doc_id", "n_shingles", "cls").join(sized(per, "components"), "cls").select("doc_id", "n_shingles", "component_id", "cls", "root")
    alone = rows.where("cls IS NULL").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"), "cls", F.col("cls").alias("root"))
    return joined.union(alone)

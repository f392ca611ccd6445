"""MinHash near-dedup by chosen-path set similarity join.

Every text becomes its set of distinct word shingles. Texts with equal sets are one class, represented by the smallest
doc_id, so copies are never paired. Classes branch in independent trees: at each level of a tree a class goes to two child
nodes, each chosen by the minwise shingle of one more hash function, so similar classes stay together and others part. A node of
at most `small` classes is compared exhaustively; in a larger one every class is compared with the node's first class, and
those that are still not connected with each other branch further, while that parts them: where the children of a node hold as many pairs
as the node itself (its classes are alike on average, if below the threshold), or after DEPTH levels, its classes are compared with each
other in blocks. Candidates pass a sketch of SKETCH minwise hashes (an estimate
far below the threshold drops them) and are confirmed on full shingle sets of the whole texts. Connected components are found
by alternating star contraction, all of it as joins.

The hash function of a child is picked by the node itself, so the nodes of a level part a pair nearly independently of each other: a pair
at the threshold t meets in a tree with probability 1 - q, q = (1 - t + t q)^2: q is 0.031 at 0.85 and 0.063 at 0.8. TREES = 4
trees miss about 1e-6 and 3e-5 of such pairs at any depth (simulated with sketches of SKETCH values), fewer of more similar ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, drop_worker_state, join_hot, map_arrow, materialize, mix64, odd_multipliers, utf8, word_hashes

TREES, DEPTH, CHILDREN = 4, 8, 2
#: Minwise hashes of a class; with fewer, nodes pick the same ones too often.
SKETCH = 128
#: Nodes of at most so many classes are compared exhaustively (4096 sketches are two megabytes).
SMALL = 4096
#: ... and of at most so many shingles in all, so that their sets fit into a task.
SMALL_SHINGLES = 4_000_000
#: Members of a pair of blocks, in multiples of SMALL: each member is sent once for each pair that its block is in.
WIDE = 4
#: Rows of a star that meet one copy of the hub.
SLOT = 1024
#: Cells of the product of a block of rows with all members, and of the 0/1 matrix of all members by a block of shingles.
_PRODUCT, _MATRIX = 1 << 21, 1 << 23

_A = odd_multipliers(SKETCH, 17)
_B = odd_multipliers(SKETCH, 18)
_MIX = odd_multipliers(64, 19)


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a text of fewer words has one shingle, none has none."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = mix64(word_hashes(words))
    k = min(width, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):  # an ordered combination: the position's multiplier, then mixing
        out = mix64(out * _MIX[0] + hashes[i : len(hashes) - k + 1 + i] * _MIX[1 + i % 63])
    return np.unique(out)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The minwise value under each of SKETCH hash functions, as 32-bit numbers."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 512):
        np.minimum(least, (shingles[i : i + 512, None] * _A[None, :] + _B[None, :]).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_digest (null without words), sketch."""

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        import xxhash

        n, digests, sketches = [], [], []
        for text in batch.column(2).to_pylist():
            s = shingle_set(text, width)
            n.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketches.append(sketch(s) if len(s) else None)
        flat = np.concatenate([x for x in sketches if x is not None]) if any(n) else np.empty(0, np.int32)
        ends = np.concatenate([[0], np.cumsum([0 if x is None else SKETCH for x in sketches])]).astype(np.int32)
        return {
            "doc_id": batch.column(0), "text_hash": batch.column(1), "n_shingles": pa.array(n, pa.int64()), "set_digest": pa.array(digests, pa.binary()),
            "sketch": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
        }

    rows = docs.select("doc_id", F.xxhash64("text"), utf8("text"))
    return map_arrow(rows, fn, "doc_id long, text_hash long, n_shingles long, set_digest binary, sketch array<int>", stateless=True)


def classes_of(sets: DataFrame) -> tuple[DataFrame, bool]:
    """id, doc_id, text_hash, set_digest, size, sketch, copies: one row for each distinct set, represented by its row of smallest doc_id.

    id is that doc_id, or a hash of it and the set where rows of one doc_id represent several sets; whether this occurs comes second.
    """
    rows = sets.where("set_digest is not null and doc_id is not null")
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    grouped = rows.groupBy("set_digest").agg(
        least, F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies")
    )
    named = materialize(grouped.select("least.doc_id", "least.text_hash", "set_digest", "size", "sketch", "copies"), "near-classes")
    shared = named.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not shared.limit(1).count():
        return named.withColumn("id", F.col("doc_id")), False
    marked = named.join(shared.withColumn("several", F.lit(True)), "doc_id", "left")
    own = F.when(F.col("several"), F.xxhash64("doc_id", "set_digest")).otherwise(F.col("doc_id"))
    return materialize(marked.withColumn("id", own).drop("several"), "near-classes"), True


def texts_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """id, text (bytes) of the representatives of the classes in ids (id, distinct)."""
    wanted = classes.join(ids, "id", "left_semi").select("id", "doc_id", "text_hash")
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8("text").alias("text"))
    found = rows.join(F.broadcast(wanted) if n_ids <= BROADCAST_IDS else wanted, ["doc_id", "text_hash"])
    return found.groupBy("id").agg(F.first("text").alias("text"))  # repeated rows have equal texts


def star_links(docs: DataFrame, classes: DataFrame, stars: DataFrame, width: int, num: int, den: int, at_least: int) -> DataFrame:
    """a, b: the links among stars (hub, id, n), n being at least the number of a hub's rows.

    Sketches that agree at fewer than at_least places are dropped, links are confirmed on full sets. The hub's sketch and text go out
    once for each slot of about SLOT rows, so a hub with a third of all rows is no hot key.
    """
    slots = F.ceil(F.col("n") / SLOT)
    dealt = stars.groupBy("hub", "id").agg(F.max(slots).alias("slots")).withColumn(
        "g", F.xxhash64("hub", "slots", F.pmod(F.xxhash64("id"), F.col("slots")))
    )
    sketches = classes.select("id", "sketch")
    hubs = dealt.select("hub", "g").distinct()
    hub_marks = hubs.join(sketches.select(F.col("id").alias("hub"), F.col("sketch").alias("marks")), "hub").select("g", "hub", "marks")
    alike = F.expr(f"size(filter(zip_with(marks, sketch, (p, q) -> p = q), e -> e)) >= {at_least}")
    pairs = materialize(dealt.join(sketches, "id").join(hub_marks, ["g", "hub"]).where(alike).select("g", "hub", "id"), "near-pairs")
    n = pairs.count()
    hubs = pairs.select("g", "hub").distinct()
    ids = pairs.select("id").union(hubs.select(F.col("hub").alias("id"))).distinct()
    texts = materialize(texts_of(docs, classes, ids, 2 * n), "near-texts")
    ends = pairs.select("g", "id", F.lit(1).alias("place"), "hub").unionByName(hubs.select("g", F.col("hub").alias("id"), F.lit(0).alias("place"), "hub"))
    rows = ends.join(texts, "id").select("g", "hub", "place", "id", "text").repartition("g").sortWithinPartitions("g", "hub", "place")

    def run(batches):
        drop_worker_state()
        hub = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for _, of, place, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingle_set(text, width)
                if place == 0:
                    hub = own
                    continue
                common = len(np.intersect1d(hub, own, assume_unique=True))
                if den * common >= num * (len(hub) + len(own) - common):
                    found.append((of, i))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.mapInArrow(run, "a long, b long")


def contract(roots: DataFrame, found: DataFrame) -> DataFrame:
    """roots (id, root) renewed with more links (a, b): only links between different roots are contracted, over the roots alone."""
    labelled = lambda df, c: df.join(roots.select(F.col("id").alias(c), F.col("root").alias(f"r_{c}")), c, "left")
    ends = [F.coalesce(f"r_{c}", c).alias(c) for c in ("a", "b")]
    over = labelled(labelled(found.select("a", "b"), "a"), "b").select(*ends).where("a <> b").distinct()
    moved = star_components(over)
    n = moved.count()
    if not n:
        return roots
    onward = moved.select(F.col("id").alias("root"), F.col("root").alias("onward"))
    if n <= BROADCAST_IDS:
        renewed = roots.join(F.broadcast(onward), "root", "left")
    else:  # a root that most ids have is a hot key
        sizes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("w"))
        renewed = join_hot(roots, sizes.join(onward, "root", "left"), ["root"], "w", roots.count(), "id")
    renewed = renewed.select("id", F.coalesce("onward", "root").alias("root"))
    return materialize(renewed.unionByName(moved.join(roots.select("id"), "id", "left_anti").select("id", "root")), "roots")


def star_components(edges: DataFrame) -> DataFrame:
    """id, root: every id of an edge (a, b) and the smallest id that it is connected with.

    Alternates large-star and small-star steps, each a grouped minimum and a join, until every id has one root that has none itself. Every
    step keeps the components and lowers the sum of neighbours, so this ends; no number of rounds is set.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    while n := now.count():
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("w"))
        large = join_hot(both, least, ["u"], "w", 2 * n, "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("w"))
        ends = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        small = join_hot(large, least, ["u"], "w", n, "v").select(ends.alias("e")).select("e.*").where("u <> v").distinct()
        now = materialize(small, "stars")
        ends = F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up"))))
        degrees = now.select(ends.alias("e")).select("e.*").groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("down"))
        if not degrees.where("ups > 1 or (ups = 1 and down = 0)").limit(1).count():
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _children(rows: DataFrame, level: int) -> DataFrame:
    """tree, node, id, size, above of the next level: CHILDREN nodes for each row, named by the node above and one more minwise shingle."""
    if level == 0:
        grown = rows.select("id", "size", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES * CHILDREN - 1))).alias("k"))
        tree, child = F.expr(f"int(k div {CHILDREN})"), F.expr(f"k % {CHILDREN}")
        above = F.lit(0).cast("long")
    else:
        grown = rows.select("id", "size", "sketch", "tree", "node", F.explode(F.sequence(F.lit(0), F.lit(CHILDREN - 1))).alias("k"))
        tree, child, above = F.col("tree"), F.col("k"), F.col("node")
    coordinate = tree * CHILDREN + child if level == 0 else F.pmod(
        F.xxhash64(above, tree, F.lit(level), child, F.lit("coordinate")), F.lit(SKETCH)
    ).cast("int")
    return grown.select(tree.alias("tree"), F.xxhash64(above, tree, F.lit(level), child, F.get("sketch", coordinate)).alias("node"), "id", "size", above.alias("above"))


def _labelled(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return rows.withColumn("root", F.col("id"))
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _close_members(rows: DataFrame, sketches: DataFrame, at_least: int) -> DataFrame:
    """g, id, root: the members of each node of rows (tree, node, id, root) that agree enough with an unconnected member."""
    members = rows.join(sketches, "id").groupBy("tree", "node").agg(F.collect_list(F.struct("id", "root", "sketch")).alias("m"))

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        lists, groups = batch.column(1), batch.column(0).to_numpy()
        flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        ids, roots = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        marks = flat.field(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, SKETCH)
        close = np.zeros(len(ids), bool)
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            for row in range(lo, hi - 1):
                rest = np.flatnonzero(roots[row + 1 : hi] != roots[row]) + row + 1
                if len(rest):
                    rest = rest[np.count_nonzero(marks[rest] == marks[row], axis=1) >= at_least]
                    if len(rest):
                        close[row] = close[rest] = True
        return {"g": pa.array(np.repeat(groups, np.diff(ends))[close]), "id": pa.array(ids[close]), "root": pa.array(roots[close])}

    return map_arrow(members.select(F.xxhash64("tree", "node").alias("g"), "m"), fn, "g long, id long, root long", stateless=True)


def links_within(ids: list[int], roots: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect the members which exact similarities connect, at most one less than there are members.

    Intersection sizes of all pairs come from products of 0/1 matrices over blocks of the shingles that two members or more have.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    _, where, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(often >= 2) - 1
    shared = often[where] >= 2
    member, place = np.repeat(np.arange(n), sizes)[shared], column[where[shared]]
    order = np.argsort(place, kind="stable")
    member, place = member[order], place[order]
    height, step = (min(most, max(16, cells // n)) for most, cells in ((512, _PRODUCT), (2048, _MATRIX)))  # memory is bounded for any n
    edges = np.searchsorted(place, np.arange(0, (place[-1] + 1 if len(place) else 0) + step, step))
    labels, out = np.unique(roots, return_inverse=True)[1], []
    for top in range(0, n, height):
        rows = min(height, n - top)
        common = np.zeros((rows, n), np.float32)
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            block = np.zeros((n, step), np.float32)
            block[member[a:b], place[a:b] - k * step] = 1
            common += block[top : top + rows] @ block.T
        near = den * common.astype(np.float64) >= num * (sizes[top : top + rows, None] + sizes[None, :] - common)
        for r in range(rows):
            i = top + r
            others = np.flatnonzero(near[r] & (labels != labels[i]))
            for label in np.unique(labels[others]).tolist():
                out.append((ids[i], ids[int(others[labels[others] == label][0])]))
                labels[labels == label] = labels[i]
    return out


def _node_links(docs: DataFrame, classes: DataFrame, members: DataFrame, n_members: int, width: int, num: int, den: int) -> DataFrame:
    """a, b: links within each group of members (g, id, root), confirmed on full sets inside the group's task."""
    texts = texts_of(docs, classes, members.select("id").distinct(), n_members)
    rows = members.join(texts, "id").select("g", "id", "root", "text").repartition("g").sortWithinPartitions("g")

    def run(batches):
        drop_worker_state()
        group, ids, roots, sets = None, [], [], []
        found: list[tuple[int, int]] = []
        for batch in batches:
            for g, i, root, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    if len(ids) > 1:
                        found += links_within(ids, roots, sets, num, den)
                    group, ids, roots, sets = g, [], [], []
                ids.append(i)
                roots.append(root)
                sets.append(shingle_set(text, width))
        if len(ids) > 1:
            found += links_within(ids, roots, sets, num, den)
        yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.mapInArrow(run, "a long, b long")


def _blocks(rows: DataFrame) -> DataFrame:
    """tree, node, id, root of large nodes (tree, node, n, shingles, id, root) as pairs of blocks, each pair a node of about WIDE * SMALL members."""
    count = F.greatest(F.lit(1), F.ceil(2 * F.col("n") / (WIDE * SMALL)), F.ceil(2 * F.col("shingles") / SMALL_SHINGLES)).cast("int")
    dealt = rows.withColumn("count", count).withColumn("own", F.pmod(F.xxhash64("id"), F.col("count")).cast("int"))
    met = dealt.select("tree", "node", "id", "root", "own", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("other"))
    return met.select("tree", F.xxhash64("tree", "node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id", "root")


def similar_components(docs: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """id, root for the classes that are linked with another one."""
    spark = docs.sparkSession
    j = num / den
    # six standard deviations below the expected agreement at the threshold
    at_least = max(1, int(SKETCH * j - 6 * (SKETCH * j * (1 - j)) ** 0.5))
    sketches = classes.select("id", "sketch")
    roots = None

    def add(found: DataFrame) -> None:
        """Renew the components with more links."""
        nonlocal roots
        found = materialize(found, "near-links")
        if found.limit(1).count():
            roots = star_components(found) if roots is None else contract(roots, found)

    def compare(nodes: DataFrame) -> None:
        """Compare the members of small nodes."""
        close = materialize(_close_members(nodes, sketches, at_least), "near-members")
        if n := close.count():
            add(_node_links(docs, classes, close, n, width, num, den))

    counts = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.min(F.struct("root", "id")).alias("pivot"), F.max("root").alias("last")]
    small = F.expr(f"n <= {SMALL} and shingles <= {SMALL_SHINGLES}")

    def unsettled(rows: DataFrame, total: int, label: str) -> DataFrame:
        """rows of nodes whose members are not all connected, with n, shingles, pivot and pivot_root of their node."""
        nodes = rows.groupBy("tree", "node").agg(*counts).where("n > 1 and pivot.root < last")
        nodes = nodes.select("tree", "node", "n", "shingles", F.col("pivot.id").alias("pivot"), F.col("pivot.root").alias("pivot_root"))
        return materialize(join_hot(rows, nodes, ["tree", "node"], "n", total, "id"), label)

    rows, total, level = _children(classes, 0), TREES * CHILDREN * classes.count(), 0
    while total:
        mixed = unsettled(_labelled(rows, roots), total, "near-nodes")
        compare(mixed.where(small))
        large, level = mixed.where(~small), level + 1
        if not large.limit(1).count():
            break
        stars = _labelled(large.drop("root"), roots).where("root <> pivot_root").select(F.col("pivot").alias("hub"), "id", "n")
        add(star_links(docs, classes, stars, width, num, den, at_least))
        large = large.select("tree", "node", "id", "size")
        left = unsettled(_labelled(large, roots), large.count(), "near-rows")
        if level == DEPTH:  # minwise hashes do not part these: blocks of each node meet pair by pair, inside tasks
            compare(_blocks(left))
            break
        rows = materialize(_children(left.select("tree", "node", "id", "size").join(sketches, "id"), level), "near-children")
        pairs = rows.groupBy("tree", "above", "node").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("tree", "above")
        pairs = pairs.agg(F.sum(F.col("n") * F.col("n")).alias("below"), (F.sum("n") / CHILDREN).alias("n"))
        dense = materialize(pairs.where("below >= n * n").select("tree", F.col("above").alias("node")), "near-dense")
        if n_dense := dense.count():  # branching would only make more pairs of these
            dense = F.broadcast(dense) if n_dense <= BROADCAST_IDS else dense
            compare(_blocks(left.join(dense, ["tree", "node"], "left_semi")))
            rows = rows.join(dense.withColumnRenamed("node", "above"), ["tree", "above"], "left_anti")
        total = rows.count()
    return roots if roots is not None else spark.createDataFrame([], "id long, root long")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of Jaccard similarity num / den or more; the component's row of smallest
    (doc_id, text_hash) is kept, with rows equal to it. A null or blank text has no shingles, is linked with nothing and kept; repeated
    rows get equal results; rows of one doc_id with different texts are judged by their texts; a row without doc_id keeps a null
    component and is kept. text_hash is xxhash64 of the text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    sets = materialize(shingle_sets(docs, width), "near-sets")
    classes, several = classes_of(sets)
    named = classes.join(similar_components(docs, classes, width, num, den), "id", "left").withColumn("root", F.coalesce("root", "id"))
    if several:  # ids that are no doc_ids: find each component's smallest row
        best = named.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "id")).alias("best"), F.count(F.lit(1)).alias("n"))
        named = join_hot(named, best, ["root"], "n", classes.count(), "id").withColumns({"component": F.col("best.doc_id"), "head": F.col("best.id")})
    else:
        named = named.withColumns({"component": F.col("root"), "head": F.col("root")})
    first = F.when(F.col("id") == F.col("head"), F.struct("doc_id", "text_hash"))
    named = named.select("set_digest", "copies", "component", first.alias("first"))
    rows = sets.select("doc_id", "text_hash", "n_shingles", "set_digest")
    judged = F.col("doc_id").isNotNull() & F.col("set_digest").isNotNull()
    found = join_hot(rows.where(judged), named, ["set_digest"], "copies", sets.count(), "doc_id")
    kept = F.coalesce(F.struct("doc_id", "text_hash") == F.col("first"), F.lit(False))
    found = found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"), "text_hash")
    return found.unionByName(
        rows.where(~judged).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "text_hash")
    )


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity of 0.85 or more, over all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 85, 100)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

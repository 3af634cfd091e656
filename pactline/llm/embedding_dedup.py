"""Embedding near-duplicates by a cover tree and its dual traversal.

Vectors become unit vectors in double precision; a cosine of at least t is a distance of at
most sqrt(2 - 2 t). Equal unit vectors are one point with a count.

The top of the tree is laid out on Spark: a bounded sample gives centres, nested levels of
them with halving radii (each level's centres stay centres below), and every point goes to
the nearest centre of the lowest level. Their number grows with that of the points, up to
``CENTRES``. Covering radii are measured over all points, so two nodes need each other only if
the distance of their centres is at most the sum of their radii and the threshold. Nodes of
many points are cut into blocks of bounded size.

Below, blocks that follow each other form groups, and each pair of groups is a task. The tasks
are run in rounds that move ``ROUND`` copies of the points at most, and the shuffle files of a
round are freed when it ends, so that disk grows with the input however many pairs of groups
there are. In a task each block gets a tree of its own, with nested levels
of halving radii, each node's parent the nearest centre of the level above, and a covering
radius over all points below it. The trees of each two blocks are walked together from their roots: a pair
of nodes beyond the bound is pruned with all that lies below it, the others are replaced by
the pairs of their children, and points of the leaf pairs that are left are compared exactly.
A task returns how many partners each point has and a spanning forest of the links, never the
pairs themselves, so a dense group stays linear.

Points in general position, whose nodes have large radii, are not pruned above the leaves:
there the work grows with the square of their number, as for any exact method known.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; equal vectors link with each other; vectors of different lengths never link;
rows that share a vec_id, or have none, are rows of their own, linked by their own vectors (a
component is named by its least vec_id, null only if it has no other, and a row is kept if its
vec_id is that name); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from pactline.llm._spark import components, grouped_by_row, in_batches, saved, table

SAMPLE = 16  # points for each centre that may become one
SAMPLE_BYTES = 64 << 20  # of them together, at most
CENTRES = 4_096  # at most so many nodes above the blocks
FEWEST = 256
BLOCK = 2_048
GROUP = 8  # blocks of a group, at most
GROUP_BYTES = 16 << 20  # of its points, at most
ROUND = 3  # copies of the points that move at once
FOLD = 16  # rounds whose links are put together at once
_SLACK = 1e-7  # of distances: near 0 they are known to the root of the precision only


def _unit(v: pa.Scalar) -> tuple[np.ndarray, np.ndarray] | None:
    """A vector's components and its unit vector; None for one that links with nothing."""
    if v.is_valid and v.values.null_count == 0 and len(v.values):
        raw = v.values.to_numpy(zero_copy_only=False)
        x = raw.astype(np.float64)
        if np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
            x = x / top
            return raw, x / math.sqrt(float(x @ x))
    return None


def _units(batches):
    """The digest of each unit vector, and the components it is made of; nothing in either for a vector without."""
    for batch in batches:
        found = [_unit(v) for v in batch.column("embedding")]
        marks = [hashlib.sha256(x[1].tobytes()).digest() if x else b"" for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(marks, pa.binary()), pa.array([x[0].tobytes() if x else b"" for x in found], pa.binary())], ["vec_id", "mark", "raw"])


def _matrix(raw, kind: type) -> np.ndarray:
    """The unit vectors of components of one length, as they are stored (float or double)."""
    x = np.frombuffer(b"".join(u.as_py() for u in raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, initial=0)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _levels(x: np.ndarray, first: float, last: float) -> list[np.ndarray]:
    """Nested levels of centres: each point is within the level's radius of a centre; radii halve."""
    levels, chosen, radius = [], np.array([0]), first
    nearest = np.sqrt(np.maximum(2 - 2 * (x @ x[0]), 0))
    while radius >= last:
        while (far := int(nearest.argmax())) is not None and nearest[far] > radius:
            chosen = np.append(chosen, far)
            nearest = np.minimum(nearest, np.sqrt(np.maximum(2 - 2 * (x @ x[far]), 0)))
            if len(chosen) * 4 > len(x) + 64:  # points in general position: every point is its own centre
                return levels
        levels.append(chosen.copy())
        radius /= 2
    return levels


def _distance(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one range after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


class _Tree:
    """The nodes of one block by level: centres, covering radii, and the ranges of their children.

    Nodes of a level are numbered so that the children of a node follow each other; the
    children of the lowest level are the points, in the order ``points``.
    """

    def __init__(self, x: np.ndarray, reach: float):
        self.x, chosen = x, _levels(x, 1.0, reach / 2)
        above = np.zeros(1, np.int64)  # the root is the first point
        self.centres, self.first, self.count = [above], [], []
        for centres in [*chosen, np.arange(len(x))]:
            parent = np.concatenate([(x[centres[k : k + 512]] @ x[above].T).argmax(axis=1) for k in range(0, len(centres), 512)])
            order = np.argsort(parent, kind="stable")
            count = np.bincount(parent, minlength=len(above))
            self.first.append(np.cumsum(count) - count)
            self.count.append(count)
            above = centres[order]
            self.centres.append(above)
        self.points = self.centres.pop()
        # radii from below: the points under a node are those under its children
        self.radius, n = [], np.ones(len(x), np.int64)
        first = np.arange(len(x))
        for level in range(len(self.centres) - 1, -1, -1):
            own, count = self.first[level], self.count[level]
            ends = np.append(np.cumsum(n), 0)
            lo = np.where(count > 0, first[np.minimum(own, len(first) - 1)], 0)
            hi = np.where(count > 0, ends[own + count - 1], 0)
            first, n = lo, hi - lo
            radius = np.zeros(len(own))
            for k in np.flatnonzero(n):
                radius[k] = _distance(x[self.points[lo[k] : hi[k]]] @ x[self.centres[level][k]]).max()
            self.radius.insert(0, radius)


def _links(a: _Tree, b: _Tree, reach: float):
    """(points of a, points of b) that must be compared, of each pair of leaves that no level prunes."""
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    depth = max(len(a.centres), len(b.centres))
    # the shallower tree waits at its root until both have as many levels left
    wait_a, wait_b = depth - len(a.centres), depth - len(b.centres)
    for step in range(depth):
        la, lb = max(0, step - wait_a), max(0, step - wait_b)
        apart = np.concatenate([_distance(np.einsum("ij,ij->i", a.x[a.centres[la][i[k : k + 8192]]], b.x[b.centres[lb][j[k : k + 8192]]])) for k in range(0, len(i), 8192)] or [np.zeros(0)])
        near = apart <= a.radius[la][i] + b.radius[lb][j] + reach + _SLACK
        i, j = i[near], j[near]
        if step == depth - 1:
            break
        if step >= wait_a:  # each pair is replaced by one for each child on the left ...
            n = a.count[la][i]
            i, j = _ranges(a.first[la][i], n), np.repeat(j, n)
        if step >= wait_b:  # ... and for each child on the right
            n = b.count[lb][j]
            j, i = _ranges(b.first[lb][j], n), np.repeat(i, n)
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    for own in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1) if len(i) else []:
        k = i[own[0]]
        left = a.points[a.first[-1][k] : a.first[-1][k] + a.count[-1][k]]
        right = b.points[_ranges(b.first[-1][j[own]], b.count[-1][j[own]])]
        if len(left) and len(right):
            yield left, right


def _compared(cosine: float, kind: type):
    reach = math.sqrt(2 - 2 * cosine)

    def run(group: pa.Table) -> pa.Table:
        ids, counts = group["rep"].to_numpy(), group["n"].to_numpy()
        side, block, x = group["side"].to_numpy(), group["block"].to_numpy(), _matrix(group["raw"], kind)
        alone = group["x"][0] == group["y"][0]  # a group with itself
        parts = [[(p, _Tree(x[p], reach)) for p in (np.flatnonzero((side == k) & (block == b)) for b in np.unique(block[side == k]))] for k in (0, 1)]
        met = [(p, q) for i, p in enumerate(parts[0]) for q in (parts[0][i:] if alone else parts[1])]
        partners = np.zeros(len(ids), np.int64)
        label = np.arange(len(ids))  # the component of each point, always by its least member
        edges: list[tuple[int, int]] = []
        for (left, a), (right, b) in met:
            for own, other in _links(a, b, reach):
                for lo in range(0, len(own), 512):
                    i, j = left[own[lo : lo + 512]], right[other]
                    hit = x[i] @ x[j].T >= cosine
                    if a is b:
                        hit &= i[:, None] != j[None, :]
                    partners[i] += hit @ counts[j]
                    if a is not b:
                        np.add.at(partners, j, counts[i] @ hit)
                    for r in np.flatnonzero(hit.any(axis=1)).tolist():
                        with_ = j[hit[r]]
                        roots, at = np.unique(label[with_], return_index=True)
                        for root, k in zip(roots.tolist(), with_[at].tolist()):
                            p = int(label[i[r]])
                            if root != p:
                                label[label == max(root, p)] = min(root, p)
                                edges.append((int(ids[i[r]]), int(ids[k])))
        rows = [(int(ids[k]), int(partners[k]), None) for k in np.flatnonzero(partners)] + [(p, 0, q) for p, q in edges]
        return pa.table({"rep": pa.array([r[0] for r in rows], pa.int64()), "links": pa.array([r[1] for r in rows], pa.int64()), "other": pa.array([r[2] for r in rows], pa.int64())})

    return run


def _grouped(nodes: list[dict], centres: dict[int, np.ndarray], reach: float) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Where the points of each node go, the numbers of points of the groups, and the pairs of groups that must be compared.

    Small nodes that follow each other share a block; a node of many points has several. A row
    is (size, node, first block, blocks, first group, blocks of a group).
    """
    homes, weights, pairs = [], [], []
    for size in sorted({x["size"] for x in nodes}):
        own = [x for x in nodes if x["size"] == size]
        radius, node, points = (np.array([x[k] for x in own]) for k in ("radius", "node", "points"))
        home, room = np.zeros(len(own), np.int64), [0]  # the nodes' places, and the points of each
        for k, n in enumerate(points.tolist()):
            if room[-1] and room[-1] + n > BLOCK:
                room.append(0)
            home[k] = len(room) - 1
            room[-1] += n
        parts = np.maximum(1, -(-np.array(room) // BLOCK))
        first = np.cumsum(parts) - parts
        wide = int(max(1, min(GROUP, parts.sum() // GROUP, GROUP_BYTES // (8 * BLOCK * size))))
        base, lo, hi = len(weights), first // wide, (first + parts - 1) // wide
        homes += [(size, int(n), int(first[h]), int(parts[h]), base, wide) for n, h in zip(node, home)]
        of = np.repeat(np.arange(len(parts)), parts)
        weights += np.bincount(np.arange(len(of)) // wide, (np.array(room) / parts)[of]).tolist()
        near = np.zeros((len(parts), len(parts)), bool)
        for k in range(len(own)):
            far = np.zeros(0, int) if size not in centres else np.flatnonzero(_distance(centres[size][node] @ centres[size][node[k]]) > radius + radius[k] + reach + _SLACK)
            close = np.ones(len(own), bool)
            close[far] = False
            near[home[k], home[close]] = True
        groups = np.zeros((hi[-1] + 1, hi[-1] + 1), bool)
        for k in range(len(parts)):
            c = near[k] | (np.arange(len(parts)) == k)
            spans = np.bincount(lo[c], minlength=hi[-1] + 2) - np.bincount(hi[c] + 1, minlength=hi[-1] + 2)
            groups[lo[k] : hi[k] + 1] |= (np.cumsum(spans) > 0)[:-1]
        pairs.append(np.argwhere(np.triu(groups | groups.T)) + base)
    return homes, np.array(weights), np.concatenate(pairs)


def _rounds(pairs: np.ndarray, weights: np.ndarray, most: float):
    """The pairs of groups in turns that move at most so many points, or a single pair."""
    moved = np.where(pairs[:, 0] == pairs[:, 1], weights[pairs[:, 0]], weights[pairs[:, 0]] + weights[pairs[:, 1]])
    start, total = 0, 0.0
    for k, n in enumerate(moved.tolist()):
        if k > start and total + n > most:
            yield pairs[start:k]
            start, total = k, 0.0
        total += n
    yield pairs[start:]


def _folded(found: list[DataFrame]) -> DataFrame:
    """The links of several rounds: a row for each point, and a forest."""
    rows = reduce(DataFrame.unionByName, found)
    if len(found) < FOLD:
        return rows
    links = rows.where("other is null").groupBy("rep").agg(F.sum("links").alias("links")).withColumn("other", F.lit(None).cast("long"))
    forest = components(rows.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b"))).where("node <> component")
    return saved(links.unionByName(forest.select(F.col("node").alias("rep"), F.lit(0).cast("long").alias("links"), F.col("component").alias("other"))))


def near_embeddings(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    return grouped_by_row(vectors.select("vec_id", "embedding"), "vec_id", "component_id", lambda v: _near_embeddings(v, cosine))


def _near_embeddings(vectors: DataFrame, cosine: float) -> DataFrame:
    """The same where each row has a vec_id of its own."""
    spark = vectors.sparkSession
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else np.float64
    width, reach = np.dtype(kind).itemsize, math.sqrt(2 - 2 * cosine)
    units = in_batches(vectors.select("vec_id", "embedding" if kind is np.float32 else F.col("embedding").cast("array<double>")), _units, "vec_id long, mark binary, raw binary")
    # a bounded sample chooses the centres; which points they are changes the work, never the result
    spread = vectors.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("size")).first()
    most = min(CENTRES, max(FEWEST, spread.n // 1024))
    sample = min(SAMPLE * most, SAMPLE_BYTES // (8 * max(1, spread.size or 1)))
    every = max(1, -(-spread.n // max(1, sample)))
    seen = units.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).where(F.length("raw") > 0).select("raw", (F.length("raw") / width).cast("int").alias("size")).limit(2 * sample).distinct().toArrow()
    centres: dict[int, np.ndarray] = {}
    for size in set(seen["size"].to_pylist()):
        x = _matrix(seen.filter(pc.equal(seen["size"], size))["raw"], kind)
        found = _levels(x, 1.0, reach)
        chosen = found[-1] if found else np.arange(len(x))
        centres[size] = x[chosen[:: math.ceil(len(chosen) / most)]]

    def placed(batches):
        for batch in batches:
            node, distance = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                if int(size) in centres:
                    x = _matrix(batch.column("raw").take(pa.array(own)), kind)
                    d = np.sqrt(np.maximum(2 - 2 * (x @ centres[int(size)].T), 0))
                    node[own] = d.argmin(axis=1)
                    distance[own] = d.min(axis=1)
                else:  # a length that the sample missed: one node, never pruned
                    distance[own] = 2.0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rep", "n", "mark", "raw", "size")), pa.array(node), pa.array(distance)], ["rep", "n", "mark", "raw", "size", "node", "distance"])

    # vectors of one direction are one point, whatever their lengths
    points = units.where(F.length("raw") > 0).groupBy("mark").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.max("raw").alias("raw"))
    at = saved(in_batches(points.select("rep", "n", "mark", "raw", (F.length("raw") / width).cast("int").alias("size")), placed, "rep long, n long, mark binary, raw binary, size int, node long, distance double"))
    # at most CENTRES rows for each vector length
    nodes = at.groupBy("size", "node").agg(F.max("distance").alias("radius"), F.count("*").alias("points")).orderBy("size", "node").toArrow().to_pylist()
    if not nodes:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows, weights, pairs = _grouped(nodes, centres, reach)
    homes = spark.createDataFrame(rows, "size int, node long, first long, blocks long, base long, wide long")
    # tables of at most CENTRES nodes, and of the pairs of a round
    housed = at.join(F.broadcast(homes), ["size", "node"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("group", F.col("base") + F.floor(F.col("block") / F.col("wide")))
    housed = housed.select("rep", "n", "raw", "block", "group")
    found: list[DataFrame] = []
    for own in _rounds(pairs, weights, ROUND * weights.sum()):
        meets = spark.createDataFrame([z for x, y in own.tolist() for z in {(x, x, y), (y, x, y)}], "group long, x long, y long")
        tasks = housed.join(F.broadcast(meets), "group").withColumn("side", (F.col("group") != F.col("x")).cast("int")).drop("group")
        found.append(saved(tasks.groupBy("x", "y").applyInArrow(_compared(cosine, kind), "rep long, links long, other long")))
        found = found if len(found) < FOLD else [_folded(found)]
    links = _folded(found)
    partners = links.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(links.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    named = at.select("rep", "n", "mark").join(partners, "rep", "left").join(linked, F.col("rep") == F.col("node"), "left").select(F.col("mark").alias("m"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # a vector without direction links with nothing
    out = units.select("vec_id", "mark").join(named, (F.col("mark") == F.col("m")) & (F.length("mark") > 0), "left")
    least = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), least.alias("component_id"), (F.col("vec_id") == least).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))

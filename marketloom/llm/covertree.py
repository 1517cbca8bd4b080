"""Exact threshold pairs of embeddings by dual traversal of cover trees.

Vectors of equal label are compared by cosine; on unit vectors that is Euclidean distance, and the
threshold becomes a distance. Copies of a vector are one point with a weight. A label's tree has two tiers.

The upper one is built and traversed by Spark, level by level: a node of over ``CELL`` points is opened into children of about
half a cell, ``FAN`` of them at most, each around one of its points drawn by hash, and points go to the nearest. Pairs of nodes start with the label's root
and itself; the pairs of their children are formed on the next level and pruned by centre distance and covering
radii, so that cells far apart never meet. A pair nearer than the threshold minus both radii is linked whole on the
level where that is seen. (Points that are equal but for rounding cannot be told apart by distance; such nodes are cut by hash.)

The lower tier builds a cover tree on each cell: nested levels with halving radii, every point within the radius of its
node's centre. A point goes to the pairs of its cell whose other centre it can reach. Two
trees (or a tree and itself) are traversed together: node pairs further apart than the threshold plus
both covering radii are dropped, pairs nearer than the threshold minus both are linked whole, the rest
are opened. At the leaves cosines are taken in double precision from the vectors.

Links are not emitted as pairs: each task returns for each point the weight it linked to and a forest
of its links, which is enough for counts and components.

Edge cases: a vector that is null, empty, zero, of another dimension than the others (it meets only its
own), or that holds null or non-finite components has no links, nor has one with a null label. Repeated
rows are points of their own with the same id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, salted_join, table
from .graph import components, looked_up

LEAST = 0.98
CELL = 2048
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125)
#: Added to bounds, so that rounding never prunes a pair or links one whole that the double-precision cosine decides otherwise.
SLACK = 1e-6
#: Children of a node of the upper tier, and tasks over which the rows of one node are dealt.
FAN, NODE_SALTS = 64, 16


def usable(vector: Column) -> Column:
    """The vector as doubles, or null if it takes no part."""
    v = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(finite & F.exists(v, lambda x: x != 0), v)


class Tree:
    """A cover tree on unit vectors: centres, covering radii and members of the nodes of each level, finest last."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray):
        self.v, self.w = np.ascontiguousarray(vectors), weights
        self.centres: list[np.ndarray] = []
        self.children: list[list[np.ndarray]] = []
        self.radius: list[np.ndarray] = []
        self.members: list[list[np.ndarray]] = []
        groups = [np.arange(len(vectors))]
        for r in RADII:
            centres, members, children, radius = [], [], [], []
            for g in groups:
                first = len(centres)
                for centre, near, far in self.cover(g, r) if len(g) > 1 else [(g[0], g, 0.0)]:
                    centres.append(centre)
                    members.append(near)
                    radius.append(far)
                children.append(np.arange(first, len(centres)))
            if self.centres:
                self.children.append(children)
            self.centres.append(np.array(centres, np.int64))
            self.members.append(members)
            self.radius.append(np.array(radius))
            groups = members

    def cover(self, points: np.ndarray, r: float, block: int = 128) -> Iterator[tuple[int, np.ndarray, float]]:
        """Centres among ``points``, each with the points within ``r`` that no earlier one took, and its covering radius."""
        v, free = self.v[points], np.ones(len(points), bool)
        for at in range(0, len(points), block):
            d = None
            for i in range(at, min(at + block, len(points))):
                if free[i]:
                    d = unit_distance(v[at : at + block] @ v.T) if d is None else d
                    near = free & (d[i - at] <= r)
                    near[i] = True
                    free &= ~near
                    yield points[i], points[near], float(d[i - at][near].max()) if near.sum() > 1 else 0.0


def unit_distance(dots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))


def dual(a: Tree, b: Tree, least: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Linked sets: (points of a, points of b, which pairs; None: all)."""
    limit = math.sqrt(2.0 - 2.0 * least)
    na, nb = len(a.centres[0]), len(b.centres[0])
    pairs = []
    for at in range(0, na, 512):  # the roots' children
        d = unit_distance(a.v[a.centres[0][at : at + 512]] @ b.v[b.centres[0]].T)
        i, j = np.nonzero(d <= limit + SLACK + a.radius[0][at : at + 512, None] + b.radius[0])
        pairs.append(np.stack([i + at, j], 1))
    front = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    if same:
        front = front[front[:, 0] <= front[:, 1]]
    for level in range(len(RADII)):
        ca, cb = a.centres[level][front[:, 0]], b.centres[level][front[:, 1]]
        d = np.empty(len(front))
        for at in range(0, len(front), 8192):
            d[at : at + 8192] = np.einsum("ij,ij->i", a.v[ca[at : at + 8192]], b.v[cb[at : at + 8192]])
        d = unit_distance(d)
        reach = a.radius[level][front[:, 0]] + b.radius[level][front[:, 1]]
        front, d, reach = (x[d <= limit + SLACK + reach] for x in (front, d, reach))
        whole = d + reach <= limit - SLACK
        for i, j in front[whole]:
            yield a.members[level][i], b.members[level][j], None
        front = front[~whole]
        if level + 1 < len(RADII):
            opened = []
            for i, j in front:
                x, y = a.children[level][i], b.children[level][j]
                p = np.stack([np.repeat(x, len(y)), np.tile(y, len(x))], 1)
                opened.append(p[p[:, 0] <= p[:, 1]] if same and i == j else p)
            front = np.concatenate(opened) if opened else np.zeros((0, 2), np.int64)
    for i, j in front:
        x, y = a.members[-1][i], b.members[-1][j]
        linked = np.einsum("id,jd->ij", a.v[x], b.v[y]) >= least
        if linked.any():
            yield x, y, linked


def links(ids: np.ndarray, a: Tree, b: Tree, ids_b: np.ndarray, least: float, same: bool) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Linked weight of each point, and a forest of the links."""
    weight: dict[int, int] = {}
    parent: dict[int, int] = {}
    forest: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def join(x: int, y: int) -> None:
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            forest.append((x, y))

    for x, y, which in dual(a, b, least, same):
        own = same and x[0] == y[0] and len(x) == len(y)  # a node with itself
        which = np.ones((len(x), len(y)), bool) if which is None and (own or len(x) * len(y) <= 64) else which
        if which is None:
            gx, gy = np.full(len(x), b.w[y].sum()), np.full(len(y), a.w[x].sum())
        else:
            which = which & ~(np.asarray(x)[:, None] == np.asarray(y)[None]) if same else which
            gx, gy = which @ b.w[y], a.w[x] @ which
        for p, g in zip(ids[x], gx, strict=True):
            if g:
                weight[int(p)] = weight.get(int(p), 0) + int(g)
        if not own:
            for p, g in zip(ids_b[y], gy, strict=True):
                if g:
                    weight[int(p)] = weight.get(int(p), 0) + int(g)
        if which is None or (own and which.sum() == len(x) * (len(x) - 1)):
            for p in ids[x]:
                join(int(p), int(ids_b[y[0]]))
            for p in ids_b[y]:
                join(int(ids[x[0]]), int(p))
            continue
        label = np.arange(len(y))  # columns that rows before have joined
        for i in np.flatnonzero(which.any(axis=1)):
            roots, at = np.unique(label[which[i]], return_index=True)
            for j in np.flatnonzero(which[i])[at]:
                join(int(ids[x[i]]), int(ids_b[y[j]]))
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
    return weight, forest


def measured(placed: DataFrame) -> DataFrame:
    """Nodes of ``placed`` (point, label, v, n, parent, node): centre ``c`` and its point, covering ``radius``, number of points and weight."""
    first = F.struct(F.col("point") != F.col("node"), "point")  # the point that the node was drawn around, where it is in it
    centres = placed.groupBy("label", "node").agg(F.min_by("v", first).alias("c"), F.min_by("point", first).alias("centre"))
    far = looked_up_by_label(placed, centres).groupBy("label", "node")
    return far.agg(
        F.min("parent").alias("parent"), F.min("c").alias("c"), F.min("centre").alias("centre"), F.max(distance(F.col("v"), F.col("c"))).alias("radius"),
        F.count(F.lit(1)).alias("many"), F.sum("n").alias("w"),
    )


def looked_up_by_label(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` with the columns of their nodes; the rows of one node are dealt over tasks."""
    salts = F.sequence(F.lit(0), F.lit(NODE_SALTS - 1))
    return rows.withColumn("salt", F.pmod(F.xxhash64("point"), F.lit(NODE_SALTS)).cast("int")).join(nodes.withColumn("salt", F.explode(salts)), ["label", "node", "salt"]).drop("salt")


def upper_tier(points: DataFrame, scratch: Scratch, cell: int) -> list[tuple[DataFrame, DataFrame]]:
    """Each level's points (point, label, v, n, parent, node) that are new on it, and nodes, those included that stay as they are."""

    def nearest(key: tuple, own: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        own = own[["point", "label", "v", "n", "node"]].rename(columns={"node": "parent"})
        if own.empty or pivots.empty:
            return own.assign(node=own["parent"])[["point", "label", "v", "n", "parent", "node"]]
        pivots = pivots.sort_values("pivot")
        dots = np.stack(list(own["v"])) @ np.stack(list(pivots["p"])).T
        return own.assign(node=pivots["pivot"].to_numpy()[dots.argmax(axis=1)])[["point", "label", "v", "n", "parent", "node"]]

    level = 0
    placed = points.select("point", "label", "v", "n", F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("node"))
    nodes = scratch.save(measured(placed), "nodes-0")
    levels = [(placed, nodes)]
    while not nodes.where(F.col("many") > cell).isEmpty():
        level += 1
        large = nodes.where(F.col("many") > cell).withColumn("parts", F.ceil(F.col("many") / cell).cast("int"))
        inside = looked_up_by_label(placed.drop("parent"), large.select("label", "node", "many", "parts", "radius", "centre"))
        draw = F.shiftrightunsigned(F.xxhash64("point", F.lit(level)), 11) / F.lit(float(1 << 53))
        pivots = inside.where((F.col("radius") > SLACK) & ((draw < F.least(FAN / F.col("many"), F.lit(2.0 / cell))) | (F.col("point") == F.col("centre"))))
        pivots = scratch.save(pivots.select("label", "node", "parts", F.col("point").alias("pivot"), F.col("v").alias("p")), f"pivots-{level}")
        # a node's points are dealt to tasks of at most about a cell, each with all its pivots
        copies = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = inside.withColumn("part", F.pmod(F.xxhash64("point", F.lit("deal")), F.col("parts")).cast("int"))
        wide = dealt.where(F.col("radius") > SLACK).groupBy("label", "node", "part").cogroup(copies.groupBy("label", "node", "part"))
        found = wide.applyInPandas(nearest, "point long, label string, v array<double>, n long, parent long, node long")
        alike = dealt.where(F.col("radius") <= SLACK).select("point", "label", "v", "n", F.col("node").alias("parent"), F.xxhash64("node", "part").alias("node"))
        placed = scratch.save(found.unionByName(alike), f"placed-{level}")
        stay = nodes.where(F.col("many") <= cell).withColumn("parent", F.col("node"))
        nodes = scratch.save(measured(placed).unionByName(stay), f"nodes-{level}")
        levels.append((placed, nodes))
    return levels


def node_pairs(levels: list[tuple[DataFrame, DataFrame]], scratch: Scratch, limit: float) -> tuple[DataFrame, list[DataFrame]]:
    """Pairs of cells to traverse (label, a, b and both centres and radii), and for each level the pairs of nodes that are linked whole."""
    side = lambda df, s: df.select(*[F.col(c) if c == "label" else F.col(c).alias(f"{c}_{s}") for c in df.columns])
    whole, open_now = [], None
    for level, (_, nodes) in enumerate(levels):
        one, other = side(nodes, "a"), side(nodes, "b")
        if open_now is None:
            pairs = one.join(other, "label")  # one root for each label
        else:
            pairs = open_now.select("label", F.col("node_a").alias("parent_a"), F.col("node_b").alias("parent_b"))
            pairs = pairs.join(one, ["label", "parent_a"]).join(other, ["label", "parent_b"])
            pairs = pairs.where((F.col("parent_a") != F.col("parent_b")) | (F.col("node_a") <= F.col("node_b")))
        apart = F.when(F.col("node_a") == F.col("node_b"), 0.0).otherwise(distance(F.col("c_a"), F.col("c_b")))
        pairs = pairs.withColumn("d", apart).withColumn("reach", F.col("radius_a") + F.col("radius_b")).where(F.col("d") <= F.col("reach") + limit + SLACK)
        pairs = scratch.save(pairs, f"pairs-{level}")
        linked = F.col("d") + F.col("reach") <= limit - SLACK
        whole.append(pairs.where(linked))
        open_now = pairs.where(~linked)
    return open_now, whole


def linked_whole(whole: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Weights and edges of pairs of nodes that are linked whole, on the points (point, label, n, node) of their level."""
    same = F.col("node_a") == F.col("node_b")
    rows = whole.select("label", F.col("node_a").alias("node"), F.col("w_b").alias("w"), F.col("centre_b").alias("hub"), same.alias("own"))
    rows = rows.unionByName(whole.where(~same).select("label", F.col("node_b").alias("node"), F.col("w_a").alias("w"), F.col("centre_a").alias("hub"), F.lit(False).alias("own")))
    rows = rows.groupBy("label", "node").agg(F.sum("w").alias("w"), F.min("hub").alias("hub"), F.max("own").alias("own"))
    found = looked_up_by_label(members, rows)
    weights = found.select("point", (F.col("w") - F.when(F.col("own"), F.col("n")).otherwise(0)).alias("weight"))
    edges = found.select(F.col("point").alias("a"), F.col("hub").alias("b")).unionByName(whole.select(F.col("centre_a").alias("a"), F.col("centre_b").alias("b")))
    return weights, edges.where("a <> b")


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, p: s + p))


def threshold_links(spark: SparkSession, points: DataFrame, scratch: Scratch, least: float = LEAST, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """``(point, weight)`` linked weights and ``(a, b)`` forests, of ``points`` (point, label, v unit doubles, n copies)."""
    limit = math.sqrt(2.0 - 2.0 * least)
    levels = upper_tier(points, scratch, cell)
    near, whole = node_pairs(levels, scratch, limit)
    weights, edges, members, placed = [], [], None, None
    for (own, nodes), pairs in zip(levels, whole, strict=True):
        # nodes that were not opened stay on the levels below
        cells = looked_up_by_label(own.select("point", "label", "v", "n", "node"), nodes.where(F.col("many") <= cell).select("label", "node"))
        slim = own.select("point", "label", "n", "node")
        members = slim if members is None else slim.unionByName(members)
        if not pairs.isEmpty():
            w, e = linked_whole(pairs, members)
            weights.append(w)
            edges.append(e)
        members = cells.select("point", "label", "n", "node") if placed is None else placed.unionByName(cells).select("point", "label", "n", "node")
        placed = cells if placed is None else placed.unionByName(cells)
    near = near.select("label", F.col("node_a").alias("cell_a"), F.col("node_b").alias("cell_b"), "c_a", "c_b", "radius_a", "radius_b")
    left = near.select("label", F.col("cell_a").alias("cell"), "cell_a", "cell_b", F.lit(0).alias("side"), F.col("c_b").alias("c"), F.col("radius_b").alias("r"))
    right = near.where("cell_a <> cell_b").select("label", F.col("cell_b").alias("cell"), "cell_a", "cell_b", F.lit(1).alias("side"), F.col("c_a").alias("c"), F.col("radius_a").alias("r"))
    sent = placed.withColumnRenamed("node", "cell").join(left.unionByName(right), ["label", "cell"])
    sent = sent.where((F.col("cell_a") == F.col("cell_b")) | (distance(F.col("v"), F.col("c")) <= F.col("r") + limit + SLACK))

    def traverse(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("point")
        own = [group[group["side"] == side] for side in (0, 1)]
        trees = [(g["point"].to_numpy(), Tree(np.stack(list(g["v"])), g["n"].to_numpy())) for g in own if len(g)]
        same = group["cell_a"].iloc[0] == group["cell_b"].iloc[0]
        if len(trees) < (1 if same else 2):
            return pd.DataFrame(columns=["point", "weight", "a", "b"])
        (ids_a, a), (ids_b, b) = trees[0], trees[-1]
        weight, forest = links(ids_a, a, b, ids_b, least, same)
        out = [(p, w, None, None) for p, w in weight.items()] + [(None, None, x, y) for x, y in forest]
        columns = zip(*out, strict=True) if out else [()] * 4
        return pd.DataFrame({k: pd.array(list(c), "Int64") for k, c in zip(("point", "weight", "a", "b"), columns, strict=True)})  # no float between

    found = sent.select("point", "label", "v", "n", "side", "cell_a", "cell_b").groupBy("label", "cell_a", "cell_b").applyInPandas(traverse, "point long, weight long, a long, b long")
    found = scratch.save(found, "found")
    weights = [found.where("point is not null").select("point", "weight"), *weights]
    edges = [found.where("a is not null").select("a", "b"), *edges]
    return reduce(DataFrame.unionByName, weights).groupBy("point").agg(F.sum("weight").alias("weight")), reduce(DataFrame.unionByName, edges).distinct()


def near_pairs(spark: SparkSession, rows: DataFrame, least: float = LEAST, cell: int = CELL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``rows`` (vec_id, embedding, label)."""
    scratch = Scratch(spark, "covertree")
    v = usable(F.col("embedding"))
    # a point is a distinct vector of a label; the hash deals rows out, the vectors themselves are compared
    key = F.when(F.col("label").isNotNull() & v.isNotNull(), F.xxhash64("label", v))
    slim = scratch.save(rows.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), v.alias("raw"), key.alias("key")), "slim")
    valid = slim.where("key is not null")
    classes = valid.groupBy("key", "label", "raw").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = scratch.save(classes.withColumn("point", F.monotonically_increasing_id() + 1), "classes")
    big = F.array_max(F.transform("raw", lambda x: F.abs(x)))  # scaled first, so that squares neither overflow nor vanish
    scaled = F.transform("raw", lambda x: x / F.col("big"))
    norm = F.sqrt(F.aggregate(F.col("s"), F.lit(0.0), lambda s, x: s + x * x))
    unit = classes.withColumn("big", big).withColumn("s", scaled).withColumn("norm", norm).withColumn("v", F.transform("s", lambda x: x / F.col("norm")))
    own_label = F.concat_ws(":", F.size("raw").cast("string"), "label")
    points = scratch.save(unit.select("point", own_label.alias("label"), "v", "n", "first"), "points")
    weights, forest = threshold_links(spark, points.select("point", "label", "v", "n"), scratch, least, cell)
    labels = components(scratch.save(forest, "forest"), scratch).withColumnRenamed("node", "point")
    classed = points.select("point", "n", "first").join(labels, "point", "left").withColumn("label", F.coalesce("label", "point"))
    smallest = classed.groupBy("label").agg(F.min("first").alias("component_id"))
    classed = looked_up(classed, "label", "point", smallest).join(weights, "point", "left")
    n_links = (F.coalesce("weight", F.lit(0)) + F.col("n") - 1).cast("long")
    classed = scratch.save(classed.select("point", n_links.alias("n_links"), "component_id"), "classed")
    forms = scratch.save(classes.select("key", "label", "raw", "point").join(classed, "point").drop("point"), "forms")
    by_key = forms.groupBy("key").agg(F.count(F.lit(1)).alias("forms"), F.min("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = salted_join(slim.select("vec_id", "key"), by_key, "key", F.col("vec_id")).where("coalesce(forms, 1) = 1").select("vec_id", "n_links", "component_id")
    shared = by_key.where("forms > 1").select("key")
    if not shared.isEmpty():  # vectors with one hash, if there are any, take their own form's
        out = out.unionByName(slim.join(forms.join(shared, "key"), ["key", "label", "raw"]).select("vec_id", "n_links", "component_id"))
    component = F.coalesce("component_id", "vec_id")
    return scratch.finish(out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept")))


def op9_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(spark, table(spark, sf_dir, "embeddings"))


OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.e, b.e) >= 0.98
),
r(vec_id, reached) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, p.b FROM r JOIN p ON r.reached = p.a
),
c AS (SELECT vec_id, min(reached) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.a = c.vec_id
"""

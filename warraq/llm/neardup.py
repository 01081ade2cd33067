"""Near-duplicate embeddings: exact threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, written

#: Vectors in one part; a task gets two parts, which bounds its memory.
PART = 8192
#: Candidates for centres that are compared with all points of a node at once.
CENTRES = 256
#: Pivots of all labels together; they go to every worker.
MAX_PIVOTS = 4096
#: Pairs of nodes with so many points at most are compared point by point, many partners of a node at once.
FEW = 64
#: A node whose points lie this close to its centre is not split.
LEAF_RADIUS = 1 / 32


class CoverTree:
    """Nested levels over unit vectors whose radii halve from level to level.

    A node has a centre, the points it covers (a stretch of ``order``) and its
    covering radius, the largest distance from the centre to one of them.
    Children of a node are centres more than half its level's radius apart
    that cover all its points. The root's level has radius 2, which covers the
    unit sphere.
    """

    def __init__(self, x: np.ndarray) -> None:
        self.x = x
        self.order = np.arange(len(x))
        self.centre, self.start, self.end, self.radius, self.children = [], [], [], [], []
        if len(x):
            self._node(0, 0, len(x), 2.0)
        self.centre, self.radius = np.array(self.centre, np.int64), np.array(self.radius)
        self.start, self.end = np.array(self.start, np.int64), np.array(self.end, np.int64)
        self.size = self.end - self.start
        self.single = self.size == 1

    def _cosines(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.x[a] @ self.x[b].T

    def _distance(self, centre: int, points: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (self.x[points] @ self.x[centre])))

    def _node(self, centre: int, start: int, end: int, level: float) -> int:
        me, points = len(self.centre), self.order[start:end]
        far = float(self._distance(centre, points).max()) if len(points) > 1 else 0.0
        self.centre.append(centre)
        self.start.append(start)
        self.end.append(end)
        self.radius.append(far)
        self.children.append([])
        if len(points) == 1 or far <= LEAF_RADIUS:
            return me
        half = level / 2
        while far <= half:  # levels on which the node has itself as its only child
            half /= 2
        # the centre first, then in order whatever no earlier centre covers; candidates are taken many at once
        left, groups = np.concatenate([[centre], points[points != centre]]), []
        while len(left):
            some = left[:CENTRES]
            close = self._cosines(some, some) >= 1 - half * half / 2
            taken = np.zeros(len(some), bool)
            for k in range(len(some)):
                taken[k] = not (close[k, :k] & taken[:k]).any()
            centres = some[taken]
            own = np.full(len(left), -1)
            own[np.flatnonzero(taken)] = np.arange(len(centres))
            for low in range(0, len(left), 4096):
                covers = self._cosines(left[low : low + 4096], centres) >= 1 - half * half / 2
                first = np.where(covers.any(axis=1), covers.argmax(axis=1), -1)
                own[low : low + 4096] = np.where(own[low : low + 4096] < 0, first, own[low : low + 4096])
            covered = np.flatnonzero(own >= 0)
            order = covered[np.argsort(own[covered], kind="stable")]
            groups += zip(centres.tolist(), np.split(left[order], np.cumsum(np.bincount(own[covered], minlength=len(centres)))[:-1]), strict=True)
            left = left[own < 0]
        at = start
        for c, own in groups:
            self.order[at : at + len(own)] = own
            self.children[me].append((c, at, at + len(own)))
            at += len(own)
        self.children[me] = np.array([self._node(c, s, e, half) for c, s, e in self.children[me]])
        return me


class Links:
    """Counts and components of the pairs found between points numbered 0 to n - 1. Pairs are held until there are ``HELD``."""

    HELD = 1 << 18

    def __init__(self, weight: np.ndarray) -> None:
        self.weight, self.count, self.label = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))
        self.held, self.pairs = 0, []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.pairs.append((i, j))
        self.held += len(i)
        if self.held >= self.HELD:
            self.settle()

    def settle(self) -> None:
        """Take the pairs held into counts and components."""
        if not self.pairs:
            return
        i, j = (np.concatenate([p[k] for p in self.pairs]) for k in (0, 1))
        self.held, self.pairs = 0, []
        n = len(self.count)
        self.count += np.bincount(i, self.weight[j], n).astype(np.int64) + np.bincount(j, self.weight[i], n).astype(np.int64)
        while len(i):
            a, b = self.label[i], self.label[j]
            different = a != b
            if not different.any():
                break
            i, j, a, b = i[different], j[different], a[different], b[different]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(jumped := self.label[self.label], self.label):
                self.label = jumped


def dual(a: CoverTree, b: CoverTree, threshold: float, found) -> None:
    """Call ``found(i, j)`` with arrays of all pairs of cosine >= threshold; for one tree with itself each pair once.

    A pair of nodes whose centres are farther apart than the threshold's
    distance and both covering radii is pruned. Otherwise the children of the
    node with the larger radius, or of both, take its place, or their points
    where both are small.
    """
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-7
    if not len(a.centre) or not len(b.centre):
        return
    stack = [(0, 0)]
    while stack:
        m, n = stack.pop()
        same = a is b and m == n
        over_a = a.children[m] if len(a.children[m]) and (same or a.radius[m] >= b.radius[n] or not len(b.children[n])) else np.array([m])
        over_b = b.children[n] if len(b.children[n]) and (same or b.radius[n] >= a.radius[m] or not len(a.children[m])) else np.array([n])
        if len(over_a) == len(over_b) == 1 and over_a[0] == m and over_b[0] == n:
            _points(a, m, b, n, threshold, same, found)
            continue
        right, wide = b.x[b.centre[over_b]], b.radius[over_b]
        for low in range(0, len(over_a), 512):
            part = over_a[low : low + 512]
            cosine = a.x[a.centre[part]] @ right.T
            most = reach + a.radius[part][:, None] + wide[None, :] if wide.any() or a.radius[part].any() else reach
            near = cosine >= 1 - np.minimum(2.0, most) ** 2 / 2
            if same:
                near &= np.arange(low, low + len(part))[:, None] <= np.arange(len(over_b))[None, :]
            p, q = np.nonzero(near)
            single = a.single[part[p]] & b.single[over_b[q]]
            hit = single & (cosine[p, q] >= threshold)
            i, j = a.centre[part[p[hit]]], b.centre[over_b[q[hit]]]
            if same:
                i, j = i[i != j], j[i != j]
            if len(i):
                found(i, j)
            left, other = part[p[~single]], over_b[q[~single]]
            few = (a.size[left] <= FEW) & (b.size[other] <= FEW) & ~(same & (left == other))
            _lots(a, left[few], b, other[few], threshold, found)
            stack += zip(left[~few].tolist(), other[~few].tolist(), strict=True)


def _lots(a: CoverTree, left: np.ndarray, b: CoverTree, other: np.ndarray, threshold: float, found) -> None:
    """Compare the points of small nodes directly: those of a node with those of all its partners (``left`` is sorted)."""
    for own in np.split(np.arange(len(left)), np.flatnonzero(np.diff(left)) + 1) if len(left) else ():
        mine, partners = a.order[a.start[left[own[0]]] : a.end[left[own[0]]]], other[own]
        many = b.size[partners]
        theirs = b.order[np.repeat(b.start[partners] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
        for low in range(0, len(theirs), 8192):
            i, j = np.nonzero(a.x[mine] @ b.x[theirs[low : low + 8192]].T >= threshold)
            if len(i):
                found(mine[i], theirs[low + j])


def _points(a: CoverTree, m: int, b: CoverTree, n: int, threshold: float, same: bool, found) -> None:
    left, right = a.order[a.start[m] : a.end[m]], b.order[b.start[n] : b.end[n]]
    for low in range(0, len(left), 512):
        i, j = np.nonzero(a.x[left[low : low + 512]] @ b.x[right].T >= threshold)
        if same:
            i, j = i[i + low < j], j[i + low < j]
        if len(i):
            found(left[low + i], right[j])


def _unit(table: pa.Table) -> np.ndarray:
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(table.num_rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


PAIRS = "node bigint, n_links bigint, other bigint"


def _task(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Links between the two parts of a task, or within its one part; a visitor meets only residents."""
        x, node, weight = _unit(table), table.column("node").to_numpy(), table.column("n").to_numpy()
        second, home = table.column("second").to_numpy(zero_copy_only=False), table.column("home").to_numpy(zero_copy_only=False)
        links = Links(weight)
        sides = [np.flatnonzero(~second), np.flatnonzero(second)] if second.any() else [np.arange(len(node))]
        residents, visitors = [s[home[s]] for s in sides], [s[~home[s]] for s in sides]
        trees = {}

        def tree(points: np.ndarray) -> CoverTree:
            if points.tobytes() not in trees:
                trees[points.tobytes()] = CoverTree(x[points])
            return trees[points.tobytes()]

        if len(sides) == 1:
            pairs = [(residents[0], residents[0]), (residents[0], visitors[0])]
        else:
            pairs = [(residents[0], residents[1]), (residents[0], visitors[1]), (residents[1], visitors[0])]
        for p, q in pairs:
            if len(p) and len(q):
                dual(tree(p), tree(q), threshold, lambda i, j, p=p, q=q: links.add(p[i], q[j]))
        links.settle()
        has = np.flatnonzero((links.count > 0) | (links.label != np.arange(len(node))))
        return pa.table({"node": node[has], "n_links": links.count[has], "other": node[links.label[has]]})

    return run


def _cells(pivots: dict, threshold: float):
    """Each vector to the cell of its nearest pivot, and as a visitor to those smaller cells that may hold a partner.

    A partner in cell k is nearer to pivot k than to the vector's own pivot c,
    so it lies beyond their bisecting plane, whose distance from the vector is
    (d(x,k)^2 - d(x,c)^2) / (2 d(c,k)). Each pair meets in the smaller of its
    two cells.
    """
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-7

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
            take, cell, home = [], [], []
            by: dict = {}
            for n, k in enumerate(keys):
                by.setdefault(k, []).append(n)
            for key, rows in by.items():
                if key not in pivots:
                    take += rows
                    cell += [0] * len(rows)
                    home += [True] * len(rows)
                    continue
                p = pivots[key]
                x = _unit(table.take(rows))
                d2 = np.maximum(0, 2 - 2 * x @ p.T)
                own = d2.argmin(axis=1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
                gap = (d2 - d2[np.arange(len(x)), own][:, None]) / np.maximum(1e-12, 2 * apart[own])
                visit = (gap <= reach) & (np.arange(len(p))[None, :] < own[:, None])
                r, c = np.nonzero(visit)
                take += rows + [rows[k] for k in r.tolist()]
                cell += own.tolist() + c.tolist()
                home += [True] * len(rows) + [False] * len(r)
            out = table.take(pa.array(take, pa.int64()))
            out = out.append_column("cell", pa.array(cell, pa.int32())).append_column("home", pa.array(home, pa.bool_()))
            yield from out.combine_chunks().to_batches(max_chunksize=4096)

    return run


def near_duplicates(vectors: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept): pairs of equal label and cosine >= threshold, in double precision.

    Needs vec_id, embedding, label. A vector links with nothing if it, its
    label or its vec_id is null, if it is empty or zero, or holds a null or
    non-finite component; vectors of different lengths don't link. Equal
    vectors link with each other. Every input row gives a row; repeated rows
    are separate vectors, and what rows with an equal vec_id link with is
    joined under that id. An empty table gives no rows.

    Equal vectors of a label become one with a weight, so large groups of
    copies are one point. Labels with more than ``PART`` distinct vectors are
    divided into the cells of sampled pivots; what a cell holds is dealt by
    hash into parts of at most about ``PART``, and each task joins two parts.
    Tasks return sums and one edge per linked vector, never all pairs.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    sound = F.coalesce(F.expr("vec_id is not null and label is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, e -> e is null or isnan(e) or abs(e) = double('infinity')) and exists(embedding, e -> e <> 0)"), F.lit(False))
    good = rows.where(sound)
    vector = ["label", "embedding"]
    # a node is a distinct vector of a label; its number is written, so it stays
    reps = written(good.groupBy(*vector).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).select(*vector, "rep", "n", F.size("embedding").alias("dim"), F.monotonically_increasing_id().alias("node")), "reps")
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("n_label"))
    large = sizes.where(F.col("n_label") > PART)
    total = large.agg(F.coalesce(F.sum("n_label"), F.lit(0))).first()[0]
    pivots: dict = {}
    if total:
        share = min(1.0, MAX_PIVOTS / total, 2 / PART)
        chosen = reps.join(large, ["label", "dim"], "left_semi").where(F.pmod(F.xxhash64(F.lit("pivot"), "embedding"), F.lit(1 << 40)) < int(share * (1 << 40)))
        for r in chosen.select("label", "dim", "embedding", "node").orderBy("node").limit(2 * MAX_PIVOTS).collect():
            x = np.array(r["embedding"], np.float64)
            x /= np.abs(x).max()
            pivots.setdefault((r["label"], r["dim"]), []).append(x / np.sqrt((x * x).sum()))
        pivots = {k: np.array(v) for k, v in pivots.items() if len(v) > 1}
    schema = f"label {dict(reps.dtypes)['label']}, embedding {dict(reps.dtypes)['embedding']}, node bigint, n bigint, dim int, cell int, home boolean"
    placed = written(reps.select(*vector, "node", "n", "dim").mapInArrow(_cells(pivots, threshold), schema), "cells")
    key = ["label", "dim", "cell"]
    parts = placed.groupBy(*key).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = placed.join(parts, key).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "node"), F.col("parts")).cast("int"))
    tasks = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = tasks.select(*key, F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), (F.col("part") > F.col("with")).alias("second"), "embedding", "node", "n", "home")
    found = written(tasks.groupBy(*key, "p", "q").applyInArrow(_task(threshold), PAIRS), "links")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    # vectors that share a vec_id stand for one row name, so their components are one
    several = good.groupBy("vec_id").agg(F.count("*").alias("rows")).where("rows > 1").select("vec_id")
    shared = good.join(several, "vec_id", "left_semi").join(reps.select(*vector, "node"), vector).select("vec_id", "node").distinct()
    same = shared.join(shared.groupBy("vec_id").agg(F.min("node").alias("b")), "vec_id").select(F.col("node").alias("a"), "b").where("a <> b")
    joined = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(same))
    named = reps.join(counts, "node", "left").join(joined, "node", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    known = named.join(least, "component", "left").select(*vector, (F.coalesce("n_links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = good.join(known, vector).select("vec_id", "n_links", "component_id")
    rest = rows.where(~sound).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).select("vec_id", "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("vec_id")).alias("kept"))

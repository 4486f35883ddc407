"""Exact top-k search by inner product with dual cover trees.

Rows are put in order by PIVOTS cells, each with about PIVOTS cells of its own, drawn from one
bounded sample, and cut into blocks of about BLOCK rows. The upper levels of the tree are
tables: FANOUT neighbouring blocks are a node, as many of these the next one, each with a ball
around all that is below. Queries are grouped in the same way. Every block and every group is indexed by a
cover tree: children cover their points within half the parent's scale, or, where that scale
would not group them, as in many dimensions, around FAN centres that are as far apart as can
be; each node knows its covering radius and its points as one range. A pair of nodes is dropped
when
    q.p + rq |p| + rp |q| + rq rp
for centres q, p and covering radii rq, rp stays below the worst k-th score of the query
node; the queries of a leaf are held one by one against the balls of the data. Leaves are
compared by one matrix product.

Each group first searches the block that it finds by going down to the best node of each level.
The k-th scores found there bound the rest: groups go down again, a level at a time, along all
nodes that pass the same test, and only the blocks reached are joined with their trees.

Defined results: components are floor(1024 x); scores are exact, and beyond 64 bits they are
held at the largest 64-bit value of their sign. Vectors that are null or hold null or
non-finite components, and rows without an id, take no part. Vectors of different length are
not compared. Ties go to the smaller id; rows that repeat the query's id are its own.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.llm.common import map_batches
from corpusgate.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

K = 10
SCALE = 1024.0
PIVOTS = 64          # cells of a level; they only decide who is near whom
FANOUT = 64          # blocks of a node, and nodes of the next one
FAN = 8              # children of a node that the next scale does not group
BLOCK = 4096
GROUP = 512
LEAF = 64            # rows of a leaf of a block
ASKING = 8           # queries of a leaf of a group
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1


# ---- the tree -----------------------------------------------------------------------------------

class Tree:
    """A cover tree over the rows of `x`, flattened; `order` lists rows by node ranges."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.leaf = leaf
        self.order: list[np.ndarray] = []
        self.nodes: list[tuple[int, float, int, int, list[int]]] = []
        self.filled = 0
        first = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1))) if len(x) else 0
        rows = np.argsort(ids, kind="stable")
        if len(x):
            self._build(x, rows, first, self._far(x, rows, first))
        keep = np.concatenate(self.order) if self.order else np.empty(0, np.int64)
        self.centre = np.array([x[n[0]] for n in self.nodes]).reshape(len(self.nodes), x.shape[1])
        self.radius = np.array([n[1] for n in self.nodes])
        self.norm = np.sqrt((self.centre ** 2).sum(axis=1))
        self.lo, self.hi = [n[2] for n in self.nodes], [n[3] for n in self.nodes]
        self.children = [n[4] for n in self.nodes]
        self.x, self.ids = x[keep], ids[keep]
        self.longest = float(np.sqrt((x ** 2).sum(axis=1).max())) if len(x) else 0.0
        del self.order, self.nodes, self.filled

    @staticmethod
    def _far(x: np.ndarray, rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1))

    def _build(self, x: np.ndarray, rows: np.ndarray, centre: int, far: np.ndarray) -> int:
        """Index of the new node over `rows`, whose distances to the centre are `far`."""
        me, lo, radius = len(self.nodes), self.filled, float(far.max())
        self.nodes.append(None)
        children = []
        if len(rows) > self.leaf and radius > 0:
            for own, c, d in (self._net(x, rows, centre, far, radius / 2)
                              or self._apart(x, rows, centre, far)):
                children.append(self._build(x, own, c, d))
        if not children:
            self.order.append(rows)
            self.filled += len(rows)
        self.nodes[me] = (centre, radius, lo, self.filled, children)
        return me

    def _net(self, x, rows, centre, far, scale):
        """Centres further than `scale` apart that cover the rows, with the rows nearest first.

        Empty if FAN centres cover less than half, or more than two a leaf would be needed.
        """
        found, free, d = [], np.ones(len(rows), bool), far
        c = centre
        while True:
            own = free & (d <= scale)
            found.append((rows[own], c, d[own]))
            free &= ~own
            rest = np.flatnonzero(free)
            if not len(rest):
                return [f for f in found if len(f[0])]
            few = len(found) >= FAN and 2 * len(rest) > len(rows)
            if few or len(found) > 2 * len(rows) // self.leaf:
                return []
            c = int(rows[rest[0]])
            d = self._far(x, rows, c)


    def _apart(self, x, rows, centre, far):
        """Up to FAN centres, each the row farthest from those before, with the rows nearest."""
        centres, d, own = [centre], far.copy(), np.zeros(len(rows), np.int64)
        while len(centres) < FAN and d.max() > 0:
            c = int(rows[int(np.argmax(d))])
            new = self._far(x, rows, c)
            closer = new < d
            own[closer], d[closer] = len(centres), new[closer]
            centres.append(c)
        return [(rows[own == i], c, d[own == i]) for i, c in enumerate(centres) if (own == i).any()]


class Best:
    """The k best of every query so far: score descending, then id."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None):
        self.k = k
        self.scores: list[list] = [[] for _ in range(n)]
        self.ids: list[list[int]] = [[] for _ in range(n)]
        # What a candidate must reach; scores found elsewhere may already demand more.
        self.floor = np.full(n, -np.inf) if floor is None else floor.copy()

    def offer(self, i: int, scores: list, ids: list[int]):
        both = sorted(zip([-s for s in self.scores[i] + scores], self.ids[i] + ids))[:self.k]
        self.scores[i], self.ids[i] = [-s for s, _ in both], [v for _, v in both]
        if len(both) == self.k:
            self.floor[i] = max(self.floor[i], float(-both[-1][0]))


def _compare(q: Tree, a: int, p: Tree, rows, best: Best):
    """All points of a query leaf against rows of the data."""
    qlo, qhi = q.lo[a], q.hi[a]
    x, y, ids = q.x[qlo:qhi], p.x[rows], p.ids[rows]
    if q.longest * p.longest < EXACT:
        scores = x @ y.T
    else:
        whole = np.vectorize(int, otypes=[object])
        scores = whole(x).dot(whole(y).T) if len(x) and len(y) else np.empty((0, 0))
    same = q.ids[qlo:qhi, None] == ids[None, :]
    approx = np.where(same, -np.inf, scores.astype(np.float64))
    n, k = len(ids), best.k
    kth = np.partition(approx, n - k, axis=1)[:, n - k] if n > k else np.full(len(x), -np.inf)
    need = np.maximum(kth, best.floor[qlo:qhi])
    need = need - np.abs(need) * 1e-12 if scores.dtype == object else need
    for i in np.flatnonzero((approx >= need[:, None]).any(axis=1)):
        at = np.flatnonzero((approx[i] >= need[i]) & ~same[i])
        if len(at) > 4 * k and scores.dtype != object:  # many ties: the smaller ids of them
            at = at[np.lexsort((ids[at], -approx[i, at]))[:k]]
        best.offer(qlo + i, [int(scores[i, j]) for j in at], ids[at].tolist())


def _bound(q: Tree, a: int, p: Tree, b) -> np.ndarray:
    """The largest inner product that points of the two nodes can have, rounded up."""
    dot = p.centre[b] @ q.centre[a]
    top = (dot + q.radius[a] * p.norm[b] + p.radius[b] * q.norm[a] + q.radius[a] * p.radius[b])
    return top + np.abs(top) * 1e-9 + q.norm[a] * p.norm[b] * 1e-9 + 1


def _reaches(q: Tree, a: int, p: Tree, b: list[int], best: Best) -> tuple[np.ndarray, np.ndarray]:
    """(whether each data node may hold what a query of the leaf demands, its largest product)."""
    lo, hi = q.lo[a], q.hi[a]
    x = q.x[lo:hi]
    norm = np.sqrt((x ** 2).sum(axis=1))[:, None]
    top = x @ p.centre[b].T + norm * p.radius[b]
    top += np.abs(top) * 1e-9 + norm * p.norm[b] * 1e-9 + 1
    return (top >= best.floor[lo:hi, None]).any(axis=0), top.max(axis=0)


def _open_leaves(q: Tree, a: int, p: Tree, b: int, best: Best) -> list[int]:
    """Leaves under a data node that no ball above them rules out, most promising first."""
    level, found, tops = [b], [], []
    while level:
        open_, top = _reaches(q, a, p, level, best)
        below = []
        for node, is_open, t in zip(level, open_.tolist(), top.tolist()):
            if is_open and p.children[node]:
                below += p.children[node]
            elif is_open:
                found.append(node)
                tops.append(t)
        level = below
    return [found[i] for i in np.argsort(-np.array(tops), kind="stable")]


def _rows(p: Tree, nodes: list[int]) -> np.ndarray:
    return np.concatenate([np.arange(p.lo[n], p.hi[n]) for n in nodes])


def dual_search(q: Tree, p: Tree, best: Best):
    """Descend both trees together.

    Query nodes whose ball the data's root cannot serve are dropped; a query leaf then goes down
    the data, and meets its leaves in growing lots, the most promising first, so that what
    the first lots give rules out the balls of the others.
    """
    stack = [0] if len(q.ids) and len(p.ids) else []
    while stack:
        a = stack.pop()
        if _bound(q, a, p, [0])[0] < best.floor[q.lo[a]:q.hi[a]].min():
            continue
        if q.children[a]:
            stack += q.children[a]
            continue
        waiting, lot = _open_leaves(q, a, p, 0, best), 1
        while waiting:
            _compare(q, a, p, _rows(p, waiting[:lot]), best)
            waiting, lot = waiting[lot:], 4 * lot
            if waiting:
                open_, _top = _reaches(q, a, p, waiting, best)
                waiting = [n for n, is_open in zip(waiting, open_.tolist()) if is_open]


# ---- blocks -------------------------------------------------------------------------------------

def usable(vector: str) -> Column:
    def finite(v):
        d = v.cast("double")
        return v.isNotNull() & ~F.isnan(d) & (F.abs(d) < float("inf"))
    return F.col(vector).isNotNull() & F.forall(vector, finite)


class Cells:
    """Two levels of pivots: the first PIVOTS rows of a sample, and the others below them."""

    def __init__(self, sample: list):
        self.levels = {}
        by_dim: dict[int, list] = {}
        for v in sample:
            by_dim.setdefault(len(v), []).append(np.floor(np.array(v, np.float64) * SCALE))
        for dim, rows in by_dim.items():
            top, rest = np.array(rows[:PIVOTS]), rows[PIVOTS:]
            below = [[t] for t in top]
            for r in rest:
                below[self._near(top, r)].append(r)
            self.levels[dim] = top, [np.array(b) for b in below]

    @staticmethod
    def _near(pivots: np.ndarray, x: np.ndarray) -> int:
        return int(((pivots - x) ** 2).sum(axis=1).argmin())

    def of(self, x: np.ndarray) -> tuple[int, int]:
        if len(x) not in self.levels:
            return 0, 0
        top, below = self.levels[len(x)]
        cell = self._near(top, x)
        return cell, self._near(below[cell], x)


def _celled(rows: DataFrame, sample: list) -> DataFrame:
    """(id, dim, cell, sub, v): integer components packed as doubles, and the nearest pivots."""
    def make():
        cells = Cells(sample)

        def work(batch):
            out = {"id": batch["id"], "dim": [], "cell": [], "sub": [], "v": []}
            for v in batch["v"]:
                x = np.floor(np.array(v, np.float64) * SCALE)
                cell, sub = cells.of(x)
                for name, value in zip(("dim", "cell", "sub", "v"), (len(x), cell, sub, x.tobytes())):
                    out[name].append(value)
            return out
        return work

    return map_batches(rows, make, "id BIGINT, dim INT, cell INT, sub INT, v BINARY")


def _dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
    """`rows` with a part number: neighbouring small cells share one, large cells are split.

    The table of cells has about PIVOTS ^ 2 rows per vector length. What is larger than a block
    at the lowest level is split by hash.
    """
    cells = rows.groupBy("dim", "cell", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("dim").orderBy("cell", "sub").rowsBetween(
        Window.unboundedPreceding, -1)
    cells = cells.withColumn("first", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / size)
                             ).withColumn("parts", F.ceil(F.col("n") / size))
    part = F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))
    return rows.join(cells, ["dim", "cell", "sub"]).select(
        "id", "dim", "v", part.cast("int").alias(name))


_PART = "dim INT, part INT, n INT, centre ARRAY<DOUBLE>, radius DOUBLE, norm DOUBLE, tree BINARY"


def _index(rows: DataFrame, size: int, leaf: int) -> DataFrame:
    """One row per part, with its tree."""
    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["v"]), np.float64).reshape(len(pdf), key[0])
        tree = Tree(x, pdf["id"].to_numpy(np.int64), leaf)
        return pd.DataFrame({"dim": [key[0]], "part": [key[1]], "n": [len(pdf)],
                             "centre": [tree.centre[0]], "radius": [tree.radius[0]],
                             "norm": [tree.norm[0]], "tree": [pickle.dumps(tree.__dict__)]})

    return _dealt(rows, size, "part").groupBy("dim", "part").applyInPandas(grow, _PART)


def _tree(data: bytes) -> Tree:
    tree = Tree.__new__(Tree)
    tree.__dict__.update(pickle.loads(data))
    return tree


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """(dim, grp, query_id, vec_id, score) of every joined pair of group and block."""
    def make():
        def work(batch):
            out = {"dim": [], "grp": [], "query_id": [], "vec_id": [], "score": []}
            for dim, grp, qt, pt, floor in zip(batch["dim"], batch["grp"], batch["q"],
                                               batch["p"], batch["floor"]):
                q, p = _tree(qt), _tree(pt)
                best = Best(len(q.ids), k, None)
                if floor is not None:
                    known = dict(zip(floor["id"], floor["score"]))
                    best.floor = np.array([known.get(i, -np.inf) for i in q.ids.tolist()],
                                          np.float64)
                dual_search(q, p, best)
                for i, query in enumerate(q.ids.tolist()):
                    n = len(best.ids[i])
                    out["dim"] += [dim] * n
                    out["grp"] += [grp] * n
                    out["query_id"] += [query] * n
                    out["vec_id"] += best.ids[i]
                    out["score"] += [max(-LARGEST - 1, min(LARGEST, s)) for s in best.scores[i]]
            return out
        return work

    return map_batches(pairs.select("dim", "grp", "q", "p", "floor"), make,
                       "dim INT, grp INT, query_id BIGINT, vec_id BIGINT, score BIGINT")


def _reach() -> list[Column]:
    """(dot, top): inner product of two centres, and the largest that points of both can have."""
    dot = F.aggregate(F.zip_with("gc", "bc", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    top = (dot + F.col("gr") * F.col("bn") + F.col("br") * F.col("gn")
           + F.col("gr") * F.col("br"))
    return [dot.alias("dot"), (top + F.abs(top) * 1e-9 + F.col("gn") * F.col("bn") * 1e-9 + 1)
            .alias("top")]


def _covers(nodes: DataFrame) -> DataFrame:
    """(dim, node, bc, br, bn): one ball around every FANOUT neighbouring nodes."""
    own = nodes.withColumn("up", F.floor(F.col("node") / FANOUT).cast("int"))
    first = own.groupBy("dim", "up").agg(F.min_by(F.struct("bc", "bn"), "node").alias("c"))
    apart = F.sqrt(F.aggregate(F.zip_with("bc", F.col("c.bc"), lambda a, b: (a - b) * (a - b)),
                               F.lit(0.0), lambda s, v: s + v))
    return own.join(first, ["dim", "up"]).groupBy("dim", "up").agg(
        F.first("c").alias("c"), F.max(apart * (1 + 1e-12) + F.col("br")).alias("br")).select(
        "dim", F.col("up").alias("node"), "c.bc", "br", "c.bn")


def _levels(blocks: DataFrame) -> list[DataFrame]:
    """Nodes of every level, blocks first; the last level has at most FANOUT per length."""
    levels = [materialize(blocks.select(
        "dim", F.col("part").alias("node"), F.col("centre").alias("bc"), F.col("radius").alias("br"),
        F.col("norm").alias("bn")), "nodes")]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last >= FANOUT:
        levels.append(materialize(_covers(levels[-1]), "nodes"))
        last //= FANOUT
    return levels


def _descend(asks: DataFrame, levels: list[DataFrame], keep: Callable[[DataFrame], DataFrame]):
    """(dim, grp, node): the blocks that groups come to, `keep` choosing nodes on every level."""
    on = None
    for i, nodes in enumerate(reversed(levels)):
        if on is None:
            pairs = asks.join(nodes, "dim")
        else:
            below = nodes.withColumn("up", F.floor(F.col("node") / FANOUT).cast("int"))
            pairs = on.withColumnRenamed("node", "up").join(asks, ["dim", "grp"]).join(
                below, ["dim", "up"])
        on = materialize(keep(pairs.select("dim", "grp", "node", *_reach())).select(
            "dim", "grp", "node"), "descent")
    return on


def search(vectors: DataFrame, queries: Callable[[Column], Column], id_col: str = "vec_id",
           vector_col: str = "embedding", k: int = K, block: int = BLOCK,
           group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of every row that `queries` names.

    `queries` makes a condition of the id column.
    """
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    sample = [r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS ** 2).collect()]
    celled = materialize(_celled(rows, sample), "vectors")
    asked = celled.where(queries(F.col("id"))).dropDuplicates(["id"])
    blocks = materialize(_index(celled, block, LEAF), "blocks")
    groups = materialize(_index(asked, group, ASKING).withColumnRenamed("part", "grp"), "groups")
    asks = groups.select("dim", "grp", F.col("centre").alias("gc"), F.col("radius").alias("gr"),
                         F.col("norm").alias("gn"))
    levels = _levels(blocks)
    best = Window.partitionBy("dim", "grp").orderBy(F.desc("dot"), "node")
    home = _descend(asks, levels, lambda pairs: pairs.withColumn(
        "place", F.row_number().over(best)).where("place = 1"))
    q = groups.select("dim", "grp", F.col("tree").alias("q"))
    p = blocks.select("dim", F.col("part").alias("node"), F.col("tree").alias("p"))
    none = F.lit(None).cast("struct<id:array<bigint>,score:array<bigint>>")
    first = materialize(_search(home.join(q, ["dim", "grp"]).join(p, ["dim", "node"]).withColumn(
        "floor", none), k), "first")
    # A group has at most twice GROUP queries, so its list of k-th scores is bounded.
    kth = first.groupBy("dim", "grp", "query_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
    floors = kth.groupBy("dim", "grp").agg(
        F.min("score").alias("worst"), F.count(F.lit(1)).alias("sure"),
        F.struct(F.collect_list("query_id").alias("id"),
                 F.collect_list("score").alias("score")).alias("floor"))
    floors = materialize(floors, "floors")
    sizes = groups.select("dim", "grp", F.col("n").alias("asking"))
    demand = materialize(sizes.join(
        floors.select("dim", "grp", "worst", "sure"), ["dim", "grp"], "left").select(
        "dim", "grp", F.when(F.col("sure") >= F.col("asking"), F.col("worst")).alias("least")), "demand")
    passes = F.col("least").isNull() | (F.col("top") >= F.col("least"))
    rest = _descend(asks, levels, lambda pairs: pairs.join(demand, ["dim", "grp"]).where(passes))
    asked_more = (rest.join(home, ["dim", "grp", "node"], "left_anti").join(q, ["dim", "grp"])
                  .join(floors.select("dim", "grp", "floor"), ["dim", "grp"], "left")
                  .join(p, ["dim", "node"]))
    found = first.unionByName(_search(asked_more, k))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", "vec_id", "score").withColumn(
        "rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

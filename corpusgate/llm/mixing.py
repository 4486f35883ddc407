"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. The words
of a pattern can flow to the quota of any of its sources: the first copy at no cost, each
further copy at a higher one, so repetition is spread before it deepens. Patterns are linked
through the sources they share, and a flow is solved per linked group of sources, so groups
are solved in parallel and sources that overlap with nothing are groups of their own. The
words that flow out of a pattern are then given to its documents: whole passes over all of
them, and the rest to documents in seeded hash order.

Sources are numbered by code point, null last, and weigh 5, 2, 1 in turn. Their targets
share BUDGET times all words by weight; a target stops at REPEATS times the words of its
source, and the excess is shared again by weight until none is above.

Defined results: a null text has size 0 and nothing of it is taken; a null source is a source
like any other; rows that repeat an id are documents of their own (with equal hash order);
a document is taken whole, so a source misses its target by at most half a document; an
empty table gives no rows.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.llm.common import WORD, components, fresh
from corpusgate.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
REPEATS = 2
SEED = 7
BINS = 1 << 12    # bins of the hash order within a pattern


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def sized(docs: DataFrame, id_col: str, text_col: str, members: Column) -> DataFrame:
    """(id, members, size, place): what mixing needs of every document.

    `members` is the sorted array of sources of a document, each a struct (none, name) that
    puts null last.
    """
    return docs.select(F.col(id_col).alias("id"), members.alias("members"),
                       size_of(F.col(text_col)).alias("size"),
                       F.xxhash64(F.lit(SEED), F.col(id_col)).alias("place"))


def single(source_col: str) -> Column:
    """Membership of a document that has one source."""
    name = F.col(source_col).cast("string")
    return F.array(F.struct(name.isNull().alias("none"), F.coalesce(name, F.lit("")).alias("name")))


def overlapping(sources_col: str) -> Column:
    """Membership from an array of source names; an empty or null array is the null source."""
    names = F.when(F.size(sources_col) > 0, F.col(sources_col)).otherwise(
        F.array(F.lit(None).cast("string")))
    return F.array_sort(F.array_distinct(F.transform(names, lambda s: F.struct(
        s.isNull().alias("none"), F.coalesce(s, F.lit("")).alias("name")))))


def targets_of(patterns: DataFrame, budget: float = BUDGET, repeats: int = REPEATS,
               weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target). A document of several sources counts in each.

    The table of sources stays in Spark. The driver only sees three sums per round, and a
    round without a newly stopped source is the last.
    """
    sizes = patterns.select(F.explode("members").alias("source"), "size").groupBy("source").agg(
        F.sum("size").alias("source_size"))
    # A source's number is its place in its range plus the sizes of the ranges before.
    spark = patterns.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(sizes.repartitionByRange(ranges, "source").withColumn(
        "range", F.spark_partition_id()), "sources")
    before = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select(
        "range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.col("before") + F.row_number().over(
        Window.partitionBy("range").orderBy("source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    rows = materialize(ranged.join(before, "range").select(
        "source", "source_size", weight.alias("weight"),
        (F.col("source_size") * float(repeats)).alias("most")), "weights")
    total = patterns.agg(F.sum("size").alias("s")).first()["s"] or 0
    level, stopped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) >= F.col("most")
        got = rows.agg(F.sum(F.when(over, F.col("most")).otherwise(0.0)).alias("full"),
                       F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("open"),
                       F.count_if(over).alias("n")).first()
        if got["n"] == stopped or not got["open"]:
            break
        stopped = got["n"]
        level = (budget * total - got["full"]) / got["open"]
    return rows.select("source", "source_size", F.least(
        F.col("weight") * F.lit(level), "most").alias("target"))


# ---- the flow -----------------------------------------------------------------------------------

def min_cost_flow(size: list[int], routes: list[list[int]], quota: list[float],
                  repeats: int) -> list[list[float]]:
    """Words from pattern i to its j-th source; convex costs 0, 1, 3, ... per copy.

    Successive cheapest paths. Every pattern is a node with `repeats` arcs of its size from
    the start; every source has an arc of its quota to the end.
    """
    n, m = len(size), len(quota)
    start, end = n + m, n + m + 1
    to, room, cost, arcs = [], [], [], [[] for _ in range(n + m + 2)]

    def arc(a: int, b: int, r: float, c: float):
        for x, y, left, price in ((a, b, r, c), (b, a, 0.0, -c)):
            arcs[x].append(len(to))
            to.append(y)
            room.append(left)
            cost.append(price)

    for i in range(n):
        for copy in range(repeats):
            arc(start, i, float(size[i]), copy * (copy + 1) / 2)
    first = len(to)
    for i, r in enumerate(routes):
        for j in r:
            arc(i, n + j, float(size[i]) * repeats, 0.0)
    for j in range(m):
        arc(n + j, end, quota[j], 0.0)
    tiny = 1e-9 * max(1.0, sum(quota))
    while True:
        far, via = [float("inf")] * (n + m + 2), [-1] * (n + m + 2)
        far[start], queue, queued = 0.0, [start], {start}
        for x in queue:
            queued.discard(x)
            for e in arcs[x]:
                y = to[e]
                if room[e] > tiny and far[x] + cost[e] < far[y] - 1e-12:
                    far[y], via[y] = far[x] + cost[e], e
                    if y not in queued:
                        queue.append(y)
                        queued.add(y)
        if via[end] < 0:
            break
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push
    out, e = [], first
    for r in routes:
        out.append([room[e + 2 * j + 1] for j in range(len(r))])
        e += 2 * len(r)
    return out


def _solve(repeats: int):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values("key")
        names: dict[tuple, int] = {}
        quota: list[float] = []
        routes = []
        for keys, targets in zip(order["sources"], order["targets"]):
            route = []
            for k, t in zip(keys, targets):
                if k not in names:
                    names[k] = len(quota)
                    quota.append(float(t))
                route.append(names[k])
            routes.append(route)
        flow = min_cost_flow(order["size"].tolist(), routes, quota, repeats)
        return pd.DataFrame({"key": order["key"], "size": order["size"],
                             "flow": [float(np.sum(f)) for f in flow]})
    return solve


def route(patterns: DataFrame, targets: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(key, size, flow): words that each pattern gives, from the min-cost flows."""
    key = F.concat_ws("\x01", F.transform("members", lambda m: F.concat(
        m["none"].cast("string"), F.lit(":"), m["name"])))
    keyed = patterns.withColumn("key", key)
    name = F.concat(F.col("source.none").cast("string"), F.lit(":"), F.col("source.name"))
    parts = keyed.select("key", "size", F.explode("members").alias("source")).join(
        targets, "source").select("key", "size", name.alias("source"), "target")
    first = keyed.select("key", F.col("members")[0].alias("s0"), F.explode("members").alias("m"))
    tag = lambda c: F.concat(F.col(f"{c}.none").cast("string"), F.lit(":"), F.col(f"{c}.name"))
    pairs = first.select(tag("s0").alias("a"), tag("m").alias("b")).distinct()
    groups = components(pairs)
    rows = parts.groupBy("key", "size").agg(
        F.sort_array(F.collect_list(F.struct("source", "target"))).alias("to"))
    rows = rows.select("key", "size", F.col("to.source").alias("sources"),
                       F.col("to.target").alias("targets"))
    rows = rows.join(groups, F.col("sources")[0] == F.col("node")).drop("node")
    return rows.groupBy("grp").applyInPandas(
        lambda pdf: _solve(repeats)(pdf), "key STRING, size BIGINT, flow DOUBLE")


# ---- selection ----------------------------------------------------------------------------------

def select(docs: DataFrame, flows: DataFrame) -> DataFrame:
    """(id, size, key, copies): how often every document is taken.

    A pattern's flow is `passes` copies of everything and a rest. For the rest, sizes are
    summed per bin of the hash order; bins before the one where the sum crosses the rest are
    taken whole, and only the documents of that one bin are put in order.
    """
    per_bin = docs.groupBy("key", "bin").agg(F.sum("size").alias("words"))
    until = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    passes = F.when(F.col("total") > 0, F.floor(F.col("flow") / F.col("total") + 1e-12)).otherwise(0)
    plan = flows.select(F.col("key").alias("k"), F.col("size").alias("total"), "flow").withColumn(
        "passes", passes).withColumn("rest", F.col("flow") - F.col("passes") * F.col("total"))
    bins = per_bin.withColumn("before", F.coalesce(F.sum("words").over(until), F.lit(0))).join(
        plan, F.col("key") == F.col("k"))
    bins = bins.select(F.col("key").alias("k"), F.col("bin").alias("b"), "passes", "rest", "before",
                       (F.col("before") + F.col("words") <= F.col("rest")).alias("whole"),
                       (F.col("before") < F.col("rest")).alias("reached"))
    rows = docs.join(bins, (F.col("key") == F.col("k")) & (F.col("bin") == F.col("b")))
    cut = F.col("reached") & ~F.col("whole")
    # Ids repeat only for repeated rows, which are interchangeable.
    inside = Window.partitionBy("k", "b").orderBy("place", "id").rowsBetween(
        Window.unboundedPreceding, -1)
    edge = rows.where(cut).withColumn("run", F.col("before") + F.coalesce(
        F.sum("size").over(inside), F.lit(0)))
    more = F.when(F.col("run") + F.col("size") / 2 < F.col("rest"), 1).otherwise(0)
    taken = lambda extra: F.when(F.col("size") > 0, F.col("passes") + extra).otherwise(
        0).cast("bigint").alias("copies")
    sure = rows.where(~cut).select("id", "size", "key", taken(F.when(F.col("whole"), 1).otherwise(0)))
    return sure.unionByName(edge.select("id", "size", "key", taken(more)))


def plan(docs: DataFrame, members: Column, id_col: str = "doc_id", text_col: str = "text",
         budget: float = BUDGET, repeats: int = REPEATS,
         weights: tuple[float, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """(documents with copies, targets): id, size, key, copies; source, source_size, target."""
    key = F.concat_ws("\x01", F.transform("members", lambda m: F.concat(
        m["none"].cast("string"), F.lit(":"), m["name"])))
    rows = materialize(sized(docs, id_col, text_col, members).withColumn("key", key).withColumn(
        "bin", F.pmod(F.shiftrightunsigned("place", 20), F.lit(BINS)).cast("int")).withColumn(
        "place", F.struct(F.col("bin"), F.col("place"))), "sized")
    patterns = materialize(rows.groupBy("members").agg(F.sum("size").alias("size")), "patterns")
    targets = materialize(targets_of(patterns, budget, repeats, weights), "targets")
    flows = materialize(route(patterns, targets, repeats), "flows")
    return select(rows, flows), targets


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id",
        text_col: str = "text") -> DataFrame:
    """(id, size, source_size, target, taken) for documents of one source each."""
    chosen, targets = plan(docs, single(source_col), id_col, text_col)
    named = targets.select(F.concat(F.col("source.none").cast("string"), F.lit(":"),
                                    F.col("source.name")).alias("t"), "source_size", "target")
    return chosen.join(named, F.col("key") == F.col("t")).select(
        F.col("id").alias(id_col), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"))


def draw_mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The documents of the mix, with all their columns, each as often as it is taken."""
    chosen, _targets = plan(docs, single(source_col), id_col, text_col)
    # Rows that repeat an id, or have none, share one decision: the largest of theirs.
    copies = chosen.groupBy("id").agg(F.max("copies").alias("n")).where("n > 0")
    copies = copies.select(F.col("id").alias("_cg_id"), F.col("n").alias("_cg_n"))
    rows = docs.join(copies, docs[id_col].eqNullSafe(F.col("_cg_id")))
    again, = fresh(rows, "copy")
    return rows.withColumn(again, F.explode(F.sequence(F.lit(1), F.col("_cg_n")))).select(
        *[docs[c] for c in docs.columns])

"""The Merkle manifest against a tree built by hand."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corpusgate.llm import merkle

DDL = "doc_id BIGINT, source STRING, lang STRING, n_chars BIGINT, text STRING"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes, arity):
    """(root, siblings of every node, level by level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, place in enumerate(at):
            lo = place // arity * arity
            paths[i].append((nodes[lo:place], nodes[place + 1:lo + arity]))
            at[i] = place // arity
        nodes = [h(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def by_hand(rows, arity):
    """Sorted (id, leaf, subroot, root, siblings) of rows."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[s])], arity) for s in order]
    root, over = climb([t[0] for t in trees], arity)
    out = []
    for s, (sub, paths), up in zip(order, trees, over):
        for (known, i, own), path in zip(sorted(groups[s]), paths):
            steps = path + up
            out.append((i if known else None, own, sub, root,
                        "".join("".join(a + b) for a, b in steps)))
    return sorted(out, key=str)


def rows_of(n):
    rng = random.Random(n)
    rows = [(i, rng.choice([None, "", "a", "a", "a", "é", "b"]), rng.choice(["en", None]),
             rng.choice([None, i]), rng.choice([None, "", "x\ny", "ü" * 50, "12:-"]))
            for i in range(n)]
    return rows + [rows[0], rows[0], (None, "a", None, None, None), (1, "a", "other", None, "t\n")]


@pytest.mark.parametrize("n,arity,height", [(1, 3, 5), (40, 3, 1), (200, 3, 2), (70, 2, 1), (90, 3, 5)])
def test_equals_tree_by_hand(spark, n, arity, height):
    rows = rows_of(n)
    docs = spark.createDataFrame(rows, DDL).repartition(5)
    out = merkle.manifest(docs, arity=arity, height=height)
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path"))).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand(rows, arity)
    assert out.where(merkle.fold(F.col("path"), F.col("leaf")) != F.col("root")).count() == 0


def test_many_sources_and_one_hot_source(spark):
    rows = [(i, f"s{i % 30}" if i % 3 else "hot", "en", i, str(i)) for i in range(120)]
    out = merkle.manifest(spark.createDataFrame(rows, DDL), height=1)
    got = out.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path"))).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand(rows, 3)


def test_tampering_is_found(spark):
    rows = [(i, "a", None, None, t) for i, t in enumerate(["x\ny", "x", None, "", "\n", "z\n" * 40000])]
    docs = spark.createDataFrame(rows, DDL)
    out = merkle.tamper_check(docs, F.expr("replace(text, '\\n', '')")).collect()
    assert {r["doc_id"] for r in out if not r["verified"]} == {0, 4, 5}
    assert all((r["folded_root"] == r["root"]) == r["verified"] for r in out)


def test_empty_table_and_clashing_columns(spark):
    ddl = DDL + ", grp STRING, place INT, node STRING, total INT, path STRING, id INT, top INT, leaf INT"
    docs = spark.createDataFrame([(1, "a", "en", 1, "t", *[None] * 8), (2, "a", "en", 1, "u", *["9", 9] * 2, "9", 9, 9, 9)], ddl)
    out = merkle.tamper_check(docs, F.col("text")).collect()
    assert [r["verified"] for r in out] == [True, True]
    assert out[0]["root"] == h(leaf((1, "a", "en", 1, "t")), leaf((2, "a", "en", 1, "u")))
    assert merkle.manifest(docs.where("false")).count() == 0

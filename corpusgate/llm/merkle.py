"""Merkle manifest of a dataset, with a proof for every row.

Leaves are the digests of rows; those of a source, in order of their ids, form a tree in which
ARITY consecutive nodes have one parent, and the roots of the sources form another one above.
ARITY ^ HEIGHT aligned leaves are a block. A block keeps each of its levels as one string of
hex digests that follow each other: a parent is the hash of a fixed-width substring, and the
substrings on both sides of a node are its siblings. The tops of the blocks are the leaves
of the next layer, which is cut into blocks in the same way, until one block holds a whole
tree. A source of any size so takes part as many small rows; no task and no row holds more
than a block, and the number of layers is a logarithm of the largest source.

Defined results: leaves ascend by id, null first, and rows of equal ids by their digests;
rows that repeat each other have neighbouring leaves of the same digest; a null field is
hashed as `-`; rows with a null source are a source of their own, the first; a source of one
row has its leaf as its root, and a single source has its root as that of the dataset; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import placed
from corpusgate.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
HEIGHT = 5          # levels of a block
WIDTH = 64          # hex characters of a digest


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """A field with its length in bytes, so that no two rows run into the same text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: list[Column]) -> Column:
    return digest(F.concat(*[field(f) for f in fields]))


class Block:
    """Expressions over one block: `own` is its sorted array of structs with a `node`."""

    def __init__(self, arity: int, height: int):
        self.arity, self.height = arity, height
        self.names = [f"level{i}" for i in range(height + 1)]

    def _stands(self, i: int) -> Column:
        """Whether level i is the top already: one node in a block that is a whole tree."""
        return (F.col("total") <= self.arity ** self.height) & (
            F.octet_length(self.names[i]) == WIDTH)

    def with_levels(self, blocks: DataFrame) -> DataFrame:
        """`blocks` with level0 to level{height}; the last one is a single node."""
        run = self.arity * WIDTH
        nodes = F.array_join(F.transform("own", lambda x: x["node"]), "").cast("binary")
        blocks = blocks.withColumn(self.names[0], nodes)
        for i in range(self.height):
            level = F.col(self.names[i])
            last = F.ceil(F.octet_length(level) / F.lit(run)).cast("int") - 1
            runs = F.transform(F.sequence(F.lit(0), last), lambda r: F.substring(
                level, r * run + 1, F.lit(run)))  # noqa: B023
            up = F.array_join(F.transform(runs, lambda r: F.sha2(r, 256)), "").cast("binary")
            blocks = blocks.withColumn(self.names[i + 1], F.when(self._stands(i), level).otherwise(up))
        return blocks

    def path(self, at: Column) -> Column:
        """Siblings (before, after) of the node at a place, level by level."""
        steps = []
        for i in range(self.height):
            level = F.col(self.names[i])
            node = F.floor(at / F.lit(self.arity ** i)).cast("int")
            own = node % self.arity
            before = F.substring(level, (node - own) * WIDTH + 1, own * WIDTH)
            after = F.substring(level, (node + 1) * WIDTH + 1, (self.arity - 1 - own) * WIDTH)
            steps.append(F.when(~self._stands(i), F.struct(
                before.cast("string").alias("before"), after.cast("string").alias("after"))))
        return F.array_compact(F.array(*steps))


def _inside(layer: DataFrame, block: Block, carried: list[str], *keep: str) -> DataFrame:
    """One row per node of a layer: its place, carried columns and way to its block's top."""
    nodes = F.transform("own", lambda x, i: F.struct(
        x["place"].alias("place"), x["node"].alias("node"), block.path(i).alias("inside"),
        *[x[c].alias(c) for c in carried]))
    return layer.select("grp", "block", F.explode(nodes).alias("x"), *keep).select(
        "grp", "block", *keep, "x.*")


def grow(rows: DataFrame, carried: list[str], arity: int, height: int) -> DataFrame:
    """(grp, place, node, path, top, carried columns) of rows (grp, place, total, node, ...)."""
    block, size = Block(arity, height), arity ** height
    layers, most, extra = [], rows.agg(F.max("total")).first()[0] or 0, carried
    while True:
        cut = rows.groupBy("grp", F.floor(F.col("place") / F.lit(size)).alias("block")).agg(
            F.max("total").alias("total"),
            F.sort_array(F.collect_list(F.struct("place", "node", *extra))).alias("own"))
        layers.append(materialize(block.with_levels(cut), "blocks"))
        if most <= size:
            break
        rows = layers[-1].where(F.col("total") > size).select(
            "grp", F.col("block").alias("place"), F.col(block.names[-1]).cast("string").alias("node"),
            F.ceil(F.col("total") / F.lit(size)).alias("total"))
        most, extra = -(-most // size), []
    above = None
    for j in reversed(range(len(layers))):
        ends = layers[j].where(F.col("total") <= size).select(
            "grp", "block", F.array().cast(_PATH).alias("path"),
            F.col(block.names[-1]).cast("string").alias("top"))
        if above is not None:
            upper = _inside(layers[j + 1], block, []).join(above, ["grp", "block"])
            ends = ends.unionByName(upper.select(
                "grp", F.col("place").alias("block"), F.concat("inside", "path").alias("path"), "top"))
        above = ends
    above = materialize(above, "above")
    return _inside(layers[0], block, carried).join(above, ["grp", "block"]).select(
        "grp", "place", "node", F.concat("inside", "path").alias("path"), "top", *carried)


_PATH = "array<struct<before:string,after:string>>"


def fold(path: Column, node: Column) -> Column:
    """The root above a node with these siblings."""
    return F.aggregate(path, node, lambda h, s: F.sha2(
        F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path, from the leaf to the root and from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id",
             source_col: str = "source", carry: dict[str, Column] | None = None,
             arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """(id, source, leaf, path, subroot, root, carried columns) of every row.

    `path` lists the siblings of the leaf up to the root of the dataset, so
    `fold(path, leaf)` is `root`.
    """
    carry = carry or {}
    source = F.col(source_col).cast("string")
    leaves = materialize(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("grp"),
        leaf([F.col(f) for f in fields]).alias("node"),
        *[c.alias(n) for n, c in carry.items()]), "leaves")
    carried = ["id", *carry]
    rows = grow(placed(leaves, [F.col("id"), F.col("node")], ["grp"]), carried, arity, height)
    # One row per source, and the tree above them.
    tops = rows.where("place = 0").select("grp", F.col("top").alias("node"))
    tops = placed(materialize(tops, "tops"), [F.col("grp")], [])
    over = grow(tops.withColumn("name", F.col("grp")).withColumn("grp", F.lit("")), ["name"],
                arity, height)
    over = materialize(over.select(F.col("name").alias("grp"), F.col("path").alias("over"),
                                   F.col("top").alias("root")), "roots")
    return rows.join(over, "grp").select(
        F.col("id").alias(id_col),
        F.when(F.col("grp") != "", F.expr("substring(grp, 2)")).alias(source_col),
        F.col("node").alias("leaf"), F.concat("path", "over").alias("path"),
        F.col("top").alias("subroot"), "root", *carry)


def tamper_check(docs: DataFrame, tampered: Column, fields: tuple[str, ...] = FIELDS,
                 id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                 arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    `tampered` is a changed text, folded with the siblings of the manifest; where it is the
    text, the leaf itself is folded.
    """
    changed = leaf([tampered if f == text_col else F.col(f) for f in fields])
    name = "changed_leaf"
    own = manifest(docs, fields, id_col, source_col, {name: changed}, arity, height)
    folded = own.select(
        id_col, "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"),
        fold(F.col("path"), F.col(name)).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))

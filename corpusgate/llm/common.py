"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from corpusgate.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: White space that separates words: space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
BATCH = 1 << 10   # rows of an Arrow batch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH rows.

    A batch of texts is held by the JVM, outside its heap, and by the Python worker, as Arrow
    and as Python objects, for every core; Spark's 10,000 rows of texts are several hundred MB.
    """
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting))
    if not 0 < now <= BATCH:
        spark.conf.set(setting, BATCH)


def give_back() -> None:
    """Return memory that is free inside this process to the system.

    A Python worker serves one task after another, of any stage. What Arrow and the C library
    keep of a task's free memory would be held by an executor in all later stages.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def giving_back(run: Callable) -> Callable:
    """`run` over batches, for mapInArrow, with `give_back` when its task has ended."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]],
                schema: str, rows: int = 1 << 30) -> DataFrame:
    """Run Python over Arrow batches, cut at `rows` rows.

    `make()` is called once per task and gives a function from {column: list} to
    {column: list}. Batches are bounded in rows and bytes by Spark's Arrow settings, so a
    task never holds more than one batch of texts. Nulls arrive as None.
    """
    small_batches(df.sparkSession)
    kind = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)
    names = df.columns

    def run(batches):
        work = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(names)})
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(giving_back(run), kind)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that the frame does not use (Spark ignores case)."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def remainder(doc_id: str, mod: int):
    """crc32 of the id as text, modulo `mod`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod


def placed(rows: DataFrame, order: list[Column], by: list[str]) -> DataFrame:
    """`rows` with `place` (from 0, in `order`) and `total` within `by`, in bounded tasks.

    Rows are dealt by range, sorted and written with their row number, which holds the
    partition; the offsets have one row per partition and group, so a group of any size is
    numbered by as many tasks as it fills. Values of `by` are not null.
    """
    keys = [*[F.col(c) for c in by], *order]
    ranged = materialize(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(
        "_cg_row", F.monotonically_increasing_id()), "ranged")
    part = F.shiftright("_cg_row", 33).alias("_cg_part")
    sizes = ranged.groupBy(part, *by).agg(F.min("_cg_row").alias("_cg_first"),
                                          F.count(F.lit(1)).alias("_cg_n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_cg_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_cg_part", *by, F.sum("_cg_n").over(group).alias("total"),
                         (F.coalesce(F.sum("_cg_n").over(before), F.lit(0))
                          - F.col("_cg_first")).alias("_cg_shift"))
    return ranged.withColumn("_cg_part", part).join(sizes, ["_cg_part", *by]).withColumn(
        "place", F.col("_cg_row") + F.col("_cg_shift")).drop("_cg_row", "_cg_part", "_cg_shift")


def file_bytes(spark: SparkSession, path: str):
    """Broadcast of a vocabulary file, whose size is fixed by its publisher (about 1 MB)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def components(pairs: DataFrame) -> DataFrame:
    """(node, grp): connected components of edges (a, b), named by their smallest node.

    Every round takes the smallest label around each node, hooks the root of each label to
    the smallest label met by its members, and then takes the label of that label, so chains
    shrink by a constant factor a round, in whatever order they are stored. Labels are final
    once no label changes. Only that one bit reaches the driver.
    """
    edges = materialize(pairs.select("a", "b").unionByName(pairs.select(
        F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("grp"))
    labels = materialize(labels, "labels")
    while True:
        near = edges.join(labels.select(F.col("a").alias("b"), "grp"), "b").groupBy("a").agg(
            F.min("grp").alias("near"))
        lower = labels.join(near, "a").select("a", "grp", F.least("grp", "near").alias("low"))
        hooks = lower.groupBy(F.col("grp").alias("root")).agg(F.min("low").alias("hook"))
        hooked = lower.join(hooks, F.col("grp") == F.col("root")).select(
            "a", F.col("grp").alias("old"), F.least("low", "hook").alias("mid"))
        jump = hooks.select(F.col("root").alias("mid"), F.col("hook").alias("jump"))
        step = materialize(hooked.join(jump, "mid", "left").select(
            "a", "old", F.least("mid", F.coalesce("jump", "mid")).alias("grp")), "labels")
        labels = step.select("a", "grp")
        if step.where("grp <> old").isEmpty():
            return labels.withColumnRenamed("a", "node")

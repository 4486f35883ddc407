"""Ordering, ranking, sampling and new identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.functions import values as V
from corpusgate.functions.base import lookup_map
from corpusgate.functions.text import natural_key
from corpusgate.session import materialize


def numbered_by(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Global row number under any unique sort key.

    Rows are range-partitioned and checkpointed with their partition number, so the
    offsets, one per partition, and the rows always refer to the same split.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(n, *keys)
                         .withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before),
                                               F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*keys)
    return (ranged.withColumn("_rank", F.row_number().over(inside)).join(offsets, "_part")
            .withColumn(name, F.col("_offset") + F.col("_rank"))
            .drop("_part", "_rank", "_offset"))


def assign_ids(new: DataFrame, existing: DataFrame, now_ms: int, order: str = "op_seq",
               ties: tuple[str, ...] = ("part",), key: str = "nid") -> DataFrame:
    """New ids from max(existing) + 1, never below `now_ms`, dense in op order."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("m")).scalar()
    base = F.greatest(top + 1, F.lit(now_ms)).cast("bigint")
    ranked = numbered_by(new.drop(key), [order, *ties], "_place")
    return ranked.withColumn(key, (base + F.col("_place") - 1).cast("bigint")).drop("_place")


def ledger_order(entries: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = entries.orderBy(F.desc("n_flags"), "nid")
    return ordered.limit(limit) if limit else ordered


def ledger_places(entries: DataFrame, name: str) -> DataFrame:
    """Every entry with its place in ledger order, without one global sort."""
    ranked = entries.withColumn("_order", -F.col("n_flags").cast("bigint"))
    return numbered_by(ranked, ["_order", "nid"], name).drop("_order")


def latest_report(reports: DataFrame) -> DataFrame:
    """(module, report): the newest report of each module, by file name."""
    return reports.groupBy("module").agg(F.max("report").alias("report"))


def last_runs(log: DataFrame, n: int = 8) -> DataFrame:
    return log.orderBy(F.desc("run")).limit(n)


def capped_groups(rows: DataFrame, section: str, order: list, n: int = 12) -> DataFrame:
    """First n rows per section, each with the number of rows left out.

    Section sizes come from a combinable count; ranking keeps only n rows per task.
    """
    sizes = rows.groupBy(section).agg(F.count(F.lit(1)).alias("_size"))
    rank = Window.partitionBy(section).orderBy(*order)
    return (rows.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= n)
            .join(sizes, section)
            .withColumn("more", F.greatest(F.col("_size") - n, F.lit(0))).drop("_size"))


def review_sample(notes: DataFrame, n: int = 12) -> DataFrame:
    """Repeatable sample, by digest of the number of notes and the note."""
    total = notes.agg(F.count(F.lit(1)).alias("n")).scalar()
    seeded = F.md5(F.concat_ws(":", total.cast("string"), F.col("nid").cast("string")))
    return (notes.withColumn("_h", seeded).orderBy("_h", "nid")
            .limit(n).drop("_h"))


def status_rank(status="status"):
    table = lookup_map((s, i) for i, s in enumerate(V.STATUS_ORDER))
    return F.coalesce(table[F.col(status)], F.lit(9))


def status_order(modules: DataFrame) -> DataFrame:
    return modules.orderBy(status_rank(), F.lower("name"))


def page_order(pages: DataFrame, path: str = "path") -> DataFrame:
    """Natural order of page names, whatever order they arrived in."""
    return pages.orderBy(natural_key(path), path)


def page_places(pages: DataFrame, name: str, path: str = "path") -> DataFrame:
    """Natural order of page names as a number, without one global sort."""
    keyed = pages.withColumn("_key", natural_key(path))
    return numbered_by(keyed, ["_key", path], name).drop("_key")


def deepest_deck(decks: DataFrame, by: list[str] | None = None,
                 default: str = "Default") -> DataFrame:
    """The non-default deck with the longest path, smallest id on ties."""
    from corpusgate.functions.text import path_depth, path_leaf

    named = decks.where(F.col("name") != default).select(
        *(by or []), "did", path_depth("name").alias("depth"), path_leaf("name").alias("leaf"))
    best = F.min_by(F.struct("did", "leaf", "depth"), F.struct(-F.col("depth"), F.col("did")))
    return named.groupBy(*(by or [])).agg(best.alias("_b")).select(*(by or []), "_b.*")


BLOCK = 1 << 12


def band_islands(rows: DataFrame, by: list[str], lo: str, hi: str, gap: int = V.BAND_GAP,
                 pad: int = V.BAND_PAD, limit: str | None = None,
                 block: int | None = BLOCK) -> DataFrame:
    """(by..., y0, y1): runs of marked positions, joined over small gaps, padded, merged.

    A row marks the whole positions lo..hi inclusive. A new run starts when the next
    position lies more than `gap` beyond everything before it. Padded runs are clamped to
    0..limit and runs that then touch are merged.
    """
    cap = F.col(limit).cast("bigint") if limit else F.lit(None).cast("bigint")
    marked = rows.select(*by, F.col(lo).cast("bigint").alias("_lo"),
                         F.col(hi).cast("bigint").alias("_hi"), cap.alias("_limit"))
    distinct = marked.groupBy(*by, "_lo").agg(F.max("_hi").alias("_hi"),
                                              F.max("_limit").alias("_limit"))
    runs = merge_intervals(distinct, by, "_lo", "_hi", gap, {"_limit": F.max}, block)
    top = F.col("_hi") + pad + 1
    padded = runs.select(*by, F.greatest(F.col("_lo") - pad, F.lit(0)).alias("_lo"),
                         F.when(F.col("_limit").isNotNull(), F.least(top, F.col("_limit")))
                         .otherwise(top).alias("_hi"))
    merged = _join_runs(padded, by, "_lo", "_hi", 0, {})
    return merged.select(*by, F.col("_lo").alias("y0"), F.col("_hi").alias("y1"))


def merge_intervals(rows: DataFrame, by: list[str], lo: str, hi: str, gap: int,
                    extra: dict | None = None, block: int | None = BLOCK) -> DataFrame:
    """(by..., lo, hi, extra...): intervals of a group joined when `gap` or less apart.

    Intervals are first joined inside blocks of `block` positions, spreading a group that
    holds a large share of the rows over many tasks. What is left of a group lies more
    than `gap` apart inside each block, so the second step sees at most range / gap
    intervals per group, however many rows there were. `block=None` skips the first step
    where groups are small by nature. `extra` maps columns to a combinable aggregate.
    """
    extra = extra or {}
    if block is not None:
        cut = rows.withColumn("_blk", F.floor(F.col(lo) / F.lit(block)).cast("bigint"))
        rows = _join_runs(cut, [*by, "_blk"], lo, hi, gap, extra).drop("_blk")
    return _join_runs(rows, by, lo, hi, gap, extra)


def _join_runs(rows: DataFrame, by: list[str], lo: str, hi: str, gap: int,
               extra: dict) -> DataFrame:
    """One window and one aggregation on the same partitioning."""
    order = Window.partitionBy(*by).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col(lo) - reach > gap), 1).otherwise(0)
    numbered = rows.withColumn("_new", starts).withColumn("_run", F.sum("_new").over(order))
    return numbered.groupBy(*by, "_run").agg(
        F.min(lo).alias(lo), F.max(hi).alias(hi),
        *[f(c).alias(c) for c, f in extra.items()]).drop("_run")


def sessions(events: DataFrame, by: list[str], ts: str, gap_minutes: int = 180) -> DataFrame:
    """(by..., start, end, n): activity sessions, closed after `gap_minutes` of silence.

    The end is the last event plus the gap, as `session_window` reports it.
    """
    gap = gap_minutes * 60 * 1_000_000
    rows = events.select(*by, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"))
    counted = rows.groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("n"))
    merged = merge_intervals(counted.withColumn("_end", F.col("_t")), by, "_t", "_end", gap,
                             {"n": F.sum}, block=24 * 3600 * 1_000_000)
    return merged.select(*by, F.timestamp_micros("_t").alias("start"),
                         F.timestamp_micros(F.col("_end") + gap).alias("end"), "n")

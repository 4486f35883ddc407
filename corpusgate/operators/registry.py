"""Work-item tables: queue, next phase, review rows, totals, preserved history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.functions import values as V
from corpusgate.operators.order import status_order
from corpusgate.operators.relate import (exclude_tracked, pair_by_key, report_lookup,
                                         untracked_outputs)


def work_queue(sources: DataFrame, decks: DataFrame, registry: DataFrame) -> DataFrame:
    """Pending work items: decks with or without a source, minus everything tracked.

    sources (key, pdf); decks (key, apkg, deck_id, name, deck_path, cards_before).
    """
    paired = pair_by_key(sources, decks).where("mode <> 'source-only'")
    fresh = exclude_tracked(paired, registry, "name", "name")
    return fresh.select(
        "name", "deck_id", F.replace(F.col("deck_path"), F.lit(V.FIELD_SEP), F.lit("::"))
        .alias("deck_path"), "apkg", "pdf", "mode", "cards_before",
        F.lit("pending").alias("status"))


def unfinished_items(progress: DataFrame) -> DataFrame:
    """Progress rows not marked complete; unreadable ones count as unfinished."""
    return progress.where(~F.coalesce("complete", F.lit(False)))


def next_phase(modules: DataFrame, queue: DataFrame, reports: DataFrame, progress: DataFrame,
               files: DataFrame) -> DataFrame:
    """(name, action, priority): the phase each module is in, most urgent first.

    `files` (path) lists the deck files that exist. A module that is both built and queued
    gets the more urgent of its two phases.
    """
    seen = report_lookup(modules, reports)
    built = F.col("status") == "built-unverified"
    from_registry = seen.select("name", (
        F.when(built & ~F.col("has_report"), F.lit(2))
        .when(F.col("status") == "in-progress", F.lit(3))
        .when(built, F.lit(5))).alias("priority"))
    open_work = unfinished_items(progress).select(F.col("module").alias("_m")).distinct()
    there = files.select(F.col("path").alias("_p")).distinct()
    queued = (queue.join(open_work, queue["name"] == F.col("_m"), "left")
              .join(there, queue["apkg"] == F.col("_p"), "left"))
    pending = F.col("status") == "pending"
    missing = F.col("apkg").isNotNull() & F.col("_p").isNull()
    from_queue = queued.select("name", (
        F.when(F.col("_m").isNotNull(), F.lit(1))
        .when(pending & missing, F.lit(-4)).when(pending, F.lit(4))).alias("priority"))
    all_rows = from_registry.unionByName(from_queue).where(F.col("priority").isNotNull())
    best = all_rows.groupBy("name").agg(
        F.min_by("priority", F.abs("priority")).alias("code"))
    names = {1: "RESUME", 2: "VERIFY", 3: "PATCH", 4: "BUILD", -4: "BLOCKED", 5: "AWAIT"}
    action = F.lit(None).cast("string")
    for code, name in names.items():
        action = F.when(F.col("code") == code, name).otherwise(action)
    return best.select("name", action.alias("action"), F.abs("code").alias("priority"))


def next_action(phases: DataFrame) -> DataFrame:
    """One row (action, name): what to do next, IDLE when there is nothing."""
    first = phases.agg(F.min(F.struct("priority", "name", "action")).alias("b"))
    return first.select(F.coalesce("b.action", F.lit("IDLE")).alias("action"),
                        F.col("b.name").alias("name"))


def decide(modules: DataFrame, queue: DataFrame, reports: DataFrame | None,
           progress: DataFrame, files: DataFrame, place: str = "place") -> DataFrame:
    """One row (action, name): what to do next, in the order of the lists.

    `modules` and `queue` have their order in `place`. Builds are resumed and begun in the
    order of the queue, modules verified and patched in the order of the registry; AWAIT and
    IDLE name no module. `reports` is None when the reports cannot be read: while any module
    is built and not verified, what to do then depends on them, so the answer is BLOCKED.
    """
    built = modules.agg(F.count_if(F.col("status") == "built-unverified").alias("n")).scalar()
    known = reports if reports is not None else modules.select(
        F.col("name").alias("module"), F.lit(None).cast("string").alias("report")).where("false")
    phases = next_phase(modules.drop(place), queue.drop(place), known, progress, files)
    orders = modules.select(F.col("name").alias("_n"), F.lit(False).alias("_q"), place).unionByName(
        queue.select(F.col("name").alias("_n"), F.lit(True).alias("_q"), place))
    of_queue = F.col("action").isin("RESUME", "BUILD", "BLOCKED")
    placed = phases.join(orders, (F.col("name") == F.col("_n")) & (of_queue == F.col("_q")))
    first = placed.agg(F.min(F.struct("priority", place, "name", "action")).alias("b"))
    action = F.coalesce("b.action", F.lit("IDLE"))
    if reports is None:
        action = F.when(built > 0, F.lit("BLOCKED")).otherwise(action)
    name = F.when(~action.isin("AWAIT", "IDLE"), F.col("b.name"))
    if reports is None:
        name = F.when(built > 0, F.lit(None)).otherwise(name)
    return first.select(action.alias("action"), name.alias("name"))


def deck_review(modules: DataFrame, reports: DataFrame, calls: DataFrame,
                outputs: DataFrame) -> DataFrame:
    """Registry rows with their newest report and open judgements, then untracked outputs."""
    counts = calls.groupBy(F.col("module").alias("_m")).agg(
        F.count(F.lit(1)).alias("judgements"))
    loose = untracked_outputs(outputs, modules).select(
        F.col("folder").alias("name"), F.lit("untracked").alias("status"),
        F.lit(None).cast("bigint").alias("cards_before"),
        F.lit(None).cast("bigint").alias("cards_after"))
    rows = modules.select("name", F.coalesce("status", F.lit("unknown")).alias("status"),
                          "cards_before", "cards_after").unionByName(loose)
    seen = report_lookup(rows, reports).withColumn(
        "has_report", F.col("has_report") & (F.col("status") != "untracked"))
    joined = seen.join(counts, seen["name"] == F.col("_m"), "left")
    return status_order(joined.select(
        "name", "status", (F.col("status") == "verified").alias("verified"), "cards_before",
        "cards_after", F.coalesce("judgements", F.lit(0)).alias("judgements"), "has_report",
        "latest_report"))


def registry_totals(modules: DataFrame) -> DataFrame:
    """One row: modules complete and verified, cards before and after."""
    status = F.coalesce("status", F.lit("unknown"))
    return modules.agg(
        F.count_if(status != "pending").alias("modules_complete"),
        F.count_if(status == "verified").alias("modules_verified"),
        F.coalesce(F.sum("cards_before"), F.lit(0)).alias("cards_before"),
        F.coalesce(F.sum("cards_after"), F.lit(0)).alias("cards_after"))


def status_summary(modules: DataFrame) -> DataFrame:
    return modules.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(
        F.count(F.lit(1)).alias("n"))


def history_preserved(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """One row (changed, pass): records that a migration lost, altered or added.

    Records are counted on both sides; equal counts everywhere mean equal histories.
    """
    key = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    sides = before.select(key.alias("k"), F.lit(1).alias("s")).unionByName(
        after.select(key.alias("k"), F.lit(-1).alias("s")))
    odd = sides.groupBy("k").agg(F.sum("s").alias("s")).where("s <> 0")
    return odd.agg(F.coalesce(F.sum(F.abs("s")), F.lit(0)).alias("changed")).withColumn(
        "pass", F.col("changed") == 0)


def add_defaults(state: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Fill missing keys only, and list which ones were added."""
    added = F.array_compact(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in defaults]))
    return state.withColumn("added", added).withColumns(
        {k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})

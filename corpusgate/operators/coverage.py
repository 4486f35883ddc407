"""Page and word-box coverage: what must be read by eye and what is already accounted for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.functions import values as V
from corpusgate.functions.text import numericish, page_footers, visual_tokens
from corpusgate.operators.order import band_islands
from corpusgate.session import materialize

EDGE = 2
TASK_ROWS = 1 << 19   # line extents whose pages share a task


def box_buckets(boxes: DataFrame, conf_ok: float = V.CONFIDENCE_OK) -> DataFrame:
    """Adds bucket: needs-eyes below the confidence, else numeric or accounted."""
    bucket = (F.when(F.col("conf") < conf_ok, "needs-eyes")
              .when(numericish("text"), "numeric").otherwise("accounted"))
    return boxes.withColumn("bucket", bucket)


def _extents(boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, bucket, lo, hi, page_h): rows of the page a box covers, edges included.

    Boxes of one line share their extent, so the distinct extents, far fewer than the
    boxes, are what is joined with the pages.
    """
    lines = boxes.where("bucket <> 'accounted'").select("page_id", "bucket", "t", "h").distinct()
    return (lines.join(pages.select("page_id", "page_h"), "page_id")
            .select("page_id", "bucket", F.greatest(F.col("t") - EDGE, F.lit(0)).alias("lo"),
                    (F.least(F.col("t") + F.col("h") + EDGE, F.col("page_h")) - 1).alias("hi"),
                    "page_h"))


def outside_bands(extents: DataFrame, bands: DataFrame, tasks: int | None = None) -> DataFrame:
    """(page_id, lo, hi, page_h): the parts of extents that no band covers.

    A sweep over start and end positions: a stretch counts where some extent and no band
    is open. Extents and bands are never paired. With `tasks`, pages are dealt over so many.
    """
    def edge(at: Column, n: int, b: int) -> Column:
        return F.struct(at.cast("bigint").alias("y"), F.lit(n).alias("n"), F.lit(b).alias("b"))

    heights = extents.select("page_id", F.col("page_h").cast("bigint").alias("page_h"),
                             F.explode(F.array(edge(F.col("lo"), 1, 0),
                                               edge(F.col("hi") + 1, -1, 0))).alias("e"))
    stops = bands.select("page_id", F.lit(None).cast("bigint").alias("page_h"),
                         F.explode(F.array(edge(F.col("y0"), 0, 1),
                                           edge(F.col("y1"), 0, -1))).alias("e"))
    edges = heights.unionByName(stops)
    steps = (edges.repartition(tasks, "page_id") if tasks else edges).groupBy("page_id", "e.y").agg(
        F.sum("e.n").alias("n"), F.sum("e.b").alias("b"), F.max("page_h").alias("page_h"))
    sweep = Window.partitionBy("page_id").orderBy("y")
    whole = Window.partitionBy("page_id")
    open_ = steps.select("page_id", "y", F.lead("y").over(sweep).alias("next"),
                         F.sum("n").over(sweep).alias("n"), F.sum("b").over(sweep).alias("b"),
                         F.max("page_h").over(whole).alias("page_h"))
    return open_.where((F.col("n") > 0) & (F.col("b") == 0)).select(
        "page_id", F.col("y").alias("lo"), (F.col("next") - 1).alias("hi"), "page_h")


def page_bands(boxes: DataFrame, pages: DataFrame, gap: int = V.BAND_GAP,
               pad: int = V.BAND_PAD) -> DataFrame:
    """(page_id, kind, y0, y1): bands to read by eye, and numeric bands outside of them."""
    marked = box_buckets(boxes) if "bucket" not in boxes.columns else boxes
    extents = materialize(_extents(marked, pages), "extents")
    # A page has no more distinct positions than pixel rows, so it fits one task. Extents are so
    # narrow that a shuffle partition of the usual bytes sorts to some forty times of them, several
    # times at once: the number of tasks follows the rows, and all steps of a page share its task.
    tasks = extents.count() // TASK_ROWS + 1
    marks = extents.where("bucket = 'needs-eyes'").repartition(tasks, "page_id")
    # The mandatory bands are read twice below and are far fewer than the boxes.
    eyes = materialize(band_islands(marks, ["page_id"], "lo", "hi", gap, pad, "page_h",
                                    block=None), "bands")
    loose = outside_bands(extents.where("bucket = 'numeric'"), eyes, tasks)
    numeric = band_islands(loose, ["page_id"], "lo", "hi", gap, pad, "page_h", block=None)
    return (eyes.withColumn("kind", F.lit("eyes"))
            .unionByName(numeric.withColumn("kind", F.lit("numeric")))
            .select("page_id", "kind", "y0", "y1"))


def uncovered(items: DataFrame, bands: DataFrame, position: str = "y") -> DataFrame:
    """Items inside no band of their page; the gate wants none."""
    b = bands.select(F.col("page_id").alias("_p"), F.col("y0").alias("_a"), F.col("y1").alias("_b"))
    inside = ((F.col("page_id") == F.col("_p")) & (F.col(position) >= F.col("_a"))
              & (F.col(position) < F.col("_b")))
    return items.join(b, inside, "left_anti")


def page_cost(pages: DataFrame, bands: DataFrame, separator: int = V.SEPARATOR_PX) -> DataFrame:
    """(page_id, page_tokens, sheet_tokens, numbers_tokens, bands, num_bands, band_px)."""
    def total(kind: str) -> tuple[Column, Column]:
        mine = F.col("kind") == kind
        return (F.coalesce(F.sum(F.when(mine, F.col("y1") - F.col("y0"))), F.lit(0)),
                F.count_if(mine))

    px, n = total("eyes")
    num_px, num_n = total("numeric")
    sums = bands.groupBy("page_id").agg(
        px.alias("band_px"), n.alias("bands"), num_px.alias("_num_px"), num_n.alias("num_bands"))
    joined = pages.join(sums, "page_id", "left").fillna(
        0, ["band_px", "bands", "_num_px", "num_bands"])

    def sheet(height: str, count: str) -> Column:
        tall = F.col(height) + F.greatest(F.col(count) - 1, F.lit(0)) * separator
        return F.when(F.col(count) > 0, visual_tokens("page_w", tall)).otherwise(F.lit(0))

    return joined.select(
        "page_id", visual_tokens("page_w", "page_h").alias("page_tokens"),
        sheet("band_px", "bands").cast("bigint").alias("sheet_tokens"),
        sheet("_num_px", "num_bands").cast("bigint").alias("numbers_tokens"),
        F.col("bands").cast("bigint").alias("bands"),
        F.col("num_bands").cast("bigint").alias("num_bands"), "band_px")


def read_plan(stats: DataFrame, enabled: bool = True) -> DataFrame:
    """Adds mode and reason: every doubt promotes the page to a whole-page read."""
    total_bands = F.col("bands") + F.col("num_bands")
    percent = F.format_string("%.1f", 100 * F.col("furniture_frac"))
    dense = F.col("sheet_tokens") >= F.col("page_tokens") * V.SHEET_LIMIT
    rules = [
        (F.lit(not enabled), "page", F.lit("banding disabled")),
        ((F.col("words_total") == 0) & (F.col("informative_ink_px") == 0), "none",
         F.lit("blank page - no informative ink")),
        (F.col("words_total") == 0, "page", F.lit("no word boxes - coverage unprovable")),
        (F.col("unaccounted_ink_px") > 0, "page", F.concat(
            F.col("unaccounted_ink_px").cast("string"),
            F.lit(" px of informative ink outside every band"))),
        (F.col("furniture_frac") > V.FURNITURE_LIMIT, "page", F.concat(
            F.lit("furniture is "), percent, F.lit("% of informative ink - not trusted"))),
        (total_bands > V.MAX_BANDS, "page", F.concat(
            total_bands.cast("string"), F.lit(" bands - too fragmented to compose"))),
        (dense, "page", F.lit("figure dense - the sheet costs as much as the page")),
        (F.col("bands") > 0, "sheet", F.lit("")),
        (F.col("num_bands") > 0, "numbers-only", F.lit("")),
    ]
    mode, reason = F.lit("none"), F.lit("")
    for cond, name, why in reversed(rules):
        mode = F.when(cond, name).otherwise(mode)
        reason = F.when(cond, why).otherwise(reason)
    return stats.withColumn("mode", mode).withColumn("reason", reason)


def coverage_summary(plans: DataFrame) -> DataFrame:
    """One row: pages per mode, tokens whole, planned and for numbers, saving, unaccounted."""
    whole = F.col("mode") == "page"

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0))

    sums = plans.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(whole).alias("whole_pages"),
        F.count_if(F.col("mode") == "sheet").alias("sheets"),
        F.count_if(F.col("mode") == "none").alias("nothing"),
        total(F.col("page_tokens")).alias("tokens_baseline"),
        total(F.when(whole, F.col("page_tokens")).otherwise(F.col("sheet_tokens")))
        .alias("tokens_plan"),
        total(F.when(~whole, F.col("numbers_tokens")).otherwise(0)).alias("tokens_numbers"),
        total(F.when(~whole, F.col("unaccounted_ink_px")).otherwise(0)).alias("unaccounted"))
    saved = 100 * (1 - F.col("tokens_plan") / F.greatest(F.col("tokens_baseline"), F.lit(1)))
    return sums.withColumn("percent_saved", F.round(saved, 4)).withColumn(
        "pass", F.col("unaccounted") == 0)


def page_completeness(texts: DataFrame, by: str = "doc", column: str = "text") -> DataFrame:
    """(doc, found, total, missing): pages named by footers against the highest total.

    Page numbers have at most three digits, so the arrays stay below a thousand entries.
    Documents without any footer get nulls.
    """
    hits = texts.select(by, F.explode_outer(page_footers(column)).alias("f"))
    grouped = hits.groupBy(by).agg(F.sort_array(F.collect_set("f.page")).alias("_found"),
                                   F.max("f.total").alias("total"))
    known = F.col("total").isNotNull()
    every = F.when(F.col("total") >= 1, F.sequence(F.lit(1), "total")).otherwise(
        F.array().cast("array<int>"))
    return grouped.select(by, F.when(known, F.col("_found")).alias("found"), "total",
                          F.when(known, F.array_except(every, "_found")).alias("missing"))


def text_union(pages: DataFrame, direct: DataFrame) -> DataFrame:
    """(doc, page, text) of recognised pages and of text read directly."""
    return pages.select("doc", "page", "text").unionByName(direct.select("doc", "page", "text"))

"""Removal of lines that spread over many sites.

The sites of every line are counted with HyperLogLog sketches, one per line hash, which
merge in a combinable aggregate. Estimates clearly above the limit decide alone; lines within
BAND of it get an exact distinct count. Lines that reach the limit are cross-site
boilerplate and leave every document.

Defined results: lines are compared as they are, between line feeds; lines of white space
only are never counted or removed; a null text is an empty text of one blank line; a null
site is a site of its own; rows that repeat an id with the same text share one result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import fresh
from corpusgate.session import materialize

MIN_SITES = 6
BAND = 0.1       # six standard errors of a sketch of 2^12 cells
LG_CELLS = 12


def _line_key(line: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def lines_of(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, row, site, place, h1, h2) of every line that is not blank."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    site = F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"),
                       site.alias("site"), F.posexplode(F.split(text, "\n")).alias("place", "line"))
    return rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select(
        "id", "row", "site", "place", *_line_key(F.col("line")))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(h1, h2): lines found on at least `min_sites` sites."""
    spread = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(LG_CELLS)).alias("sketch"))
    spread = spread.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("about"))
    wide = materialize(spread.where(F.col("about") >= min_sites * (1 - band)), "spread")
    near = wide.where(F.col("about") < min_sites * (1 + band)).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(
        F.countDistinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    sure = wide.where(F.col("about") >= min_sites * (1 + band)).select("h1", "h2")
    return sure.unionByName(exact.select("h1", "h2"))


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """`docs` with boilerplate lines gone from the text, and n_lines and n_removed.

    The two columns get an underscore in front while the frame has such names.
    """
    lines = lines_of(docs, id_col, text_col, site_col)
    common = materialize(boilerplate(lines, min_sites), "boilerplate")
    # At most one place per line of a document.
    gone = lines.join(common, ["h1", "h2"], "left_semi").groupBy("id", "row").agg(
        F.collect_set("place").alias("_cg_gone")).select(
        F.col("id").alias("_cg_id"), F.col("row").alias("_cg_row"), "_cg_gone")
    text = F.coalesce(F.col(text_col), F.lit(""))
    n_lines, n_removed = fresh(docs, "n_lines", "n_removed")
    rows = docs.join(gone, docs[id_col].eqNullSafe(F.col("_cg_id"))
                     & (F.xxhash64(text) == F.col("_cg_row")), "left")
    parts = F.split(text, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_cg_gone"))
    kept = F.transform(places, lambda i: F.get(parts, i))
    cleaned = F.when(F.col("_cg_gone").isNull(), text).otherwise(F.array_join(kept, "\n"))
    return rows.select(
        *[cleaned.alias(c) if c == text_col else docs[c] for c in docs.columns],
        F.size(parts).cast("bigint").alias(n_lines),
        F.coalesce(F.size("_cg_gone"), F.lit(0)).cast("bigint").alias(n_removed))

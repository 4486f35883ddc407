"""Queries over file sources: the driver tables written out as files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgate.operators.report import digest_lines
from corpusgate.plans.base import MARKED, NOTES, doc_notes, marked_notes, query, sub, table
from corpusgate.plans.texts import _compact_sql
from corpusgate.session import scratch_path
from corpusgate.sources import decks as K
from corpusgate.sources import sinks
from corpusgate.sources import texts as X


def _lines(expr: str) -> str:
    return sub(expr, r"[\r\n]+", " ")


_EXPORT = f"""{NOTES}, lines AS (SELECT nid, {_lines("text || ' | ' || extra")} AS line FROM notes),
  n AS (SELECT line, row_number() OVER (ORDER BY nid) AS place FROM lines)"""


@query("write_text_export", f"WITH {_EXPORT} SELECT count(*)::BIGINT AS lines, sum(length(line))::BIGINT "
       "AS chars FROM n")
def write_text_export(spark, d):
    path = scratch_path(spark, "export")
    sinks.write_text_export(doc_notes(spark, d), path, " | ")
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"),
                                     F.sum(F.length("value")).alias("chars"))


@query("read_text_export", f"""WITH {NOTES}
SELECT nid, split_part({_lines("'n' || nid || ' | ' || extra")}, ' | ', 2) AS extra, 0::BIGINT AS off FROM notes""")
def read_text_export(spark, d):
    """Exports hold notes in note order, so a line's number is the note's rank in its file."""
    from pyspark.sql import Window

    path = scratch_path(spark, "export")
    named = doc_notes(spark, d).select("nid", F.concat(F.lit("n"), "nid").alias("text"), "extra")
    sinks.write_text_export(named, path, " | ")
    back = X.read_text_export(spark, path)
    number = F.substring_index("text", "n", -1).cast("bigint")
    rank = F.row_number().over(Window.partitionBy("path").orderBy(number))
    return back.select(number.alias("nid"), "extra", (F.col("nid") - rank).cast("bigint").alias("off"))


@query("write_digest", f"""WITH {MARKED} SELECT count(*)::BIGINT AS lines, sum(length(
  {_lines(f"nid || chr(9) || {_compact_sql('text')} || CASE WHEN {_compact_sql('extra')} = '' THEN '' "
          f"ELSE chr(9) || {_compact_sql('extra')} END")}))::BIGINT AS chars FROM marked""")
def write_digest(spark, d):
    path = scratch_path(spark, "digest")
    sinks.write_digest(digest_lines(marked_notes(spark, d)), path)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"),
                                     F.sum(F.length("value")).alias("chars"))


@query("read_word_boxes", f"""
SELECT text, count(*)::BIGINT AS n, sum(c)::BIGINT AS conf FROM (SELECT
  event_type AS text, event_id % 90 AS c FROM events WHERE event_id % 11 <> 4 AND event_id % 13 <> 5)
GROUP BY text""")
def read_word_boxes(spark, d):
    path = scratch_path(spark, "boxes")
    n = F.col("event_id")
    rows = table(spark, d, "events").select(
        F.pmod(n, F.lit(700)).cast("string").alias("left"), F.lit("10").alias("top"),
        F.when(F.pmod(n, F.lit(13)) == 5, "wide").otherwise("80").alias("width"), F.lit("12").alias("height"),
        F.pmod(n, F.lit(90)).cast("string").alias("conf"),
        F.when(F.pmod(n, F.lit(11)) == 4, " ").otherwise(F.col("event_type")).alias("text"))
    rows.write.option("sep", "\t").option("header", "true").option("quote", "").option(
        "emptyValue", "").csv(path)
    boxes = X.read_word_boxes(spark, path)
    return boxes.groupBy("text").agg(F.count(F.lit(1)).alias("n"),
                                     F.sum("conf").cast("bigint").alias("conf"))


SOURCE_DOCS = 500     # documents of one source file


@query("read_sources", """
SELECT 'm' || (doc_id % 8) AS module, count(*)::BIGINT AS parts, sum(length(text))::BIGINT AS chars
FROM documents GROUP BY 1""")
def read_sources(spark, d):
    """Documents written as files of at most SOURCE_DOCS per module, then read as sources.

    Every task writes what it has read, so tasks and files grow with the table.
    """
    path = scratch_path(spark, "sources")
    n = F.col("doc_id")
    docs = table(spark, d, "documents")
    # Text files per module hold its documents; their number is kept by a marker character.
    (docs.select(F.concat(F.lit("m"), F.pmod(n, F.lit(8))).alias("module"),
                 F.concat(F.lit("\x01"), "text").alias("value"))
     .write.option("maxRecordsPerFile", SOURCE_DOCS).partitionBy("module").text(path))
    parts = X.read_sources(spark, path)
    body = F.regexp_replace("part", r"^\n--- [^\n]* ---\n", "")
    marks = F.regexp_count(body, F.lit("\x01"))
    # Each row is written with a line end of its own and carries one marker character.
    return parts.groupBy(F.regexp_replace("module", "^module=", "").alias("module")).agg(
        F.sum(marks).cast("bigint").alias("parts"),
        F.sum(F.length(body) - 2 * marks).cast("bigint").alias("chars"))


@query("module_documents", """
SELECT 'm' || (doc_id % 8) AS module, count(*)::BIGINT AS parts,
  sum(length(text) + length(doc_id::VARCHAR) + 15)::BIGINT AS chars,
  sum(octet_length(encode(text)) + length(doc_id::VARCHAR) + 15)::BIGINT AS bytes,
  sum(ceil((length(text) + length(doc_id::VARCHAR) + 15) / 1000))::BIGINT AS pieces
FROM documents GROUP BY 1""")
def module_documents(spark, d):
    """Documents as parts of eight modules, written in pieces of 1,000 characters and read back."""
    path = scratch_path(spark, "modules")
    n = F.col("doc_id")
    name = F.concat(F.lit("d"), n.cast("string"), F.lit(".txt"))
    parts = table(spark, d, "documents").select(
        F.concat(F.lit("m"), F.pmod(n, F.lit(8))).alias("module"), n.cast("int").alias("ord"),
        F.concat(F.lit("\n--- "), name, F.lit(" ---\n"), "text").alias("part"))
    X.write_documents(X.content_pieces(parts, 1000), path)
    pieces = X.read_documents(spark, path)
    counts = pieces.groupBy("module").agg(F.count(F.lit(1)).alias("pieces"))
    return X.document_sizes(pieces).join(counts, "module")


@query("read_changeset", """
SELECT op, count(*)::BIGINT AS n FROM (SELECT 'rewrite' AS op FROM labels WHERE quality = 1
  UNION ALL SELECT 'edit' FROM labels WHERE quality = 0) GROUP BY op""")
def read_changeset(spark, d):
    path = scratch_path(spark, "changeset")
    labels = table(spark, d, "labels")
    labels.where("quality = 1").select(
        F.col("doc_id").alias("op_seq"), F.col("doc_id").alias("nid"), F.lit("rewrite").alias("op"),
        F.lit("t").alias("text"), F.lit("e").alias("extra")).write.json(path + "/ops")
    labels.where("quality = 0").select(
        F.col("doc_id").alias("op_seq"), F.col("doc_id").alias("nid"), F.lit("a").alias("find"),
        F.lit("b").alias("replace")).write.json(path + "/fixes")
    # Spark's own files hold one object per line.
    ops, _new = X.read_changeset(spark, path + "/ops", path + "/fixes", multi_line=False)
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("read_meta", """
WITH m AS (SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL)
SELECT doc_id, kind, place, point FROM (
  SELECT doc_id, 'outstanding' AS kind, unnest([1, 2])::BIGINT AS place,
    unnest(['check ' || lang, 'ask ' || doc_id]) AS point FROM m WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'gaps_filled', 1, 'gap ' || doc_id FROM m WHERE doc_id % 3 = 1)""")
def read_meta(spark, d):
    """One meta object per document, some without one key or the other."""
    path = scratch_path(spark, "meta")
    n, third = F.col("doc_id"), F.pmod(F.col("doc_id"), F.lit(3))
    table(spark, d, "documents").where("lang IS NOT NULL").select(
        n.cast("string").alias("summary"),
        F.when(third == 0, F.array(F.concat(F.lit("check "), "lang"), F.concat(F.lit("ask "), n)))
        .alias("outstanding"),
        F.when(third == 1, F.array(F.concat(F.lit("gap "), n))).alias("gaps_filled")).write.json(path)
    meta = X.read_meta(spark, path, multi_line=False).withColumn("path", F.col("summary"))
    return X.open_points(meta).select(F.col("path").cast("bigint").alias("doc_id"), "kind",
                                      F.col("place").cast("bigint").alias("place"), "point")


@query("file_inventory", """
SELECT sha256(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS sha256, count(*)::BIGINT AS lines
FROM customer GROUP BY c_nationkey""")
def file_inventory(spark, d):
    """One file of names per nation; its digest is that of the lines it holds."""
    path = scratch_path(spark, "inventory")
    (table(spark, d, "customer").select("c_nationkey", "c_custkey", F.col("c_name").alias("value"))
     .repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").drop("c_custkey")
     .write.partitionBy("c_nationkey").text(path))
    lines = spark.read.text(path).groupBy(F.col("_metadata.file_name").alias("name"), "c_nationkey").agg(
        F.count(F.lit(1)).alias("lines"))
    found = K.file_inventory(spark, path).select("sha256", F.regexp_extract(
        "path", "c_nationkey=([0-9]+)/", 1).cast("int").alias("c_nationkey"))
    return found.join(lines, "c_nationkey").select("sha256", "lines")

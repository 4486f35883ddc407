"""Text sources: line exports, source folders, markdown, word-box files, change-sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate import schemas as D
from corpusgate.functions import values as V
from corpusgate.functions.base import is_blank, strip, text
from corpusgate.functions.text import natural_key

PIECE = 1 << 20     # characters of a piece of a module's document


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, value): lines with their 1-based number, without reading a file whole.

    Files are split between tasks as usual. Inside a split the reader keeps line order; the
    number of lines in the earlier splits of a file, one row per split, gives the offset.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"), "value")
    blocks = lines.groupBy("path", "_start").agg(F.count(F.lit(1)).alias("_n"),
                                                 F.min("_id").alias("_first"))
    before = (Window.partitionBy("path").orderBy("_start")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return (lines.join(offsets.drop("_n"), ["path", "_start"])
            .select("path", (F.col("_offset") + F.col("_id") - F.col("_first") + 1)
                    .alias("line_no"), "value"))


def read_text_export(spark: SparkSession, path: str, separator: str = " | ") -> DataFrame:
    """(path, nid, text, extra, fields): one note per line, numbered by line.

    Blank lines and lines starting with "#" hold no note but keep their number.
    """
    rows = read_numbered_lines(spark, path).where(
        ~is_blank("value") & ~F.col("value").startswith("#"))
    fields = F.split("value", "\\Q" + separator + "\\E")
    return rows.select("path", F.col("line_no").alias("nid"), fields.alias("fields")).select(
        "path", "nid", F.col("fields")[0].alias("text"),
        F.coalesce(F.get("fields", F.lit(1)), F.lit("")).alias("extra"), "fields")


def read_sources(spark: SparkSession, path: str, module_depth: int = 2) -> DataFrame:
    """(module, name, ord, part): text files of each module folder in natural name order.

    Each part starts with a header line naming its file. Other extensions are skipped.
    """
    files = (spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
             .select(F.col("_metadata.file_path").alias("file"), "value"))
    parts = F.split("file", "/")
    named = files.select(
        F.element_at(parts, -module_depth).alias("module"), F.element_at(parts, -1).alias("name"),
        "value").where(F.lower(F.substring_index("name", ".", -1)).isin(*V.TEXT_EXTENSIONS))
    order = Window.partitionBy("module").orderBy(natural_key("name"), "name")
    return named.select("module", "name", F.row_number().over(order).alias("ord"), F.concat(
        F.lit("\n--- "), "name", F.lit(" ---\n"), "value").alias("part"))


def content_pieces(parts: DataFrame, size: int = PIECE) -> DataFrame:
    """(module, ord, piece, text): the parts of a module in pieces of at most `size` characters.

    In the order of (ord, piece) the pieces of a module, put end to end, are its document. No
    row holds more than a piece, so a module may be larger than any value.
    """
    n = F.greatest(F.lit(1), F.ceil(F.length("part") / F.lit(size)).cast("int"))
    cut = parts.select("module", "ord", "part", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"))
    return cut.select("module", "ord", "piece", F.substring(
        "part", F.col("piece") * size + 1, F.lit(size)).alias("text"))


def write_documents(pieces: DataFrame, path: str) -> None:
    """Pieces in order below one folder per module; read them with `read_documents`.

    Rows are dealt by range of (module, ord, piece), so a large module is many files.
    """
    keys = ["module", "ord", "piece"]
    pieces.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(
        "overwrite").partitionBy("module").parquet(path)


def read_documents(spark: SparkSession, path: str, module: str | None = None) -> DataFrame:
    """(module, ord, piece, text) as written; with `module` only its folder is read."""
    rows = spark.read.schema("ord INT, piece INT, text STRING, module STRING").parquet(path)
    return (rows if module is None else rows.where(F.col("module") == module)).select(
        "module", "ord", "piece", "text")


def document_sizes(pieces: DataFrame) -> DataFrame:
    """(module, parts, chars, bytes) of module documents, from their pieces."""
    per = pieces.groupBy("module", "ord").agg(
        F.sum(F.length("text")).alias("c"), F.sum(F.octet_length("text")).alias("b"))
    return per.groupBy("module").agg(F.count(F.lit(1)).alias("parts"), F.sum("c").alias("chars"),
                                     F.sum("b").alias("bytes"))


def content_documents(parts: DataFrame) -> DataFrame:
    """(module, content): the parts of a module as one value, for modules of the size of a page.

    `content_pieces` has no such bound.
    """
    return parts.groupBy("module").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("ord", "part"))), lambda p: p["part"]), "").alias("content"))


def read_word_boxes(spark: SparkSession, path: str) -> DataFrame:
    """Word boxes of tab-separated files; blank words and unreadable numbers are dropped."""
    raw = (spark.read.option("sep", "\t").option("header", "true").option("quote", "")
           .option("enforceSchema", "false")
           .csv(path).withColumn("page_id", F.col("_metadata.file_name")))
    box = raw.select(
        "page_id", strip(text("text")).alias("text"), F.col("conf").try_cast("double").alias("conf"),
        *[F.col(c).try_cast("int").alias(a) for c, a in
          (("left", "l"), ("top", "t"), ("width", "w"), ("height", "h"))])
    keep = F.col("text") != ""
    for c in ("conf", "l", "t", "w", "h"):
        keep = keep & F.col(c).isNotNull()
    return box.where(keep)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, heading, body) of markdown files."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return sections(files)


def sections(files: DataFrame) -> DataFrame:
    """Level-2 and level-3 sections of (path, text) rows; text before the first is dropped."""
    pieces = F.split("text", r"(?m)(?=^#{2,3} )")
    cut = files.select("path", F.posexplode(pieces).alias("ord", "body")).where(
        F.col("body").rlike(r"^#{2,3} "))
    first = Window.partitionBy("path").orderBy("ord")
    head = F.substring_index("body", "\n", 1)
    return cut.select("path", F.row_number().over(first).alias("ord"), F.trim(
        F.regexp_replace(head, "^[# ]+", "")).alias("heading"),
        F.regexp_replace("body", r"\n$", "").alias("body"))


def read_changeset(spark: SparkSession, ops: str | None = None, fixes: str | None = None,
                   new_notes: str | None = None,
                   multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(ops, new notes) from JSON files; legacy fixes become edit ops after the ops.

    A missing file is empty, both empty is an error.
    """
    def load(path, schema):
        if path is None:
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).option("multiLine", multi_line).json(path)

    main = load(ops, D.OPS)
    last = main.agg(F.coalesce(F.max("op_seq"), F.lit(-1)).alias("m")).scalar()
    legacy = load(fixes, D.OPS).withColumn("op", F.lit("edit")).withColumn(
        "op_seq", (last + 1 + F.col("op_seq")).cast("bigint"))
    every = main.unionByName(legacy, allowMissingColumns=True)
    new = load(new_notes, D.NEW_NOTES)
    if every.isEmpty() and new.isEmpty():
        raise ValueError("nothing to do: no ops and no new notes")
    return every, new


def read_meta(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(path, outstanding, gaps_filled, summary): what sessions say of their change-sets.

    Any number of files is read; keys that a file lacks are empty.
    """
    kind = "outstanding ARRAY<STRING>, gaps_filled ARRAY<STRING>, summary STRING"
    rows = spark.read.schema(kind).option("multiLine", multi_line).json(path)
    none = F.array().cast("array<string>")
    return rows.select(F.col("_metadata.file_path").alias("path"),
                       F.coalesce("outstanding", none).alias("outstanding"),
                       F.coalesce("gaps_filled", none).alias("gaps_filled"),
                       text("summary").alias("summary"))


def open_points(meta: DataFrame) -> DataFrame:
    """(path, kind, place, point): every outstanding point and filled gap, in order."""
    points = [meta.select("path", F.lit(kind).alias("kind"), F.posexplode(kind).alias("_at", "point"))
              for kind in ("outstanding", "gaps_filled")]
    return points[0].unionByName(points[1]).select(
        "path", "kind", (F.col("_at") + 1).alias("place"), "point")

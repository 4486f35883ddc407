"""WARC archives: writing with revisits, and reading by verified chains of boundaries.

Writing. Records are lines of Spark's text writer with the separator that ends a WARC record,
so archives of any number of files lie in any store. Payloads are compared by a 256-bit digest
and their size; of equal ones of MIN_BYTES or more, the one with the largest id is stored,
the others are revisits of it, without payload.

Reading. The text reader cuts files at the magic, in splits of its own choice. A piece's
offset is the sum of the pieces before it, in its split and in the splits before. Every piece
that starts with a whole header is a candidate, and its header's length says where its
successor starts. A magic may stand inside a payload, so candidates are verified from the
start of the file: inside blocks of BLOCK bytes every candidate's chain is followed to where
it leaves the block; the few places where chains enter blocks then double their pointers, in
rounds that grow with the logarithm of the number of blocks of a file. What no chain from the
start reaches is part of a payload; records that were cut by such a magic are put together
again from their pieces. No file, and no payload but one at a time, is held as a whole.

Defined results: a null payload is empty; a null id is smaller than any and is read back as
null; rows that repeat the largest id of a group are all stored; a null address has no
header; an empty table gives no records. A record that the file ends in is read with `whole`
false; behind a place that is neither a candidate nor the end, nothing of that file is read.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgate.operators.skew import lookup_by_key
from corpusgate.session import materialize, scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format.
MAGIC = "WARC/1."
VERSION = "1"
BREAK = "\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"

MIN_BYTES = 1000        # smaller payloads are always stored
BLOCK = 4 << 20         # bytes whose candidates are followed in one task
FILE_RECORDS = 1 << 17  # records of an archive file, at most


# ---- writing ------------------------------------------------------------------------------------

def _lines(*lines: Column) -> Column:
    """Header lines; those that are null are left out."""
    return F.concat_ws(BREAK, *lines)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def _name(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.url_encode(id_.cast("string")), F.lit("")),
                    F.lit(">"))


def record(kind: str, id_: Column, uri: Column, size: Column, sha1: Column, date: Column,
           payload: Column | None = None, refers: Column | None = None) -> Column:
    """A record as a string of bytes, without the separator behind it."""
    # White space or a control character would end the header.
    address = F.when(uri.rlike(r"[\x00-\x20\x7F]"), F.url_encode(uri)).otherwise(uri)
    http = F.concat(_lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                           _line("Content-Length", size.cast("string"))), F.lit(END))
    length = F.octet_length(http) + (size if payload is not None else 0)
    head = _lines(
        F.lit(MAGIC + VERSION), _line("WARC-Type", F.lit(kind)), _line("WARC-Record-ID", _name(id_)),
        _line("WARC-Date", date), _line("WARC-Target-URI", address),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        *([] if refers is None else [_line("WARC-Refers-To", _name(refers)),
                                     _line("WARC-Profile", F.lit(PROFILE))]),
        _line("Content-Type", F.lit(HTTP)), _line("Content-Length", length.cast("string")))
    body = [] if payload is None else [payload.cast("string")]
    return F.concat(head, F.lit(END), http, *body)


def write(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url",
          payload_col: str = "html", min_bytes: int = MIN_BYTES,
          date: str = "1970-01-01T00:00:00Z", file_records: int = FILE_RECORDS) -> None:
    """Archives of all rows below `path`."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"),
                        payload.alias("payload")).select(
        "*", F.octet_length("payload").alias("size"),
        F.concat_ws("-", F.sha2("payload", 256), F.octet_length("payload")).alias("same"))
    facts = materialize(rows.select("id", "uri", "size", "same", F.sha1("payload").alias("sha1")),
                        "payloads")
    groups = materialize(facts.where(F.col("size") >= min_bytes).groupBy("same").agg(
        F.max("id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    again = lookup_by_key(facts, groups, "same", "n", F.col("id")).where(~F.col("id").eqNullSafe(
        F.col("keep")))
    again = materialize(again.select("id", "uri", "size", "same", "sha1", "keep"), "revisits")
    out = again.select(F.col("id").alias("again"), F.col("same").alias("as")).distinct()
    stored = rows.join(out, rows["id"].eqNullSafe(out["again"]) & (rows["same"] == out["as"]),
                       "left_anti")
    when = F.lit(date)
    lines = stored.select(record("response", F.col("id"), F.col("uri"), F.col("size"),
                                 F.sha1("payload"), when, F.col("payload")).alias("value"))
    lines = lines.unionByName(again.select(record(
        "revisit", F.col("id"), F.col("uri"), F.col("size"), F.col("sha1"), when,
        refers=F.col("keep")).alias("value")))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", file_records).text(path)


# ---- reading ------------------------------------------------------------------------------------

def _header(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*?)[ \t]*$", 1)
    return F.when(found != "", found)


def _parsed(value: Column) -> dict[str, Column]:
    """What a piece that starts behind a magic says of itself."""
    head = F.substring_index(value, END, 1)
    body_at = F.octet_length(head) + len(END)
    length = _header(head, "Content-Length").try_cast("bigint")
    starts = value.rlike(r"^[0-9]\r\n") & (F.octet_length(head) < F.octet_length(value))
    block = F.substring(value.cast("binary"), body_at + 1, length.cast("int"))
    is_http = F.lower(_header(head, "Content-Type")).startswith("application/http")
    http = F.when(is_http, F.substring_index(block.cast("string"), END, 1))
    payload = F.when(is_http, F.substring(block, F.octet_length(http) + len(END) + 1,
                                          F.octet_length(block))).otherwise(block)
    name = lambda h: F.regexp_extract(_header(head, h), "<urn:page:(.*)>", 1)
    opened = lambda h: F.when(name(h) != "", F.try_url_decode(name(h)))
    kind = F.lower(_header(head, "WARC-Type"))
    told = F.regexp_extract(_header(head, "WARC-Payload-Digest"), "^sha1:(.*)$", 1)
    return {
        "valid": starts & length.isNotNull(), "length": length,
        "span": body_at + length + len(END) + len(MAGIC),
        "complete": F.octet_length(value) - body_at >= length, "type": kind,
        "id": opened("WARC-Record-ID"), "refers": opened("WARC-Refers-To"),
        "uri": _header(head, "WARC-Target-URI"), "date": _header(head, "WARC-Date"),
        "payload_bytes": F.when(kind == "revisit", _header(http, "Content-Length").cast("bigint"))
        .otherwise(F.octet_length(payload).cast("bigint")),
        "digest": F.when(kind == "revisit", told).otherwise(F.sha1(payload)),
        "payload": F.when(kind != "revisit", payload)}


_FACTS = ("type", "id", "refers", "uri", "date", "payload_bytes", "digest")


def pieces(spark: SparkSession, path: str, files: DataFrame | None = None):
    """Two tables of all pieces, or of those of `files`, read in one scan.

    (file, split, row, raw) and (file, at, split, row, size, valid, next, complete, facts);
    `at` is the offset of the magic in front of the piece. Without `files` the first one is None,
    and no payload is written.
    """
    rows = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("raw"))
    said = _parsed(F.col("raw"))
    keep = ("valid", "span", "complete", *_FACTS)
    if files is not None:
        rows = rows.join(files, "file", "left_semi")
    cut = materialize(rows.select("file", "split", "row", F.octet_length("raw").alias("size"),
                                  *[said[k].alias(k) for k in keep],
                                  *([] if files is None else ["raw"])), "pieces")
    step = F.col("size") + len(MAGIC)
    splits = cut.groupBy("file", "split").agg(F.sum(step).alias("bytes"))
    by_file = Window.partitionBy("file").orderBy("split").rowsBetween(
        Window.unboundedPreceding, -1)
    splits = splits.select("file", "split", F.coalesce(F.sum("bytes").over(by_file),
                                                       F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("row").rowsBetween(
        Window.unboundedPreceding, -1)
    where = cut.select("file", "split", "row", "size", "valid", "span", "complete", *_FACTS,
                       F.coalesce(F.sum(step).over(inside), F.lit(0)).alias("within"))
    where = where.join(splits, ["file", "split"]).withColumn(
        "at", F.col("base") + F.col("within") - len(MAGIC))
    places = materialize(where.select(
        "file", "at", "split", "row", "size", "valid", (F.col("at") + F.col("span")).alias("next"),
        "complete", *_FACTS), "places")
    return None if files is None else cut.select("split", "row", "file", "raw"), places


_LINKS = "file STRING, block BIGINT, at BIGINT, next BIGINT, leave BIGINT"


def _leave_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Where the chain of every candidate leaves the block, from the last one to the first."""
    pdf = pdf.sort_values("at")
    at, following = pdf["at"].to_numpy(), pdf["next"].to_numpy()
    own = np.searchsorted(at, following)
    inside = (own < len(at)) & (at[np.minimum(own, len(at) - 1)] == following)
    leave = following.copy()
    for i in range(len(at) - 1, -1, -1):
        if inside[i]:
            leave[i] = leave[own[i]]
    return pdf.assign(leave=leave)[["file", "block", "at", "next", "leave"]]


_REACHED = "file STRING, block BIGINT, at BIGINT"


def _follow(pdf: pd.DataFrame) -> pd.DataFrame:
    """The records of a block that the chain through it reaches."""
    following = dict(zip(pdf["at"].tolist(), pdf["next"].tolist()))
    found = []
    for place in pdf.loc[pdf["entry"], "at"].tolist():
        while place in following:
            found.append(place)
            place = following[place]
    return pd.DataFrame({"file": pdf["file"].iloc[0], "block": pdf["block"].iloc[0],
                         "at": pd.Series(found, dtype="int64")})


def reached(candidates: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, block, at) of the candidates (file, at, next) that chains from 0 reach."""
    cut = candidates.where(F.col("next") > F.col("at")).select(
        "file", F.floor(F.col("at") / F.lit(block)).alias("block"), "at", "next")
    links = materialize(cut.groupBy("file", "block").applyInPandas(_leave_block, _LINKS), "links")
    exits = links.select("file", F.col("leave").alias("at")).distinct()
    start = links.where("at = 0").select("file", "at")
    entries = links.join(exits.unionByName(start).distinct(), ["file", "at"], "left_semi")
    jump = materialize(entries.select("file", "at", F.col("leave").alias("to")), "jumps")
    seen = start
    # A jump leads to a later block, so a chain has no more of them than its file has blocks.
    blocks = links.groupBy("file").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0]
    for _ in range(int(blocks or 0).bit_length()):
        further = seen.join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        seen = materialize(seen.unionByName(further).distinct(), "seen")
        then = jump.select("file", F.col("at").alias("to"), F.col("to").alias("far"))
        jump = materialize(jump.join(then, ["file", "to"], "left").select(
            "file", "at", F.coalesce("far", "to").alias("to")), "jumps")
    marked = links.join(seen.withColumn("entry", F.lit(True)), ["file", "at"], "left").select(
        "file", "block", "at", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    return materialize(marked.groupBy("file", "block").applyInPandas(_follow, _REACHED), "reached")


def read(spark: SparkSession, path: str, payloads: bool = False, block: int = BLOCK) -> DataFrame:
    """(file, at, type, id, refers, uri, date, payload_bytes, digest, whole) of every record.

    `payload` is added if asked for; revisits have none. The digest is that of the payload
    that was read, for revisits the one they tell.
    """
    _, places = pieces(spark, path)
    kept = reached(places.where("valid"), block).select("file", "at")
    records = materialize(places.join(kept, ["file", "at"]), "records")
    whole = records.where("complete").select("file", "at", F.lit(True).alias("whole"), *_FACTS)
    asked = records if payloads else records.where("not complete")
    if not payloads and asked.isEmpty():
        return whole
    # Once more through the files of the records asked for, this time with their bytes.
    raw, places = pieces(spark, path, asked.select("file").distinct())
    # A piece that no chain reaches belongs to the last record before it.
    cut = places.select("file", "at", "split", "row", F.floor(
        F.greatest("at", F.lit(0)) / F.lit(block)).alias("block")).join(
        kept.withColumn("own", F.col("at")), ["file", "at"], "left")
    ends = cut.groupBy("file", "block").agg(F.max("own").alias("own"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.max("own").over(earlier).alias("carry"))
    so_far = Window.partitionBy("file", "block").orderBy("at").rowsBetween(
        Window.unboundedPreceding, 0)
    owned = cut.withColumn("own", F.max("own").over(so_far)).join(ends, ["file", "block"]).select(
        "file", F.coalesce("own", "carry").alias("own"), "at", "split", "row")
    parts = materialize(owned.join(asked.select("file", F.col("at").alias("own")), ["file", "own"],
                                   "left_semi"), "parts")
    joined = raw.join(parts, ["file", "split", "row"]).groupBy("file", "own").agg(F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "raw"))), lambda x: x["raw"]),
        MAGIC).alias("value"))
    said = _parsed(F.col("value"))
    mended = joined.select("file", F.col("own").alias("at"), said["complete"].alias("whole"), *[
        said[k].alias(k) for k in (*_FACTS, "payload")])
    return mended if payloads else whole.unionByName(mended.drop("payload"))


def round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url",
               payload_col: str = "html", min_bytes: int = MIN_BYTES,
               file_records: int = FILE_RECORDS, block: int = BLOCK) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) as read from the archives."""
    path = scratch_path(pages.sparkSession, "warc")
    write(pages, path, id_col, uri_col, payload_col, min_bytes, file_records=file_records)
    kind = pages.schema[id_col].dataType
    return read(pages.sparkSession, path, block=block).select(
        F.col("id").cast(kind).alias(id_col), "payload_bytes", F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers").cast(kind).alias("refers_to"))

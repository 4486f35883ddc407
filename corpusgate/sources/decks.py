"""Deck archives and file inventories."""

from __future__ import annotations

import base64
import io
import json
import sqlite3
import sys
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate import schemas as D
from corpusgate.functions.base import text
from corpusgate.session import scratch_path

# Collection members of a deck archive, best first, and what is read of each
# table. The first member is compressed.
MEMBERS = ("collection.anki21b", "collection.anki21", "collection.anki2")
TABLES = {
    "notes": "select id as nid, guid, mid, mod, usn, tags, flds, sfld, csum, flags, data from notes",
    "cards": "select * from cards",
    "decks": "select id as did, name from decks",
    "notetypes": "select id as mid, name, mtime_secs, usn, config from notetypes",
}
SCHEMAS = {"notes": D.NOTES, "cards": D.CARDS, "decks": D.DECKS, "notetypes": D.NOTETYPES}
RAW = "kind STRING, deck STRING, path STRING, payload STRING"
BATCH = 5000
# Python workers get this module's functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _open(content: bytes) -> sqlite3.Connection:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        member = next(m for m in MEMBERS if m in names)
        raw = archive.read(member)
    if member == MEMBERS[0]:
        import zstandard

        raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
    con = sqlite3.connect(":memory:")
    con.deserialize(raw)
    con.create_collation("unicase", lambda a, b: (a.lower() > b.lower()) - (a.lower() < b.lower()))
    con.row_factory = sqlite3.Row
    return con


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of every table of every archive, as JSON, a few thousand at a time."""
    def plain(value):
        return base64.b64encode(value).decode() if isinstance(value, bytes) else value

    for pdf in batches:
        for path, deck, content in zip(pdf["path"], pdf["deck"], pdf["content"]):
            con = _open(content)
            have = {r[0] for r in con.execute("select name from sqlite_master where type = 'table'")}
            for kind, sql in TABLES.items():
                if kind not in have:
                    continue
                cursor = con.execute(sql)
                while rows := cursor.fetchmany(BATCH):
                    yield pd.DataFrame({
                        "kind": kind, "deck": deck, "path": path, "payload": [
                            json.dumps({k: plain(r[k]) for k in r.keys()}) for r in rows]})
            con.close()


def read_decks(spark: SparkSession, glob: str, path: str | None = None) -> dict[str, DataFrame]:
    """Tables notes, cards, decks and notetypes of all archives below `glob`.

    Every archive is decoded once, in one task of its own size, and the result is kept as a
    table; `deck` is the folder the archive lies in.
    """
    path = path or scratch_path(spark, "decks")
    files = spark.read.format("binaryFile").load(glob).select(
        "path", F.element_at(F.split("path", "/"), -2).alias("deck"), "content")
    files.mapInPandas(_decode, RAW).write.mode("overwrite").partitionBy("kind").parquet(path)
    stored = spark.read.schema(RAW).parquet(path)
    return {kind: _table(stored, kind, ddl) for kind, ddl in SCHEMAS.items()}


def _table(stored: DataFrame, kind: str, ddl: str) -> DataFrame:
    columns = ddl.split(", ", 1)[1]
    rows = stored.where(F.col("kind") == kind).select(
        "deck", F.from_json("payload", columns).alias("r"))
    return rows.select("deck", "r.*")


def file_inventory(spark: SparkSession, glob: str, prefix: int | None = None) -> DataFrame:
    """(path, sha256) of every file, the digest in full or cut to `prefix` hex digits."""
    digest = F.sha2("content", 256)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(glob)
    return files.select("path", (F.substring(digest, 1, prefix) if prefix else digest)
                        .alias("sha256"))


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """Progress files; one that cannot be parsed keeps its row with `complete` null."""
    raw = spark.read.text(path, wholetext=True).select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("module"), "value")
    parsed = F.from_json("value", "last_index BIGINT, total BIGINT, complete BOOLEAN, "
                         "_corrupt STRING", {"columnNameOfCorruptRecord": "_corrupt"})
    return raw.withColumn("p", parsed).select(
        "module", "p.last_index", "p.total",
        F.when(F.col("p._corrupt").isNull(), F.col("p.complete")).alias("complete"),
        text("p._corrupt").alias("_corrupt"))

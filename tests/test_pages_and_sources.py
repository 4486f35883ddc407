import io
import json
import os
import sqlite3
import tempfile
import zipfile

import zstandard
from pyspark.sql import functions as F

from corpusgate.operators import coverage as B
from corpusgate.operators import order as O
from corpusgate.operators import topics as K
from corpusgate.sources import decks, texts


def test_islands(spark):
    def bands(*marks):
        df = spark.createDataFrame([("p", m, 100) for m in marks], "page_id string, y int, top int")
        out = O.band_islands(df, ["page_id"], "y", "y", limit="top")
        return sorted((r.y0, r.y1) for r in out.collect())
    assert bands(10, 28) == [(0, 39)]
    assert bands(10, 29) == [(0, 40)]
    assert bands(10, 60) == [(0, 21), (50, 71)]
    assert bands(95) == [(85, 100)]
    # Blocks cut the positions; the runs must not show it.
    far = spark.createDataFrame([("p", m) for m in range(4000, 4200, 10)], "page_id string, y int")
    assert O.band_islands(far, ["page_id"], "y", "y").count() == 1


def test_bands_against_rows(spark):
    boxes = spark.createDataFrame(
        [("p", "abc", 10.0, 0, 100, 5, 10), ("p", "12", 99.0, 0, 105, 5, 60), ("p", "7", 99.0, 0, 400, 5, 10)],
        "page_id string, text string, conf double, l int, t int, w int, h int")
    pages = spark.createDataFrame([("p", 500, 500)], "page_id string, page_w int, page_h int")
    got = {(r.kind, r.y0, r.y1) for r in B.page_bands(boxes, pages).collect()}
    assert got == {("eyes", 88, 122), ("numeric", 112, 177), ("numeric", 388, 422)}


def test_read_plan(spark):
    row = dict(words_total=5, informative_ink_px=9, unaccounted_ink_px=0, furniture_frac=0.1, bands=2,
               num_bands=1, sheet_tokens=50, page_tokens=100, numbers_tokens=5)
    cases = [({"words_total": 0}, "page"), ({"words_total": 0, "informative_ink_px": 0}, "none"),
             ({"unaccounted_ink_px": 1}, "page"), ({"furniture_frac": 0.16}, "page"), ({"bands": 40}, "page"),
             ({"sheet_tokens": 85}, "page"), ({}, "sheet"), ({"bands": 0, "sheet_tokens": 0}, "numbers-only"),
             ({"bands": 0, "num_bands": 0, "sheet_tokens": 0}, "none")]
    df = spark.createDataFrame([{**row, **c, "i": i} for i, (c, _m) in enumerate(cases)])
    assert [r.mode for r in B.read_plan(df).orderBy("i").collect()] == [m for _c, m in cases]


def test_topics(spark):
    rows = [("a", i, "filler%s common" % chr(97 + i % 26), "") for i in range(200)]
    rows += [("a", 1000, "quixotic 7 mg/kg at T10", ""), ("b", 1001, "quixotic 7 mg/kg at T10", "")]
    notes = spark.createDataFrame(rows, "deck string, nid bigint, text string, extra string")
    found = {r.topic: (r.n_cards, r.n_decks) for r in K.topics(notes).collect()}
    assert found["quixotic"] == (2, 2) and found["#7mg/kg"] == (2, 2)
    assert "t10" not in found and "#t10" not in found and "common" not in found


def test_read_decks(spark):
    root = tempfile.mkdtemp(prefix="decks-")
    for deck, packed in (("one", True), ("two", False)):
        con = sqlite3.connect(":memory:")
        con.execute("create table notes (id integer primary key, guid text, mid integer, mod integer, usn integer,"
                    " tags text, flds text, sfld text, csum integer, flags integer, data text)")
        con.executemany("insert into notes values (?,?,1,1,-1,'',?,'',0,0,'')",
                        [(i, f"g{i}", f"front {i}\x1fback") for i in range(3)])
        con.execute("create table decks (id integer, name text)")
        con.execute("insert into decks values (7, ?)", ("Top\x1f" + deck,))
        con.commit()
        raw = con.serialize()
        os.makedirs(f"{root}/{deck}")
        with zipfile.ZipFile(f"{root}/{deck}/x.apkg", "w") as z:
            if packed:
                buffer = io.BytesIO()
                with zstandard.ZstdCompressor().stream_writer(buffer, closefd=False) as w:
                    w.write(raw)
                z.writestr("collection.anki21b", buffer.getvalue())
                z.writestr("collection.anki2", b"stub")
            else:
                z.writestr("collection.anki2", raw)
    tables = decks.read_decks(spark, f"{root}/*/*.apkg")
    from corpusgate.operators.notes import unpack_fields
    notes = unpack_fields(tables["notes"]).orderBy("deck", "nid").collect()
    assert len(notes) == 6 and notes[0].deck == "one" and notes[4].text == "front 1"
    assert notes[0].extra == "back" and notes[0].resources == ""
    leaf = O.deepest_deck(tables["decks"], ["deck"]).collect()
    assert {(r.deck, r.leaf) for r in leaf} == {("one", "one"), ("two", "two")}
    assert decks.file_inventory(spark, root, 16).count() == 2


def test_text_sources(spark):
    root = tempfile.mkdtemp(prefix="texts-")
    os.makedirs(f"{root}/mod")
    for name, body in (("p10.txt", "ten"), ("p2.md", "two"), ("skip.exe", "no")):
        with open(f"{root}/mod/{name}", "w") as f:
            f.write(body)
    content = texts.content_documents(texts.read_sources(spark, root)).first().content
    assert content == "\n--- p2.md ---\ntwo\n--- p10.txt ---\nten"
    with open(f"{root}/export.txt", "w") as f:
        f.write("# head\nfront | back\n\nonly\n")
    rows = texts.read_text_export(spark, f"{root}/export.txt").orderBy("nid").collect()
    assert [(r.nid, r.text, r.extra) for r in rows] == [(2, "front", "back"), (4, "only", "")]
    os.makedirs(f"{root}/work/m1"), os.makedirs(f"{root}/work/m2"), os.makedirs(f"{root}/work/m3")
    for m, body in (("m1", json.dumps({"complete": True})), ("m2", "{broken"), ("m3", json.dumps({"total": 3}))):
        with open(f"{root}/work/{m}/progress.json", "w") as f:
            f.write(body)
    from corpusgate.operators.registry import unfinished_items
    open_ = unfinished_items(decks.read_progress(spark, f"{root}/work/*/progress.json"))
    assert {r.module for r in open_.collect()} == {"m2", "m3"}


def test_completeness(spark):
    pages = spark.createDataFrame([("d", "Page 1 of 5 x Page 2 of 5"), ("d", "Page 4 0f 5"), ("e", "none")],
                                  "doc string, text string")
    got = {r.doc: r for r in B.page_completeness(pages).collect()}
    assert got["d"].missing == [3, 5] and got["d"].total == 5 and got["e"].found is None


def test_hot_key_lookup(spark):
    from corpusgate.operators.skew import lookup_by_key
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, "hot").otherwise(
        F.concat(F.lit("k"), "id")).alias("key"))
    dim = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("key <> 'k2500'")
    out = lookup_by_key(rows, dim, "key", "n", F.col("id"))
    assert out.count() == 2999 and out.where("n = 2000").count() == 2000
    assert lookup_by_key(rows, dim, "key", "n", F.col("id"), "left").count() == 3000


def test_source_files_are_bounded_and_whole(spark, monkeypatch):
    from corpusgate.plans import files

    root = tempfile.mkdtemp(prefix="sources-")
    n = 8 * 1200
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("a\nb "), "id").alias("text"))
    docs.write.parquet(f"{root}/documents.parquet")
    monkeypatch.setattr(files, "scratch_path", lambda spark, name: f"{root}/{name}")
    got = {r.module: (r.parts, r.chars) for r in files.read_sources(spark, root).collect()}
    assert got == {f"m{m}": (1200, sum(4 + len(str(i)) for i in range(m, n, 8)))
                   for m in range(8)}
    marks = spark.read.text(f"{root}/sources", wholetext=True).select(
        F.max(F.regexp_count("value", F.lit("\x01")))).first()[0]
    assert marks <= 500

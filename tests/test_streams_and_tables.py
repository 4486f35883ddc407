"""Keyed streams, the merge table, sketches, SQL functions, sinks and numbering."""

import datetime
import math
import os
import tempfile

from pyspark.sql import functions as F

from corpusgate.functions import sql as Q
from corpusgate.functions import text as T
from corpusgate.functions.base import is_blank
from corpusgate.operators import report as P
from corpusgate.operators import topics as K
from corpusgate.session import scratch_path, subfolders, sweep
from corpusgate.sources import sinks, texts
from corpusgate.streaming import streams as X
from corpusgate.streaming.merge_table import MergeTable

DAY = 86_400_000


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_values_expire_late_rows_go_and_state_survives(spark):
    path = tempfile.mkdtemp(prefix="collisions-")
    kind = "subject STRING, attribute STRING, value STRING, ts TIMESTAMP"
    os.makedirs(f"{path}/in")
    batches = [
        [("a", "x", "1", 0), ("a", "x", "1", 0), ("a", "x", "2", 1), ("b", "x", "1", 1), (None, "x", "9", 1)],
        [("a", "x", "3", 5), ("a", "x", "2", 6), ("c", "x", "1", 30)],   # 1 has run out by day 11
        [("a", "x", "7", 2), ("a", "x", "4", 31), ("b", "x", "2", 31)],  # day 2 is late, all ran out
        [("a", "x", "4", 32), ("a", "x", "5", 33), ("a", "x", "1", 33)]]
    seen = []
    for rows in batches:
        spark.createDataFrame([(s, a, v, day(n)) for s, a, v, n in rows], kind).coalesce(1).write.mode(
            "append").parquet(f"{path}/in")
        stream = X.collision_stream(X.intake_stream(spark, f"{path}/in", kind), "ts", "1 day", 10 * DAY)
        X.run_once(stream, f"{path}/out", f"{path}/checkpoint", keyed=True)
        out = spark.read.schema(stream.schema).parquet(f"{path}/out").collect()
        seen.append({(r["subject"], r["value"], tuple(r["others"])) for r in out})
    assert seen[0] == {("a", "2", ("1",))}
    assert seen[1] - seen[0] == {("a", "3", ("1", "2"))}
    assert seen[2] == seen[1]
    assert seen[3] - seen[2] == {("a", "1", ("4",)), ("a", "5", ("1", "4"))}


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path)
               for f in names if f.endswith(".parquet"))


def test_merge_table_writes_what_a_batch_holds(spark):
    path = tempfile.mkdtemp(prefix="merge-")
    kind = "name STRING, ts BIGINT, status STRING"
    table = MergeTable(spark, path, kind, buckets=16, every=3)
    frame = lambda rows: spark.createDataFrame(rows, kind)
    state = {}

    def put(rows, epoch):
        for n, t, s in rows:
            state[n] = max(state.get(n, (t, s)), (t, s))
        table.upsert(frame(rows), epoch)

    put([(f"n{i}", 5, "old") for i in range(20000)], 0)
    put([("n1", 6, "new"), ("n1", 4, "late")], 1)
    assert size_of(f"{path}/delta/epoch=1") < size_of(f"{path}/delta/epoch=0") / 20
    put([("n2", 6, "b"), ("n2", 6, "a")], 2)                       # folds all three
    assert subfolders(spark, f"{path}/delta") == []
    whole = size_of(f"{path}/base")
    for epoch, name in ((3, "n1"), (4, "n1"), (5, "n7")):
        put([(name, epoch + 10, "x")], epoch)
    # Two buckets at most were written again, the others still lie where they were.
    assert size_of(f"{path}/base/upto=5") < whole / 4
    assert size_of(f"{path}/base") < whole * 1.1
    put([("n9", 1, "too old"), ("z", 1, None)], 6)
    table.upsert(frame([("n9", 1, "too old"), ("z", 1, None)]), 6)   # replayed
    table.upsert(frame([]), 7)
    again = MergeTable(spark, path, kind, buckets=16, every=3)       # after a restart
    got = {r["name"]: (r["ts"], r["status"]) for r in again.read().collect()}
    assert got == state
    # A compaction that ended before it removed anything changes no result.
    rows = again._newest(again._part("delta", "epoch").select(*again.schema.names))
    again._write(rows, "base/upto=6")
    assert {r["name"]: (r["ts"], r["status"]) for r in again.read().collect()} == state


def test_sketch_estimates_are_bounded_and_merge(spark):
    rows = spark.range(30000).select(
        F.concat(F.lit("d"), F.pmod("id", F.lit(3))).alias("deck"),
        F.concat(F.lit("t"), F.floor(F.sqrt(F.col("id")))).alias("term"))
    width = 64
    parts = [K.frequency_sketch(rows.where(f"hash(deck, term) % 2 {op} 0"), width=width) for op in ("=", "<>")]
    whole = K.frequency_sketch(rows, width=width)
    merged = K.merge_sketches(*parts)
    assert whole.exceptAll(merged.select(whole.columns)).count() == 0
    assert whole.groupBy("deck").count().agg(F.max("count")).first()[0] <= K.DEPTH * width
    terms = rows.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("deck").alias("d"))
    got = K.with_estimates(terms, merged, "term", "e", "ed", width=width).collect()
    bound = math.e / width * 30000
    assert all(r["e"] >= r["n"] and r["ed"] >= r["d"] for r in got)
    assert sum(r["e"] - r["n"] > bound for r in got) <= len(got) * math.exp(-K.DEPTH) + 1
    fine = K.with_estimates(terms, K.frequency_sketch(rows), "term", "e", "ed").where("e <> n or ed <> d")
    assert fine.count() == 0


def test_topics_by_sketch_equal_exact_ones_on_few_terms(spark):
    words = ["aorta", "femur", "tibia", "retina", "cornea", "spleen", "thymus", "uvula"]
    notes = spark.createDataFrame(
        [(f"d{i % 3}", i, f"{words[i % 8]} {words[i * 5 % 8]} {'x' * (i % 9 + 3)} {i} mm", "") for i in range(60)],
        "deck STRING, nid BIGINT, text STRING, extra STRING")
    shown = lambda df: sorted((r.topic, r.n_cards, r.n_decks, tuple(r.decks), len(r.cards))
                              for r in df.collect())
    exact, approx = K.topics(notes), K.topics(notes, approx=True)
    assert shown(exact) == shown(approx) and exact.count() > 0
    plan = K.sized_members(K.topic_rows(K.fingerprints(notes), approx=True), approx=True)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in text.split("Subquery")[0]


def test_sql_functions_equal_column_functions_without_python(spark):
    names = Q.register(spark, "cg_")
    assert len(names) == len(Q.FUNCTIONS)
    rows = [(None,), ("",), ("a <b>x</b>; {{c1::ans::hint}} &amp; [sound:q.mp3]<br>two. Three  ",),
            ("   pad <li>it</li><img src='m.png'>",)]
    df = spark.createDataFrame(rows, "c STRING")
    out = spark.sql("""SELECT cg_plain_text(c) a, cg_marked_text(c) b, cg_compact_text(c) d, cg_sort_field(c) e,
        cg_checksum32(c) f, cg_sentence_list(c) g, cg_has_semicolon(c) h, cg_normalize_extra(c) i,
        cg_strip_tags(c, ' ') j, cg_is_blank(c) k FROM {df}""", df=df)
    want = df.select(T.plain("c").alias("a"), T.plain("c", True).alias("b"), T.compact("c").alias("d"),
                     T.sort_field("c").alias("e"), T.checksum32("c").alias("f"), T.sentences("c").alias("g"),
                     T.has_semicolon("c").alias("h"), T.normalize_extra("c").alias("i"),
                     T.strip_tags("c", " ").alias("j"), is_blank("c").alias("k"))
    assert out.collect() == want.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "cg_" not in plan
    assert spark.sql("SELECT cg_same_name('Öl A', 'öL a'), cg_same_name('a', 'b')").first() == (True, False)


def test_round_trip_evaluates_its_source_once(spark):
    path = tempfile.mkdtemp(prefix="round-")
    rows = spark.range(500).select("id", F.expr("uuid()").alias("u"))
    assert sinks.roundtrip_check(rows, path).first() == (500, 500, True)
    assert sinks.roundtrip_check(rows.where("false"), path).first() == (0, 0, True)


def test_sections_of_sparse_entries_are_numbered(spark):
    rows = [(10 ** 12 * (i % 7) + i * 10 ** 9, ["EDIT", "SKIP", "DELETE", "other"][i % 4], i, f"r{i % 2}")
            for i in range(200)] + [(3, "EDIT", 900, "r"), (3, "EDIT", 900, "q")]
    log = spark.createDataFrame(rows, "seq BIGINT, kind STRING, nid BIGINT, reason STRING")
    got = P.changelog_sections(log).collect()
    for kind in ("EDIT", "SKIP", "DELETE"):
        want = sorted((s, n, r) for s, k, n, r in rows if k == kind)
        own = sorted((x for x in got if x.kind == kind), key=lambda x: x.place)
        assert [(x.nid, x.reason) for x in own] == [(n, r) for _, n, r in want]
        assert [x.place for x in own] == list(range(1, len(want) + 1))
    assert len(got) == sum(k != "other" for _, k, *_ in rows)


def test_module_documents_in_pieces(spark):
    parts = spark.createDataFrame(
        [("m", 2, "bb" * 700), ("m", 1, "é\n" * 1000), ("n", 1, ""), ("n", 2, "z")],
        "module STRING, ord INT, part STRING")
    path = tempfile.mkdtemp(prefix="pieces-")
    texts.write_documents(texts.content_pieces(parts, 300), path)
    got = texts.read_documents(spark, path, "m").orderBy("ord", "piece").collect()
    assert max(len(r.text) for r in got) == 300
    assert "".join(r.text for r in got) == "é\n" * 1000 + "bb" * 700
    sizes = {r.module: (r.parts, r.chars, r.bytes) for r in texts.document_sizes(
        texts.read_documents(spark, path)).collect()}
    assert sizes == {"m": (2, 3400, 4400), "n": (2, 1, 1)}


def test_sweep_removes_old_scratch_tables_only(spark):
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    name = path.split("/")[-1]
    assert name not in sweep(spark, 1.0)
    assert name in sweep(spark, 0.0)
    assert not os.path.exists(path)

"""Findings of the third review: memory and time that grew with the input."""

import tempfile

from corpusgate.session import materialize


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_texts_that_stay_are_not_shuffled_when_near_copies_go(spark):
    from corpusgate.llm import near
    rows = [(i, f"text {i}") for i in range(300)] + [(7, "again"), (None, "no id")]
    docs = materialize(spark.createDataFrame(rows, "doc_id bigint, text string"), "docs")
    gone = materialize(spark.createDataFrame([(i,) for i in (7, 8, 250, 999)], "doc_id bigint"), "gone")
    out = near.without(docs, gone, "doc_id")
    assert rows_of(out) == sorted([r for r in rows if r[0] not in (7, 8, 250)], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.columns == docs.columns and "Union" in plan and "LeftAnti" in plan


def test_texts_go_to_python_in_small_batches(spark):
    from corpusgate.llm import common
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(setting, "10000")
    try:
        def make():
            def work(batch):
                return {"n": [len(batch["id"])]}
            return work
        sizes = common.map_batches(spark.range(0, 3000, 1, 1), make, "n BIGINT").collect()
        assert sum(r.n for r in sizes) == 3000 and max(r.n for r in sizes) <= common.BATCH
    finally:
        spark.conf.unset(setting)


SMALL = "/root/testdata/sf0.001"


def test_pages_are_dealt_over_tasks_that_follow_the_rows(spark, monkeypatch):
    from corpusgate.operators import coverage as B
    boxes = spark.createDataFrame(
        [(p, "word" if i % 3 else "12 mg", float(i * 37 % 101), 40 * (i // 8), 12 + i % 5)
         for p in range(20) for i in range(100)],
        "page_id bigint, text string, conf double, t bigint, h bigint")
    pages = spark.createDataFrame([(p, 700) for p in range(20)], "page_id bigint, page_h bigint")
    whole = rows_of(B.page_bands(boxes, pages))
    monkeypatch.setattr(B, "TASK_ROWS", 100)
    dealt = B.page_bands(boxes, pages)
    assert whole and rows_of(dealt) == whole
    assert "RepartitionByExpression [page_id" in dealt._jdf.queryExecution().optimizedPlan().toString()


def test_terms_of_a_long_note_are_looked_up_and_not_searched_one_by_one(spark):
    import time
    from pyspark.sql import functions as F
    from corpusgate.operators.relate import missing_terms
    rows = [("Antigen <b>kept</b> receptor LIGAMENT", "the ANTIGENS, ligament", ["receptor"]),
            ("nothing short", "", ["nothing"]), ("alphabeta", "alpha-beta", ["alphabeta"])]
    df = spark.createDataFrame(rows, "body string, kept string, want array<string>")
    assert all(r.got == r.want for r in df.select(missing_terms(F.col("body"), F.col("kept")).alias(
        "got"), "want").collect())
    letters = F.translate(F.format_string("%06d", F.col("id")), "0123456789", "abcdefghij")
    long = materialize(spark.range(100_000).agg(F.array_join(F.collect_list(letters), " ").alias("t")))
    began = time.time()
    assert long.select(F.size(missing_terms(F.col("t"), F.col("t"))).alias("n")).first().n == 0
    assert time.time() - began < 15


def test_frequencies_of_terms_parse_no_numbers(spark):
    from corpusgate.plans import registry
    for name in ("inverse_document_frequency", "document_frequency"):
        files = registry()[name].build(spark, SMALL).inputFiles()
        assert files and not [f for f in files if "fingerprints" in f]


def test_lost_items_read_every_text_once(spark):
    import re
    from corpusgate.plans import registry
    plan = registry()["corpus_lost_items"].build(spark, SMALL)._jdf.queryExecution().optimizedPlan()
    assert len(re.findall(r"Relation \[doc_id#\d+L?,text#", plan.toString())) == 1

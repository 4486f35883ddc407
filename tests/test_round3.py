"""Tables in other layouts, and steps whose work must not outgrow their input."""

import tempfile

import pytest

from corpusgate.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark):
    """The streamed tables as folders of several files."""
    base = tempfile.mkdtemp(prefix="spark-")
    for name in ("documents", "events"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").repartition(3).write.parquet(f"{base}/{name}.parquet")
    return base


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["intake_stream", "dedupe_stream", "gate_stream", "session_stream"])
def test_streams_read_tables_that_are_folders(spark, folders, name):
    build = registry()[name].build
    want = rows(build(spark, SMALL))
    assert want and rows(build(spark, folders)) == want


def test_repeated_sentences_are_parsed_once_and_claimed_by_every_note(spark):
    from corpusgate.operators import claims as C
    sentence = "The vagus nerve has {} layers near the carotid sheath."
    notes = spark.createDataFrame([("d", i, sentence.format(i % 2 + 2), "") for i in range(40)],
                                  "deck string, nid bigint, text string, extra string").repartition(3)
    lexicon = C.build_lexicon(notes)
    assert {r.phrase: r.n for r in lexicon.subjects.collect()}["the vagus nerve"] == 40
    distinct = C.distinct_sentences(C.note_sentences(notes))
    known = C.known_subjects(distinct, lexicon)
    assert sorted(r.n for r in C.distinct_claims(distinct, known).collect()) == [20, 20]
    found = C.extract_claims(notes, lexicon).collect()
    assert sorted((r.nid, r.subject, r.value) for r in found) == [
        (i, "vagus nerve", str(i % 2 + 2)) for i in range(40)]


def test_notes_of_one_row_group_are_spread(spark):
    from corpusgate.plans.checks import spoken_notes
    from corpusgate.plans.claim import order_notes
    assert spark.conf.get("spark.corpusgate.spread", None) is None
    assert order_notes(spark, SMALL).rdd.getNumPartitions() == 4
    assert spoken_notes(spark, SMALL).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("n_hot", [0, 5000])
def test_lookup_of_stored_rows(spark, n_hot):
    from corpusgate.operators.skew import lookup_stored
    rows = spark.createDataFrame([(i, "hot" if i < n_hot else f"k{i % 70}") for i in range(7000)],
                                 "id bigint, key string")
    table = rows.groupBy("key").count().withColumnRenamed("count", "n").where("key <> 'k3'")
    want = rows.where("key <> 'k3'").join(table, "key").select("id", "key", "n")
    got = lookup_stored(rows, table, "key", "n")
    assert got.columns == ["id", "key", "n"] and rows_of(got) == rows_of(want)


def test_rows_of_a_claim_are_in_order_whatever_the_arrow_batches(spark):
    import datetime
    from corpusgate.streaming import streams as X
    path = tempfile.mkdtemp(prefix="spark-")
    kind = "subject STRING, attribute STRING, value STRING, ts TIMESTAMP"
    start = datetime.datetime(2024, 1, 1)
    claims = [("a", "x", str(n), start + datetime.timedelta(days=n)) for n in (8, 1, 6, 3, 7, 2, 5, 4)]
    spark.createDataFrame(claims + [("b", "x", "9", start)], kind).coalesce(1).write.parquet(f"{path}/in")
    stream = X.collision_stream(X.intake_stream(spark, f"{path}/in", kind), "ts", keep_ms=2 * 86_400_000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        X.run_once(stream, f"{path}/out", f"{path}/checkpoint", keyed=True)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = spark.read.schema(stream.schema).parquet(f"{path}/out").collect()
    assert sorted((r["subject"], r["value"], tuple(r["others"])) for r in found) == [
        ("a", str(n), (str(n - 1),)) for n in range(2, 9)]


def test_new_collisions_groups_the_claims_once(spark):
    found = registry()["new_collisions"].build(spark, SMALL)
    assert not [f for f in found.inputFiles() if "lineitem" in f]


def rows_of(df):
    return sorted(map(tuple, df.collect()))

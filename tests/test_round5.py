"""Findings of the fourth review: pages without text, and the time of claim streams."""

import random
import tempfile

import pytest

from corpusgate.plans import registry


def same_as_sql(spark, name, folder):
    """Rows of a query over a folder that holds documents alone, if its SQL gives the same."""
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(registry()[name].sql)
    columns = [c[0] for c in want.description]
    got = sorted(map(tuple, registry()[name].build(spark, folder).select(columns).collect()))
    assert got == sorted(want.fetchall())
    return [dict(zip(columns, row)) for row in got]


@pytest.fixture(scope="module")
def blank(spark):
    """Documents around zero whose text is empty or missing, or whose length is."""
    texts = [("", 0), (None, 0), (None, None), ("12 mg", None), ("IV 12 mg a b c d e f", 20)]
    rows = [(18 * at + i, text, n) for at, (text, n) in enumerate(texts, -2) for i in range(18)]
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").coalesce(1).write.parquet(
        f"{folder}/documents.parquet")
    return folder


def test_pages_without_text_have_the_mode_of_the_sql(spark, blank):
    modes = {r["page_id"]: r["mode"] for r in same_as_sql(spark, "box_read_plan", blank)}
    assert len(modes) == 90 and modes[1] == modes[10] == "page"


def test_pages_without_text_cost_a_blank_page(spark, blank):
    assert min(r["page_tokens"] for r in same_as_sql(spark, "page_cost", blank)) == 52


def test_coverage_of_pages_without_text(spark, blank):
    assert same_as_sql(spark, "coverage_summary", blank)[0]["pass"]


def test_report_of_pages_without_text(spark, blank):
    assert sum(r["n"] for r in same_as_sql(spark, "write_page_report", blank)) == 90


def collisions_one_by_one(held, rows, keep_ms):
    """(subject, attribute, at, value, others) of rows taken in order; `held` is carried on."""
    out = []
    for subject, attribute, at, value in sorted(set(rows)):
        values = held.setdefault((subject, attribute), {})
        if value not in values or values[value] <= at:
            others = [o for o in sorted(values) if o != value and values[o] > at]
            if others:
                out.append((subject, attribute, at, value, others))
        values[value] = max(values.get(value, at), at + keep_ms)
    return out


@pytest.mark.parametrize("pairs", [1, 5, 1 << 20])
def test_collisions_of_columns_are_those_of_rows_one_by_one(monkeypatch, pairs):
    import pyarrow as pa
    from corpusgate.streaming import streams as X
    monkeypatch.setattr(X, "PAIRS", pairs)
    some = random.Random(pairs)
    for _ in range(150):
        held, kept, keep_ms = {}, X.HELD.empty_table(), some.choice([0, 1, 5, 40])
        for batch in range(4):
            rows = [(some.choice("ab"), some.choice("xy\u00e9"), 20 * batch + some.randint(-25, 40), some.choice(
                ["1", "10", "2", "\u00e9", "z", "\U0001f600"])) for _ in range(some.randint(1, 60))]
            want = collisions_one_by_one(held, rows, keep_ms)
            found = dict(zip(["subject", "attribute", "at", "value"], zip(*rows)))
            kept, out = X.collide(X.unpacked(X.packed(kept)), pa.table(found), keep_ms)
            out["at"] = out["at"].astype("int64") // 1_000_000
            out["others"] = out["others"].map(list)
            got = out[["subject", "attribute", "at", "value", "others"]].itertuples(index=False, name=None)
            assert sorted(got) == sorted(want)
            assert sorted(zip(*kept.to_pydict().values())) == sorted(
                (*claim, v, until) for claim, values in held.items() for v, until in values.items())


def test_a_bucket_of_many_claims_is_one_row_of_state_and_few_calls():
    import pandas as pd
    from corpusgate.streaming import streams as X

    class State:
        """Handle, state and timers in one, which counts the rows and calls that pass."""

        def __init__(self):
            self.passed, self.held = 0, None

        def getValueState(self, *_):
            return self

        getListState = getValueState

        def exists(self):
            return self.held is not None

        def get(self):
            self.passed += 1
            return self.held

        def put(self, held):
            self.passed += len(held)
            self.held = held

        update = put

        def registerTimer(self, _):
            self.passed += 1

        def getCurrentWatermarkInMs(self):
            return 0

    state, n = State(), 3000
    bucket = X.ValueSet(10)
    bucket.init(state)
    rows = pd.DataFrame({"subject": [f"part {i}" for i in range(n)], "attribute": "count", "value": "1",
                         "at": range(5, n + 5)})
    assert sum(map(len, bucket.handleInputRows((1,), iter([rows]), state))) == 0
    again = rows.assign(value="2", at=rows["at"] + 1)
    assert sum(map(len, bucket.handleInputRows((1,), iter([again]), state))) == n
    assert state.passed < 10

import random

import pytest
from pyspark.sql import functions as F

from corpusgate import schemas as D
from corpusgate.operators import changeset as C
from corpusgate.operators import relate as J
from corpusgate.operators import report as P

TAIL = ("own", "c", "m", "book", "res")


def notes_df(spark):
    def row(nid, text, extra, tail=("",) * 5):
        return ("d", nid, text, extra, *tail, "tag", None, None)
    return C.with_sort_fields(spark.createDataFrame([
        row(1000, "{{c1::a}} {{c1::b}} {{c1::c}}", ' <img src="figA.png">', TAIL),
        row(1001, "Alpha anatomy {{c1::x}}", " structure", TAIL),
        row(1002, "minor detail {{c1::y}}", " small"),
        row(1003, "redundant {{c1::z}}", " r"),
        row(1004, "wrongly {{c1::q}}", " <b><u>wrong</u></b> [sound:clipB.mp3]", TAIL)], D.NOTES7))


def ops_df(spark, *rows):
    return spark.createDataFrame([{**r, "op_seq": i} for i, r in enumerate(rows)], D.OPS)


FIVE = (
    {"nid": 1000, "op": "split", "why": "multi", "into": [
        {"text": "a", "extra": '<img src="figA.png">'}, {"text": "b", "extra": "e"},
        {"text": "c", "extra": ""}]},
    {"nid": 1001, "op": "rewrite", "text": "Alpha anatomy new", "extra": "structure more"},
    {"nid": 1002, "op": "demote", "into_nid": 1001, "facts": ["minor detail y small"]},
    {"nid": 1003, "op": "delete"},
    {"nid": 1004, "op": "edit", "field": 1, "find": "wrong", "replace": "right"})


def gate(spark, notes, ops, run):
    return J.preservation_gate(notes, run.notes, C.clean_ops(ops), C.op_kinds(run.changelog)).collect()


def test_five_ops(spark):
    notes = notes_df(spark)
    cards = spark.createDataFrame([("d", 5000 + i, 1000 + i, 77, 0, 0, -1, *[0] * 11, "")
                                   for i in range(5)], D.CARDS)
    new = spark.createDataFrame([(0, "fresh", "x"), (1, "<b>Fresh</b>", "x")], D.NEW_NOTES)
    ops = ops_df(spark, *FIVE)
    run = C.apply_changeset(notes, cards, ops, new, now_ms=2000, deck_id=77, deck="d")
    after = {r.nid: r for r in run.notes.collect()}
    assert sorted(after) == [1001, 1004, 2000, 2001, 2002, 2003]
    assert after[1001].extra == " structure more<br><br>minor detail y small"
    assert after[2000].personal == "own" and after[2001].personal == ""
    assert "right" in after[1004].extra
    books = P.accounting(run.changelog, notes, run.notes).first()
    assert books["pass"] and books.expected == 6
    assert P.ops_applied(run.changelog, ops).first()["pass"]
    assert gate(spark, notes, ops, run) == []
    assert C.drifted(run.notes).count() == 0
    assert run.cards.count() == 6 and run.cards.where("nid = 2003").count() == 1
    assert [r.kind for r in run.changelog.orderBy("seq").collect()][-2:] == ["ADD", "DUPE-SKIP"]


@pytest.mark.parametrize("op,problem", [
    ({"nid": 1001, "op": "delete"}, "would destroy"),
    ({"nid": 1001, "op": "delete", "drop_tail": True, "drop_media": True}, None),
    ({"nid": 1004, "op": "rewrite", "text": "t", "extra": "e"}, "no longer referenced"),
])
def test_preservation(spark, op, problem):
    notes, ops = notes_df(spark), ops_df(spark, op)
    found = gate(spark, notes, ops, C.apply_changeset(notes, None, ops))
    assert (problem is None and not found) or problem in found[0].problem


def brute_force(notes, ops):
    """Ops one after the other on a dictionary of (text, extra)."""
    import re
    state, log = dict(notes), []
    for o in ops:
        nid, kind = o["nid"], o["op"]
        now = state.get(nid)
        done = now is not None
        if done and kind == "edit":
            done = o["find"] in now[0]
            if done:
                state[nid] = (now[0].replace(o["find"], o["replace"]), now[1])
        elif done and kind == "demote":
            goal = state.get(o["into_nid"])
            kept = " ".join([*o["facts"], goal[1], goal[0]]).lower() if goal else ""
            words = re.findall("[A-Za-z]{6,}", now[0] + " " + now[1])
            done = goal is not None and all(w.lower() in kept for w in words)
            if done:
                state[o["into_nid"]] = (goal[0], goal[1].rstrip() + "".join(
                    "<br><br>" + f for f in o["facts"]))
                state[nid] = None
        elif done and kind == "delete":
            state[nid] = None
        log.append(kind.upper() if done else "SKIP")
    return {k: v for k, v in state.items() if v is not None}, log


@pytest.mark.parametrize("turn", [1024, 5])
def test_dependent_ops_match_brute_force(spark, monkeypatch, turn):
    monkeypatch.setattr(C, "TURN", turn)
    rng = random.Random(7)
    words = ["alphabet", "binocular", "cathedral", "dinosaur", "elephant"]
    base = {n: (f"{rng.choice(words)} {rng.choice(words)}", f" {rng.choice(words)}") for n in range(30)}
    ops = []
    for _ in range(60):
        nid = rng.randrange(32)
        kind = rng.choice(["edit", "edit", "demote", "demote", "demote", "delete"])
        if kind == "edit":
            ops.append({"nid": nid, "op": kind, "field": 0, "find": rng.choice(words),
                        "replace": rng.choice(words)})
        elif kind == "demote":
            ops.append({"nid": nid, "op": kind, "into_nid": rng.randrange(0, 30, 5),
                        "facts": rng.sample(words, 2)})
        else:
            ops.append({"nid": nid, "op": kind})
    want, log = brute_force(base, ops)
    notes = C.with_sort_fields(spark.createDataFrame(
        [("d", n, t, e, *[""] * 5, "", None, None) for n, (t, e) in base.items()], D.NOTES7))
    run = C.apply_changeset(notes, None, ops_df(spark, *ops))
    got = {r.nid: (r.text, r.extra) for r in run.notes.collect()}
    assert got == want
    assert [r.kind for r in run.changelog.orderBy("seq").collect()] == log


@pytest.mark.parametrize("order", ["sorted", "reverse", "shuffled"])
def test_long_chain_of_demotes(spark, monkeypatch, order):
    monkeypatch.setattr(C, "TURN", 300)
    names = list(range(1000))
    if order == "reverse":
        names.reverse()
    elif order == "shuffled":
        random.Random(3).shuffle(names)
    ops = [{"nid": a, "op": "demote", "into_nid": b, "facts": [f"f{a}"]}
           for a, b in zip(names, names[1:])]
    base = {n: (f"note {n}", " e") for n in names}
    want, log = brute_force(base, ops)
    notes = C.with_sort_fields(spark.createDataFrame(
        [("d", n, t, e, *[""] * 5, "", None, None) for n, (t, e) in base.items()], D.NOTES7))
    run = C.apply_changeset(notes, None, ops_df(spark, *ops))
    assert {r.nid: (r.text, r.extra) for r in run.notes.collect()} == want
    assert [r.kind for r in run.changelog.orderBy("seq").collect()] == log


def test_thousands_of_edits_of_one_note(spark):
    ops = [{"nid": 1, "op": "edit", "field": 0, "find": f"<{i}>", "replace": f"<{i + 1}>"}
           for i in range(3000)]
    notes = C.with_sort_fields(spark.createDataFrame(
        [("d", 1, "at <0>", " e", *[""] * 5, "", None, None)], D.NOTES7))
    run = C.apply_changeset(notes, None, ops_df(spark, *ops))
    assert run.notes.first().text == "at <3000>"
    assert run.changelog.where("kind = 'EDIT'").count() == 3000


def test_no_row_is_larger_than_a_turn(spark):
    ops = [{"nid": i, "op": "demote", "into_nid": i // 2 * 2 + 1, "facts": ["f"]} for i in range(400)]
    ops += [{"nid": i % 40, "op": "demote", "into_nid": (i * 7) % 400, "facts": ["g"]}
            for i in range(400)]
    ops = C.clean_ops(ops_df(spark, *ops))
    groups = C.label_groups(ops)
    turns = C.in_turns(ops, groups, 25)
    sizes = turns.groupBy("grp", "turn").agg(F.count("*").alias("n"), F.min("op_seq").alias("lo"),
                                             F.max("op_seq").alias("hi")).collect()
    assert max(r.n for r in sizes) == 25 and sum(r.n for r in sizes) == ops.count()
    by_group = {}
    for r in sorted(sizes, key=lambda r: r.turn):
        assert by_group.get(r.grp, -1) < r.lo
        by_group[r.grp] = r.hi
    uses = C.uses_of(turns, groups)
    assert uses.groupBy("grp", "turn").count().agg(F.max("count")).first()[0] <= 50


def test_no_ops_change_nothing(spark):
    notes = notes_df(spark)
    run = C.apply_changeset(notes, None, ops_df(spark, *FIVE).where(F.lit(False)))
    assert run.notes.exceptAll(notes).count() == 0 and notes.exceptAll(run.notes).count() == 0

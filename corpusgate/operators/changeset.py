"""Applying a reviewed change-set to a notes table.

Ops that share no note with another op are applied by joins. Ops that touch a common note
depend on each other's result; they are grouped by connected notes and taken in turns of TURN
ops a group. In a turn, a group is one small sorted array of ops folded over a map of the notes
it names; notes that a later turn names wait in a table by that turn. All groups take their
turns together, so there are as many turns as the largest group has ops, divided by TURN, and
no row, whatever the group, is larger than a turn. Both ways decide and change by the same
column expressions. Many demotes into one otherwise untouched note are no such group: they
only append, so they stay on the join path unless one of them needs an earlier one's text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.functions.base import bind, strip, text
from corpusgate.functions.text import checksum32, normalize_extra, sort_field
from corpusgate.functions import values as V
from corpusgate.operators import rules as R
from corpusgate.operators.notes import TAIL
from corpusgate.operators.order import assign_ids, numbered_by
from corpusgate.operators.relate import dedupe_inserts, gate_counts, missing_terms
from corpusgate.session import materialize, scratch_path

TURN = 1 << 10     # ops of a group that are folded in one row
FIELDS = list(V.NOTE_FIELDS)
KINDS = ("edit", "rewrite", "split", "demote", "delete")
RETIRED = ("SPLIT", "DEMOTE", "DELETE")
Get = Callable[[str], Column]      # a field of an op or of a note, by name


@dataclass
class Applied:
    notes: DataFrame
    cards: DataFrame | None
    changelog: DataFrame
    touched: DataFrame


def clean_ops(ops: DataFrame) -> DataFrame:
    """Defaults filled in: op edit, field 1, facts from the single-fact form."""
    one = F.when(F.col("fact").isNotNull(), F.array("fact"))
    facts = F.filter(F.transform(F.coalesce(
        F.when(F.size("facts") > 0, F.col("facts")), one, F.array().cast("array<string>")),
        lambda f: strip(text(f))), lambda f: f != "")
    return ops.select(
        "op_seq", "nid", F.coalesce("op", F.lit("edit")).alias("op"),
        F.coalesce("field", F.lit(1)).alias("field"), text("find").alias("find"),
        text("replace").alias("replace"), "text", "extra", "into", "into_nid",
        facts.alias("facts"), text("why").alias("why"),
        F.coalesce("drop_tail", F.lit(False)).alias("drop_tail"),
        F.coalesce("drop_media", F.lit(False)).alias("drop_media"))


def with_sort_fields(notes: DataFrame) -> DataFrame:
    """Recomputes the sort field and checksum that every write must refresh."""
    return (notes.withColumn("sfld", sort_field("text"))
            .withColumn("csum", checksum32("text")))


# ---- single kinds (C1..C5) --------------------------------------------------------------------

def _with_target(ops: DataFrame, notes: DataFrame) -> DataFrame:
    """Ops with the current fields of their note (s_*) and, for demotes, target (d_*)."""
    src = notes.select(F.col("nid").alias("s_nid"), *[F.col(c).alias(f"s_{c}") for c in FIELDS])
    dst = notes.select(F.col("nid").alias("d_nid"), F.col("text").alias("d_text"),
                       F.col("extra").alias("d_extra"))
    return (ops.join(src, ops["nid"] == F.col("s_nid"), "left")
            .join(dst, F.when(F.col("op") == "demote", F.col("into_nid")) == F.col("d_nid"), "left"))


def _current(op: Get, source: Get) -> Column:
    """The field an edit looks at."""
    out = F.lit(None).cast("string")
    for i, c in enumerate(FIELDS):
        out = F.when(op("field") == i, text(source(c))).otherwise(out)
    return out


def _lost(op: Get, source: Get, target: Get) -> Column:
    """Terms that a demote would lose; none for other ops and missing notes."""
    body = F.concat_ws(" ", text(source("text")), text(source("extra")))
    kept = F.concat_ws(" ", F.array_join(op("facts"), " "), text(target("extra")),
                       text(target("text")))
    both = (op("op") == "demote") & source("nid").isNotNull() & target("nid").isNotNull()
    return F.when(both, missing_terms(body, kept)).otherwise(F.array().cast("array<string>"))


def _skip_reason(op: Get, source: Get, target: Get, lost: Column) -> Column:
    """Why an op is not applied; null if it is."""
    kind = op("op")
    more = F.when(F.size(lost) > 12, F.concat(
        F.lit(" and "), F.size(lost) - 12, F.lit(" others"))).otherwise("")
    refused = F.concat(F.lit("refused, these terms are nowhere in the target: "),
                       F.array_join(F.slice(lost, 1, 12), ", "), more)
    return (
        F.when(source("nid").isNull(), "no such note")
        .when((kind == "edit") & ~F.coalesce(
            _current(op, source).contains(op("find")), F.lit(False)),
              F.concat(F.lit("the field does not hold: "), F.substring(op("find"), 1, 40)))
        .when((kind == "split") & (_n_parts(op) < 2), "a split of fewer than two parts")
        .when((kind == "demote") & target("nid").isNull(), F.concat(
            F.lit("no such target: "), F.coalesce(op("into_nid").cast("string"), F.lit("null"))))
        .when((kind == "demote") & (F.size(op("facts")) == 0), "a demote that keeps no fact")
        .when((kind == "demote") & (F.size(lost) > 0), refused)
        .when(~kind.isin(*KINDS), F.concat(F.lit("not an op: "), kind)))


def _n_parts(op: Get) -> Column:
    return F.coalesce(F.size(op("into")), F.lit(0))


def _done_reason(op: Get) -> Column:
    kind = op("op")
    return (
        F.when(kind == "split", F.concat(op("why"), F.lit(V.SPLIT_MARK[0]), _n_parts(op),
                                         F.lit(V.SPLIT_MARK[1])))
        .when(kind == "demote", F.concat(op("why"), F.lit(" | kept in "), op("into_nid"),
                                         F.lit(", facts: "), F.size(op("facts"))))
        .otherwise(op("why")))


def outcomes(ops: DataFrame, notes: DataFrame) -> DataFrame:
    """Ops with `kind` (applied kind or SKIP), `reason` and `lost`, each op on its own."""
    def source(c):
        return F.col(f"s_{c}")

    def target(c):
        return F.col(f"d_{c}")

    found = _with_target(ops, notes).withColumn("lost", _lost(F.col, source, target))
    return (found.withColumn("_skip", _skip_reason(F.col, source, target, F.col("lost")))
            .withColumn("kind", F.when(F.col("_skip").isNotNull(), "SKIP").otherwise(F.upper("op")))
            .withColumn("reason", F.coalesce("_skip", _done_reason(F.col))).drop("_skip"))


def touched_notes(notes: DataFrame, ops: DataFrame) -> DataFrame:
    """The notes that ops name, as source or target: all that the ops can depend on."""
    ids = ops.select("nid").unionByName(
        ops.where("op = 'demote'").select(F.col("into_nid").alias("nid"))).distinct()
    return materialize(notes.select("nid", *FIELDS).join(ids, "nid", "left_semi"), "near")


def _edited(op: Get, note: Get) -> list[Column]:
    """The fields of a note after an edit or a rewrite."""
    out = []
    for i, c in enumerate(FIELDS):
        hit = (op("op") == "edit") & (op("field") == i)
        value = F.when(hit, F.replace(text(note(c)), op("find"), op("replace")))
        if c in ("text", "extra"):
            value = value.when(op("op") == "rewrite", text(op(c)))
        value = value.otherwise(text(note(c)))
        out.append((normalize_extra(value) if c == "extra" else value).alias(c))
    return out


def _appended(extra: Column, passages: Column) -> Column:
    """The extra field with passages put behind it."""
    return normalize_extra(F.concat(F.regexp_replace(text(extra), r"\s+$", ""), passages))


def _passages(facts: Column) -> Column:
    return F.concat(F.lit("<br><br>"), F.array_join(facts, "<br><br>"))


def _changed_fields(done: DataFrame) -> DataFrame:
    """(nid, gone, fields): new field values of edited and rewritten notes."""
    rows = done.where(F.col("kind").isin("EDIT", "REWRITE"))
    return rows.select("nid", F.lit(False).alias("gone"),
                       *_edited(F.col, lambda c: F.col(f"s_{c}")))


def _new_parts(done: DataFrame) -> DataFrame:
    """(op_seq, part, fields): notes made by splits; the first one inherits the tail."""
    parts = (done.where("kind = 'SPLIT'")
             .select("op_seq", *[text(f"s_{c}").alias(f"t_{c}") for c in TAIL],
                     F.posexplode("into").alias("part", "p")))
    tail = [F.when(F.col("part") == 0, F.col(f"t_{c}")).otherwise("").alias(c) for c in TAIL]
    return parts.select("op_seq", "part", text("p.text").alias("text"),
                        normalize_extra("p.extra").alias("extra"), *tail)


def _grown_targets(done: DataFrame, near: DataFrame) -> DataFrame:
    """(nid, gone, fields): demote targets with the facts appended in op order.

    The list per target holds what the target's one output cell will hold, no more.
    """
    folded = done.where("kind = 'DEMOTE'").groupBy(F.col("into_nid").alias("nid")).agg(
        F.sort_array(F.collect_list(F.struct("op_seq", _passages(F.col("facts")).alias("f"))))
        .alias("_f"))
    grown = _appended(F.col("extra"), F.array_join(F.transform("_f", lambda x: x["f"]), ""))
    return near.join(folded, "nid").select(
        "nid", F.lit(False).alias("gone"),
        *[(grown if c == "extra" else F.col(c)).alias(c) for c in FIELDS])


def _changes(done: DataFrame, near: DataFrame) -> DataFrame:
    """(nid, gone, fields): one row per note that independent ops change or retire."""
    gone = done.where(F.col("kind").isin(*RETIRED)).select(
        "nid", F.lit(True).alias("gone"), *[F.lit(None).cast("string").alias(c) for c in FIELDS])
    return (_changed_fields(done).unionByName(gone)
            .unionByName(_grown_targets(done, near)))


def _put(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes with changed rows replaced and retired ones left out: one pass, one join."""
    c = changes.select(F.col("nid").alias("_c"), "gone",
                       *[F.col(f).alias(f"_{f}") for f in FIELDS])
    joined = (notes.join(c, notes["nid"] == F.col("_c"), "left")
              .where(~F.coalesce("gone", F.lit(False))))
    hit = F.col("_c").isNotNull()
    fresh = {f: F.when(hit, F.col(f"_{f}")).otherwise(F.col(f)) for f in FIELDS}
    fresh["sfld"] = F.when(hit, sort_field("_text")).otherwise(F.col("sfld"))
    fresh["csum"] = F.when(hit, checksum32("_text")).otherwise(F.col("csum"))
    return joined.select(*[fresh[n].alias(n) if n in fresh else F.col(n) for n in notes.columns])


def apply_independent(notes: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply ops that do not depend on each other: (notes, new parts, changelog)."""
    near = touched_notes(notes, ops)
    done = materialize(outcomes(ops, near), "done")
    return (_put(notes, _changes(done, near)), _new_parts(done),
            done.select("op_seq", "kind", "nid", "reason"))


# ---- dependent ops (C7) -------------------------------------------------------------------------

def split_dependent(ops: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(independent, dependent): ops that can be joined, and ops that must be folded."""
    demote = F.col("op") == "demote"
    touches = ops.select("nid", F.lit(0).alias("_in")).unionByName(
        ops.where(demote).select(F.col("into_nid").alias("nid"), F.lit(1).alias("_in")))
    counted = touches.groupBy("nid").agg(F.count(F.lit(1)).alias("_n"), F.sum("_in").alias("_t"))
    shared = materialize(counted.where("_n > 1"), "shared")
    if shared.isEmpty():
        return ops, ops.where("false")
    # A note that is only ever a target keeps its demotes independent, unless one of them
    # would be refused without the text of an earlier one.
    hubs = shared.where("_n = _t").select(F.col("nid").alias("_h"))
    rivals = shared.where("_n <> _t").select(F.col("nid").alias("_r"))
    into_hub = ops.where(demote).join(hubs, F.col("into_nid") == F.col("_h"), "left_semi")
    needy = outcomes(into_hub, notes).where(F.size("lost") > 0).select(
        F.col("into_nid").alias("_r"))
    # A source shared with another op drags its whole target group along.
    mixed = (into_hub.join(rivals, F.col("nid") == F.col("_r"), "left_semi")
             .select(F.col("into_nid").alias("_r")))
    bound = materialize(rivals.unionByName(needy).unionByName(mixed).distinct(), "bound")
    by_source = ops.join(bound, F.col("nid") == F.col("_r"), "left_semi").select("op_seq")
    by_target = ops.where(demote).join(bound, F.col("into_nid") == F.col("_r"),
                                       "left_semi").select("op_seq")
    tied = by_source.unionByName(by_target).distinct()
    return ops.join(tied, "op_seq", "left_anti"), ops.join(tied, "op_seq", "left_semi")


def _stars(edges: DataFrame) -> DataFrame:
    """One round of large and small stars over edges (a, b) with a > b.

    Every neighbour above a note is hooked to the smallest neighbour of that note, then
    every note and its smaller neighbours to the smallest of them.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    large = (both.join(least, "a").where("b > a")
             .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    lower = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether no note hangs on two others or on one that hangs itself."""
    torn = edges.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("c")).where("b < c")
    deep = edges.select(F.col("b").alias("a")).join(edges, "a", "left_semi")
    return torn.select("a").unionByName(deep).isEmpty()


def label_groups(ops: DataFrame) -> DataFrame:
    """(nid, grp): connected notes of demote pairs, named by their smallest note.

    Rounds grow with the logarithm of the longest chain of demotes, in whatever order the
    chain is stored.
    """
    pairs = ops.where("op = 'demote' AND nid <> into_nid")
    edges = materialize(pairs.select(F.greatest("nid", "into_nid").alias("a"),
                                     F.least("nid", "into_nid").alias("b")).distinct(), "edges")
    while not _settled(edges):
        edges = materialize(_stars(edges), "edges")
    nodes = ops.select("nid").unionByName(pairs.select(F.col("into_nid").alias("nid"))).distinct()
    heads = edges.select(F.col("a").alias("nid"), F.col("b").alias("_head"))
    return nodes.join(heads, "nid", "left").select(
        "nid", F.coalesce("_head", "nid").alias("grp"))


OP_FIELDS = ("op_seq", "nid", "op", "field", "find", "replace", "text", "extra", "into",
             "into_nid", "facts", "why")
_LOG = ("array<struct<op_seq:bigint,kind:string,nid:bigint,reason:string,"
        "into:array<struct<text:string,extra:string>>,%s>>"
        % ",".join(f"s_{c}:string" for c in TAIL))
_NOTE = "struct<nid:bigint,changed:boolean,%s>" % ",".join(f"{c}:string" for c in FIELDS)


def _after_op(acc: Column, op: Column) -> Column:
    """(notes, log) after one more op; a retired note keeps its key with no value."""
    def next_note(key: Column, note: Column, kind: Column) -> Column:
        own, goal = key == op["nid"], (key == op["into_nid"]) & (kind == "DEMOTE")
        grown = [(_appended(note[c], _passages(op["facts"])) if c == "extra" else note[c]).alias(c)
                 for c in FIELDS]
        changed = F.lit(True).alias("changed")
        return (F.when(own & kind.isin(*RETIRED), F.lit(None))
                .when(own, F.struct(note["nid"], changed, *_edited(
                    op.getField, note.getField)).cast(_NOTE))
                .when(goal, F.struct(note["nid"], changed, *grown).cast(_NOTE))
                .otherwise(note))

    def close(pair: Column, skip: Column) -> Column:
        kind = F.when(skip.isNotNull(), "SKIP").otherwise(F.upper(op["op"]))
        split = kind == "SPLIT"
        entry = F.array(F.struct(
            op["op_seq"], kind, op["nid"], F.coalesce(skip, _done_reason(op.getField)),
            F.when(split, op["into"]), *[F.when(split, pair["source"][c]) for c in TAIL]))
        return F.struct(
            F.when(skip.isNotNull(), acc["notes"]).otherwise(F.transform_values(
                acc["notes"], lambda k, n: next_note(k, n, kind))).alias("notes"),
            F.concat(acc["log"], entry.cast(_LOG)).alias("log"))

    def judge(pair: Column) -> Column:
        source, target = pair["source"].getField, pair["target"].getField
        return bind(_lost(op.getField, source, target), lambda lost: bind(
            _skip_reason(op.getField, source, target, lost), lambda skip: close(pair, skip)))

    goal = F.when(op["op"] == "demote", op["into_nid"])
    return bind(F.struct(F.try_element_at(acc["notes"], op["nid"]).alias("source"),
                         F.try_element_at(acc["notes"], goal).alias("target")), judge)


def in_turns(ops: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """`ops` with their group and turn: `turn` ops of a group, in op order, are one turn."""
    own = materialize(ops.select("op_seq", "nid").join(groups, "nid").select("op_seq", "grp"), "own")
    ranked = numbered_by(own, ["grp", "op_seq"], "_place")
    first = ranked.groupBy("grp").agg(F.min("_place").alias("_first"))
    placed = ranked.join(first, "grp").select("op_seq", "grp", F.floor(
        (F.col("_place") - F.col("_first")) / F.lit(turn)).cast("int").alias("turn"))
    return materialize(ops.select(*OP_FIELDS).join(placed, "op_seq"), "turns")


def uses_of(ops: DataFrame, groups: DataFrame) -> DataFrame:
    """(nid, grp, turn, next, first): the turns that name a note, and the one after each."""
    named = ops.select("nid", "grp", "turn").unionByName(
        ops.where("op = 'demote'").select(F.col("into_nid").alias("nid"), "grp", "turn"))
    by_note = Window.partitionBy("nid").orderBy("turn")
    return materialize(named.distinct().select(
        "nid", "grp", "turn", F.lead("turn").over(by_note).alias("next"),
        (F.row_number().over(by_note) == 1).alias("first")), "uses")


def _fold_turn(states: DataFrame, ops: DataFrame) -> DataFrame:
    """(notes, log) of every group after one turn; a group is one row of at most TURN ops."""
    queues = ops.groupBy("grp").agg(
        F.sort_array(F.collect_list(F.struct(*OP_FIELDS))).alias("ops"))
    held = F.struct("nid", "changed", *[text(c).alias(c) for c in FIELDS])
    maps = states.groupBy("grp").agg(F.map_from_entries(F.collect_list(
        F.struct("nid", held.cast(_NOTE)))).alias("notes"))
    none = F.create_map().cast(f"map<bigint,{_NOTE}>")
    start = F.struct(F.coalesce("notes", none).alias("notes"), F.array().cast(_LOG).alias("log"))
    return queues.join(maps, "grp", "left").select(
        F.aggregate("ops", start, _after_op).alias("end")).select("end.*")


def fold_dependent(notes: DataFrame, ops: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(changes, done) of ops that share notes, in op order.

    Every turn reads its own ops and the notes they name, from `notes` if no earlier turn
    named them, else from what the turn before left for this one.
    """
    spark = ops.sparkSession
    groups = materialize(label_groups(ops), "groups")
    ops = in_turns(ops, groups, turn)
    uses = uses_of(ops, groups)
    turns = ops.agg(F.coalesce(F.max("turn"), F.lit(-1)) + 1).first()[0]
    folded, waiting = scratch_path(spark, "folded"), scratch_path(spark, "waiting")
    state = ["nid", "grp", "changed", *FIELDS]
    kept = ", ".join(f"{c} STRING" for c in FIELDS)
    for i in range(max(turns, 1)):
        now = uses.where(F.col("turn") == i)
        states = notes.join(now.where("first"), "nid").withColumn(
            "changed", F.lit(False)).select(*state)
        if i:
            states = states.unionByName(
                spark.read.schema(f"nid BIGINT, grp BIGINT, changed BOOLEAN, {kept}, next INT")
                .parquet(waiting).where(F.col("next") == i).select(*state))
        _fold_turn(states, ops.where(F.col("turn") == i)).withColumn("turn", F.lit(i)).write.mode(
            "append").partitionBy("turn").parquet(folded)
        if turns > 1:
            left = spark.read.parquet(f"{folded}/turn={i}")
            ended = left.select(F.explode("notes").alias("nid", "n")).where("n IS NOT NULL")
            ended.join(now.select("nid", "grp", "next"), "nid").select(
                "nid", "grp", "n.changed", *[f"n.{c}" for c in FIELDS],
                F.coalesce("next", F.lit(-1)).alias("next")).where("next > 0").write.mode(
                "append").partitionBy("next").parquet(waiting)
    out = spark.read.parquet(folded)
    ended = out.select("turn", F.explode("notes").alias("nid", "n")).join(
        uses.select("nid", "turn", "next"), ["nid", "turn"])
    # A retired note is gone for good; another one is final after the last turn that names it.
    changes = ended.where("n IS NULL OR (next IS NULL AND n.changed)").select(
        "nid", F.col("n").isNull().alias("gone"), *[F.col(f"n.{c}").alias(c) for c in FIELDS])
    return changes, out.select(F.inline("log"))


def apply_changeset(notes: DataFrame, cards: DataFrame | None, ops: DataFrame,
                    new: DataFrame | None = None, now_ms: int = 0, deck_id: int = 0,
                    deck: str | None = None) -> Applied:
    """Notes and cards after a change-set, with its changelog.

    `notes` holds the D2/D6 columns plus sfld and csum, `new` (seq, text, extra). Ops work
    in op order and see earlier effects; inserts follow all ops.
    """
    ops = materialize(clean_ops(ops), "ops")
    near = touched_notes(notes, ops)
    free, tied = split_dependent(ops, near)
    done = materialize(outcomes(free, near), "done")
    changes, parts = _changes(done, near), _new_parts(done)
    log = done.select("op_seq", "kind", "nid", "reason")
    tied = materialize(tied, "tied")
    if not tied.isEmpty():
        folded, in_turn = fold_dependent(near, tied, TURN)
        changes = changes.unionByName(folded)
        parts = parts.unionByName(_new_parts(in_turn))
        log = log.unionByName(in_turn.select("op_seq", "kind", "nid", "reason"))
    after = _put(notes, changes)
    parts, log = parts.withColumn("phase", F.lit(0)), log.withColumn("phase", F.lit(0))
    if new is not None:
        live = after.select("text").unionByName(parts.select("text"))
        checked = materialize(dedupe_inserts(new.select("seq", "text", "extra"), live), "inserts")
        last = ops.agg(F.coalesce(F.max("op_seq"), F.lit(0)).alias("m")).scalar()
        added = checked.where("kind = 'ADD'").select(
            (last + 1 + F.col("seq")).cast("bigint").alias("op_seq"), F.lit(0).alias("part"),
            "text", normalize_extra("extra").alias("extra"),
            *[F.lit("").alias(c) for c in TAIL], F.lit(1).alias("phase"))
        parts = parts.unionByName(added)
        log = log.unionByName(checked.select(
            (last + 1 + F.col("seq")).cast("bigint").alias("op_seq"), "kind",
            F.lit(None).cast("bigint").alias("nid"), F.substring("text", 1, 70).alias("reason"),
            F.lit(1).alias("phase")))
    made = materialize(assign_ids(parts, notes, now_ms), "made")
    fresh = made.select("nid", *FIELDS).withColumn("sfld", sort_field("text")).withColumn(
        "csum", checksum32("text"))
    fill = [F.col(c) if c in fresh.columns else
            (F.lit(deck) if c == "deck" else F.lit("") if c == "tags" else F.lit(None)).cast(
                notes.schema[c].dataType).alias(c) for c in notes.columns]
    after = after.unionByName(fresh.select(*fill))
    cards_after = None if cards is None else _cards_after(cards, log, made, now_ms, deck_id)
    ids = made.where("phase = 0").groupBy("op_seq").agg(
        F.sort_array(F.collect_list("nid")).alias("_ids"))
    named = F.concat("reason", F.when(F.col("_ids").isNotNull(), F.concat(
        F.lit(" ["), F.array_join(F.transform("_ids", lambda n: n.cast("string")), ", "),
        F.lit("]"))).otherwise(""))
    changelog = log.join(ids, "op_seq", "left").select(
        F.col("op_seq").alias("seq"), "kind", "nid", named.alias("reason"))
    touched = ops.select("nid").unionByName(made.select("nid")).distinct()
    return Applied(after, cards_after, changelog, touched)


def _cards_after(cards: DataFrame, log: DataFrame, made: DataFrame, now_ms: int,
                 deck_id: int) -> DataFrame:
    """Cards of retired notes go, every new note gets one."""
    gone = log.where(F.col("kind").isin(*RETIRED)).select("nid").distinct()
    kept = cards.join(gone, "nid", "left_anti")
    fresh = assign_ids(made.select("op_seq", "part", F.col("nid").alias("_nid")), cards, now_ms,
                       key="id")
    known = {"id": F.col("id"), "nid": F.col("_nid"), "did": F.lit(deck_id), "due": F.col("_nid"),
             "usn": F.lit(-1), "data": F.lit("")}
    fill = [known.get(f.name, F.lit(None if f.dataType.simpleString() == "string" else 0))
            .cast(f.dataType).alias(f.name) for f in cards.schema]
    return kept.select(*cards.columns).unionByName(fresh.select(*fill))


# ---- gates (C10, C11) ------------------------------------------------------------------------------

def attribution_gate(notes: DataFrame, touched: DataFrame, brand: str | None = None) -> DataFrame:
    """(nid, field, hit, severity): a gate on touched notes, a warning elsewhere."""
    mark = touched.select(F.col("nid").alias("_t")).distinct()
    hits = R.attribution_hits(notes, brand)
    return (hits.join(mark, hits["nid"] == F.col("_t"), "left")
            .select("nid", "field", "hit", F.when(F.col("_t").isNotNull(), "gate")
                    .otherwise("warn").alias("severity")))


def drifted(notes: DataFrame) -> DataFrame:
    """Notes whose stored sort field or checksum is not what the front gives."""
    return notes.where((strip(text("sfld")) != sort_field("text"))
                       | ~F.col("csum").eqNullSafe(checksum32("text")))


def drift_gate(notes: DataFrame) -> DataFrame:
    return gate_counts([("sort field or checksum drift", drifted(notes))])


def op_kinds(changelog: DataFrame) -> DataFrame:
    """(nid, kind): the last applied change of each note."""
    rows = changelog.where(F.col("kind").isin(*V.APPLIED_KINDS))
    return rows.groupBy("nid").agg(F.max_by("kind", "seq").alias("kind"))

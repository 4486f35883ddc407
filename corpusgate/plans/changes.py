"""Queries over change-sets, gates and changelogs. Ops are derived from `labels`."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusgate import schemas as D
from corpusgate.functions.base import WS
from corpusgate.operators import changeset as C
from corpusgate.operators import order as O
from corpusgate.operators import relate as J
from corpusgate.operators import report as P
from corpusgate.plans.base import NOTES, doc_notes, lit, query, sql_sort_field, sql_strip, table
from corpusgate.plans.checks import _ATTRIBUTED, _SPOKEN, spoken_notes
from corpusgate.session import scratch_path
from corpusgate.sources import sinks

NOW = 10_000_000


def full_notes(spark, d, keep=None):
    """Document notes with all D2/D6 columns; the tail is filled on every fifth note."""
    notes = doc_notes(spark, d)
    fifth = F.pmod("nid", F.lit(5)) == 0
    notes = notes.select(
        "deck", "nid", "text", "extra",
        F.when(fifth, F.concat(F.lit("own "), "nid")).otherwise("").alias("personal"),
        F.lit("").alias("custom"), F.lit("").alias("missed"),
        F.when(fifth, F.col("lang")).otherwise("").alias("textbook"),
        F.lit("").alias("resources"), F.lit("t").alias("tags"))
    return C.with_sort_fields(notes if keep is None else notes.where(keep))


def make_ops(rows, **columns):
    """Op rows with every column of the op schema; missing ones are null."""
    fields = {part.split(" ", 1)[0]: part.split(" ", 1)[1] for part in _split_ddl(D.OPS)}
    return rows.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()])


def _split_ddl(ddl):
    out, depth, part = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return out + [part.strip()]


def _shown(notes):
    return notes.select("nid", F.md5("text").alias("text"), F.md5("extra").alias("extra"),
                        "personal", "csum")


_NORM = (f"CASE WHEN {sql_strip('{e}')} = '' THEN {{e}} ELSE ' ' || "
         f"regexp_replace({{e}}, {lit('^' + WS + '+')}, '') END")


def _norm(expr):
    return _NORM.replace("{e}", expr)


_FULL = NOTES + """, fulln AS (SELECT nid, text, extra,
  CASE WHEN nid % 5 = 0 THEN 'own ' || nid ELSE '' END AS personal FROM notes)"""


def _final(select: str, with_: str = "") -> str:
    return (f"WITH {_FULL}{with_}, after AS ({select}) SELECT nid, md5(text) AS text, "
            f"md5(extra) AS extra, personal, ('0x' || substr(sha1({sql_sort_field('text')}), 1, 8))"
            f"::BIGINT AS csum FROM after")


@query("apply_edit", _final(f"""SELECT nid, CASE WHEN hit THEN replace(text, 'the', 'THE') ELSE text END
    AS text, CASE WHEN hit THEN {_norm('extra')} ELSE extra END AS extra, personal
  FROM (SELECT *, contains(text, 'the') AND nid IN (SELECT doc_id FROM labels) AS hit FROM fulln)"""))
def apply_edit(spark, d):
    labels = table(spark, d, "labels")
    ops = make_ops(labels, op_seq=F.col("doc_id"), nid=F.col("doc_id"), op=F.lit("edit"),
                   field=F.lit(0), find=F.lit("the"), replace=F.lit("THE"))
    return _shown(C.apply_changeset(full_notes(spark, d), None, ops).notes)


@query("apply_rewrite", _final("""SELECT nid, coalesce('r ' || doc_id, text) AS text,
  CASE WHEN doc_id IS NULL THEN extra ELSE ' q ' || quality END AS extra, personal
  FROM fulln LEFT JOIN labels ON doc_id = nid"""), bench=True)
def apply_rewrite(spark, d):
    labels = table(spark, d, "labels")
    ops = make_ops(labels, op_seq=F.col("doc_id"), nid=F.col("doc_id"), op=F.lit("rewrite"),
                   text=F.concat(F.lit("r "), "doc_id"), extra=F.concat(F.lit("q "), "quality"))
    return _shown(C.apply_changeset(full_notes(spark, d), None, ops).notes)


def split_ops(spark, d):
    labels = table(spark, d, "labels").where("quality = 0")
    part = [F.struct(F.concat(F.lit(f"{x} "), "doc_id").alias("text"), F.lit(e).alias("extra"))
            for x, e in (("a", "x"), ("b", ""))]
    return make_ops(labels, op_seq=F.col("doc_id"), nid=F.col("doc_id"), op=F.lit("split"),
                    into=F.when(F.col("toxic") == 1, F.array(part[0])).otherwise(F.array(*part)),
                    why=F.lit("multi"))


_SPLIT_ROWS = f""", hits AS (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0),
  made AS (SELECT {NOW} + row_number() OVER (ORDER BY doc_id, part) - 1 AS nid, x || ' ' || doc_id
      AS text, e AS extra, CASE WHEN part = 0 AND doc_id % 5 = 0 THEN 'own ' || doc_id ELSE '' END
      AS personal FROM hits, (VALUES (0, 'a', ' x'), (1, 'b', '')) AS v(part, x, e))"""


@query("apply_split", _final("""SELECT nid, text, extra, personal FROM fulln
  WHERE nid NOT IN (SELECT doc_id FROM hits) UNION ALL SELECT nid, text, extra, personal FROM made""",
                             _SPLIT_ROWS), bench=True)
def apply_split(spark, d):
    return _shown(C.apply_changeset(full_notes(spark, d), None, split_ops(spark, d),
                                    now_ms=NOW).notes)


_DEMOTED = f""", hits AS (SELECT doc_id, doc_id - doc_id % 10 AS into_nid FROM labels
    WHERE doc_id % 10 <> 0),
  facts AS (SELECT into_nid, string_agg('<br><br>' || {sql_strip("text || ' ' || extra")}, ''
      ORDER BY doc_id) AS f FROM hits JOIN notes ON nid = doc_id GROUP BY into_nid)"""


@query("apply_demote", _final(f"""SELECT nid, text, CASE WHEN f IS NULL THEN extra ELSE {_norm(
  "(regexp_replace(extra, '[ " + chr(92) + "t" + chr(92) + "n" + chr(92) + "r]+$', '') || f)")} END
  AS extra, personal FROM fulln LEFT JOIN facts ON nid = into_nid
  WHERE nid NOT IN (SELECT doc_id FROM hits)""", _DEMOTED))
def apply_demote(spark, d):
    labels = table(spark, d, "labels").where(F.pmod("doc_id", F.lit(10)) != 0)
    docs = doc_notes(spark, d).select(F.col("nid").alias("doc_id"), F.concat_ws(
        " ", "text", "extra").alias("body"))
    ops = make_ops(labels.join(docs, "doc_id"), op_seq=F.col("doc_id"), nid=F.col("doc_id"),
                   op=F.lit("demote"), into_nid=F.col("doc_id") - F.pmod("doc_id", F.lit(10)),
                   facts=F.array("body"))
    return _shown(C.apply_changeset(full_notes(spark, d), None, ops).notes)


@query("apply_delete", _final("""SELECT nid, text, extra, personal FROM fulln
  WHERE nid NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"""))
def apply_delete(spark, d):
    labels = table(spark, d, "labels").where("toxic = 1")
    ops = make_ops(labels, op_seq=F.col("doc_id"), nid=F.col("doc_id"), op=F.lit("delete"))
    return _shown(C.apply_changeset(full_notes(spark, d), None, ops).notes)


@query("apply_inserts", _final(f"""SELECT nid, text, extra, personal FROM fulln WHERE nid % 3 = 0
  UNION ALL SELECT {NOW} + row_number() OVER (ORDER BY doc_id) - 1, t, ' new', '' FROM (
    SELECT doc_id, t, row_number() OVER (PARTITION BY lower({sql_strip('t')}) ORDER BY doc_id) AS r
    FROM (SELECT nid AS doc_id, text AS t FROM notes WHERE nid % 3 <> 0))
  WHERE r = 1 AND lower({sql_strip('t')}) NOT IN (
    SELECT lower({sql_strip('text')}) FROM fulln WHERE nid % 3 = 0)"""))
def apply_inserts(spark, d):
    third = F.pmod("nid", F.lit(3))
    new = doc_notes(spark, d).where(third != 0).select(
        F.col("nid").alias("seq"), "text", F.lit("new").alias("extra"))
    none = make_ops(table(spark, d, "labels").where(F.lit(False)))
    return _shown(C.apply_changeset(full_notes(spark, d, third == 0), None, none, new,
                                    now_ms=NOW).notes)


@query("apply_dependent_ops", _final("""SELECT nid, CASE WHEN doc_id IS NULL THEN text
    ELSE 'alpha gamma ' || doc_id END AS text, CASE WHEN doc_id IS NULL THEN extra ELSE ' e' END AS extra,
    personal FROM fulln LEFT JOIN labels ON doc_id = nid"""), bench=True)
def apply_dependent_ops(spark, d):
    labels = table(spark, d, "labels")
    first = make_ops(labels, op_seq=F.col("doc_id") * 2, nid=F.col("doc_id"), op=F.lit("rewrite"),
                     text=F.concat(F.lit("alpha beta "), "doc_id"), extra=F.lit("e"))
    then = make_ops(labels, op_seq=F.col("doc_id") * 2 + 1, nid=F.col("doc_id"), op=F.lit("edit"),
                    field=F.lit(0), find=F.lit("beta"), replace=F.lit("gamma"))
    return _shown(C.apply_changeset(full_notes(spark, d), None, first.unionByName(then)).notes)


@query("apply_demote_chain", _final("""SELECT n.nid, CASE WHEN c.doc_id IS NULL THEN n.text
    ELSE 'tiny ' || c.doc_id END AS text, CASE WHEN c.doc_id IS NULL THEN n.extra
    WHEN c.before IS NULL OR c.before % 97 = 0 THEN ' e'
    ELSE ' e<br><br>f ' || c.before END AS extra, n.personal
  FROM fulln n LEFT JOIN c ON c.doc_id = n.nid
  WHERE c.doc_id IS NULL OR c.after IS NULL OR c.doc_id % 97 = 0""", """, c AS (SELECT doc_id,
  lag(doc_id) OVER w AS before, lead(doc_id) OVER w AS after FROM labels
  WINDOW w AS (PARTITION BY doc_id // 2000 ORDER BY doc_id))"""))
def apply_demote_chain(spark, d):
    """Every labelled note is folded into the next of its 2,000 ids, in op order; a demote
    without facts is refused, and the chain goes on behind it."""
    chain = Window.partitionBy(F.floor(F.col("doc_id") / 2000)).orderBy("doc_id")
    labels = table(spark, d, "labels").withColumn("into_id", F.lead("doc_id").over(chain))
    late = labels.agg(F.max("doc_id") + 1).scalar()
    first = make_ops(labels, op_seq=F.col("doc_id"), nid=F.col("doc_id"), op=F.lit("rewrite"),
                     text=F.concat(F.lit("tiny "), "doc_id"), extra=F.lit("e"))
    then = make_ops(labels.where("into_id IS NOT NULL"), op_seq=late + F.col("doc_id"),
                    nid=F.col("doc_id"), op=F.lit("demote"), into_nid=F.col("into_id"),
                    facts=F.when(F.col("doc_id") % 97 != 0,
                                 F.array(F.concat(F.lit("f "), "doc_id"))))
    return _shown(C.apply_changeset(full_notes(spark, d), None, first.unionByName(then)).notes)


# ---- reports over one change-set -------------------------------------------------------------------

def mixed_run(spark, d):
    """Splits, deletes, rewrites of unknown notes and inserts in one change-set."""
    labels = table(spark, d, "labels")
    good = labels.where("quality = 1")
    gone = make_ops(good.where("toxic = 1"), op_seq=F.col("doc_id"), nid=F.col("doc_id"),
                    op=F.lit("delete"), why=F.lit("toxic"))
    lost = make_ops(good.where("toxic = 0"), op_seq=F.col("doc_id"), nid=-F.col("doc_id") - 1,
                    op=F.lit("rewrite"), text=F.lit("x"), extra=F.lit("y"))
    ops = split_ops(spark, d).unionByName(gone).unionByName(lost)
    new = table(spark, d, "benchmark").select(
        F.col("item_id").alias("seq"), "text", F.lit("").alias("extra"))
    notes = full_notes(spark, d)
    return notes, ops, C.apply_changeset(notes, None, ops, new, now_ms=NOW)


_BENCH_KEY = "lower(" + sql_strip("regexp_replace(text, '<[^>]+>', '', 'g')") + ")"
_RUN = f"""{NOTES}, ops AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'split' WHEN toxic = 1 THEN
    'delete' ELSE 'rewrite' END AS op, toxic FROM labels),
live AS (SELECT {_BENCH_KEY} AS k FROM notes WHERE nid NOT IN (
    SELECT doc_id FROM ops WHERE op = 'delete' OR (op = 'split' AND toxic = 0))
    UNION ALL SELECT x || ' ' || doc_id FROM ops, (VALUES ('a'), ('b')) v(x)
    WHERE op = 'split' AND toxic = 0),
ins AS (SELECT item_id, text, row_number() OVER (PARTITION BY {_BENCH_KEY} ORDER BY item_id) = 1
    AND {_BENCH_KEY} NOT IN (SELECT k FROM live) AS ok FROM benchmark),
log AS (SELECT doc_id AS seq, CASE WHEN op = 'split' AND toxic = 0 THEN 'SPLIT'
      WHEN op = 'delete' THEN 'DELETE' ELSE 'SKIP' END AS kind,
      CASE WHEN op = 'rewrite' THEN -doc_id - 1 ELSE doc_id END AS nid FROM ops
    UNION ALL SELECT (SELECT max(doc_id) FROM ops) + 1 + item_id,
      CASE WHEN ok THEN 'ADD' ELSE 'DUPE-SKIP' END, NULL FROM ins)"""


@query("changelog_entries", f"WITH {_RUN} SELECT seq, kind, nid FROM log")
def changelog_entries(spark, d):
    return mixed_run(spark, d)[2].changelog.select("seq", "kind", "nid")


@query("op_counts", f"""WITH {_RUN} SELECT kind, count(*)::BIGINT AS n,
  CASE WHEN kind = 'SPLIT' THEN 2 * count(*) ELSE 0 END::BIGINT AS created FROM log GROUP BY kind""")
def op_counts(spark, d):
    return P.op_counts(mixed_run(spark, d)[2].changelog)


_ACCOUNT = f"""WITH {_RUN}, c AS (SELECT count(*) FILTER (kind = 'ADD')::BIGINT AS added,
  count(*) FILTER (kind = 'SPLIT')::BIGINT AS s, count(*) FILTER (kind = 'DELETE')::BIGINT AS del,
  count(*) FILTER (kind = 'DEMOTE')::BIGINT AS demoted, count(DISTINCT abs(nid)) FILTER (
    kind IN ('SPLIT', 'DELETE'))::BIGINT AS gone FROM log), n AS (SELECT count(*)::BIGINT AS n FROM documents)
SELECT added, 2 * s AS split_children, s AS split_parents, demoted, del AS deleted,
  n AS notes_before, n - gone + added + 2 * s AS notes_after,
  n + added + 2 * s - s - demoted - del AS expected,
  n - gone + added + 2 * s = n + added + 2 * s - s - demoted - del AS pass FROM c, n"""


@query("accounting", _ACCOUNT)
def accounting(spark, d):
    notes, _ops, run = mixed_run(spark, d)
    return P.accounting(run.changelog, notes, run.notes)


@query("ops_applied", f"""WITH {_RUN}
SELECT count(*) FILTER (kind IN ('SPLIT', 'DELETE'))::BIGINT AS applied,
  count(*) FILTER (kind = 'SKIP')::BIGINT AS skipped, (SELECT count(*) FROM ops)::BIGINT AS intended,
  count(*) FILTER (kind IN ('SPLIT', 'DELETE')) = (SELECT count(*) FROM ops) AS pass FROM log""")
def ops_applied(spark, d):
    _notes, ops, run = mixed_run(spark, d)
    return P.ops_applied(run.changelog, ops)


@query("changelog_sections", f"""WITH {_RUN}
SELECT list_position(['DEMOTE','DELETE','SPLIT','REWRITE','EDIT','ADD','DUPE-SKIP','SKIP'], kind)
    ::BIGINT AS section, kind, row_number() OVER (PARTITION BY kind ORDER BY seq)::BIGINT AS place, nid
FROM log""")
def changelog_sections(spark, d):
    return P.changelog_sections(mixed_run(spark, d)[2].changelog).select(
        F.col("section").cast("bigint").alias("section"), "kind", "place", "nid")


@query("review_calls", f"""WITH {_RUN}, r AS (SELECT kind, nid, nid % 4 AS module, row_number() OVER (
    PARTITION BY nid % 4 ORDER BY seq) AS place FROM log WHERE kind IN ('DELETE', 'SPLIT'))
SELECT module, place::BIGINT AS place, nid, kind FROM r WHERE place <= 40""")
def review_calls(spark, d):
    log = mixed_run(spark, d)[2].changelog.withColumn("module", F.pmod("nid", F.lit(4)))
    calls = P.review_calls(log)
    return calls.select("module", F.col("place").cast("bigint").alias("place"),
                        F.split_part("call", F.lit(" "), F.lit(4)).cast("bigint").alias("nid"),
                        F.upper(F.substring_index("call", " ", 1)).alias("kind"))


@query("build_report", f"""WITH {_RUN}, g AS (
  SELECT 'ops applied' AS gate, count(*) FILTER (kind = 'SKIP')::BIGINT AS value,
         count(*) FILTER (kind = 'SKIP') = 0 AS pass FROM log
  UNION ALL SELECT 'accounting', 0, true
  UNION ALL SELECT 'duplicate ids', 0, true)
SELECT gate, 'gate' AS severity, value, pass FROM g UNION ALL
SELECT 'verdict', 'gate', count(*) FILTER (NOT pass)::BIGINT, bool_and(pass) FROM g""")
def build_report(spark, d):
    notes, ops, run = mixed_run(spark, d)
    applied = P.ops_applied(run.changelog, ops).select(
        F.lit("ops applied").alias("gate"), F.col("skipped").alias("value"), "pass")
    books = P.accounting(run.changelog, notes, run.notes).select(
        F.lit("accounting").alias("gate"),
        F.abs(F.col("expected") - F.col("notes_after")).alias("value"), "pass")
    ids = J.gate_counts([("duplicate ids", J.duplicate_keys(run.notes, "nid"))])
    gates = applied.unionByName(books).unionByName(ids).withColumn("severity", F.lit("gate"))
    return P.build_report(gates)


@query("integrity_gate", """
SELECT 'orphan cards' AS gate, count(*)::BIGINT AS value, count(*) = 0 AS pass FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 <> 7)
UNION ALL SELECT 'notes with no card', count(*)::BIGINT, count(*) = 0 FROM orders
  WHERE o_orderkey % 50 <> 7 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'duplicate guids', count(*)::BIGINT, count(*) = 0 FROM (SELECT o_totalprice FROM orders
  WHERE o_orderkey % 50 <> 7 GROUP BY o_totalprice HAVING count(*) > 1)
UNION ALL SELECT 'bad notetype ref', count(*)::BIGINT, count(*) = 0 FROM orders
  WHERE o_orderkey % 50 <> 7 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 9)
UNION ALL SELECT 'bad deck ref', count(*)::BIGINT, count(*) = 0 FROM lineitem
  WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)""", bench=True)
def integrity_gate(spark, d):
    notes = table(spark, d, "orders").where(F.pmod("o_orderkey", F.lit(50)) != 7).select(
        F.col("o_orderkey").alias("nid"), F.col("o_custkey").alias("mid"),
        F.col("o_totalprice").cast("string").alias("guid"))
    cards = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("nid"), F.col("l_suppkey").alias("did"))
    decks = table(spark, d, "supplier").select(F.col("s_suppkey").alias("did"))
    types = table(spark, d, "customer").where("c_nationkey <> 9").select(
        F.col("c_custkey").alias("mid"))
    return J.integrity_gate(notes, cards, decks, types)


@query("drift_gate", """
SELECT 'sort field or checksum drift' AS gate, count(*) FILTER (doc_id % 7 = 2 OR doc_id % 9 = 4)
  ::BIGINT AS value, count(*) FILTER (doc_id % 7 = 2 OR doc_id % 9 = 4) = 0 AS pass FROM documents""")
def drift_gate(spark, d):
    notes = full_notes(spark, d)
    notes = notes.withColumn("sfld", F.when(F.pmod("nid", F.lit(7)) == 2, "stale").otherwise(
        F.col("sfld"))).withColumn("csum", F.when(F.pmod("nid", F.lit(9)) == 4, 1).otherwise(
            F.col("csum")))
    return C.drift_gate(notes)


@query("attribution_gate", f"""WITH {_SPOKEN}, {_ATTRIBUTED}
SELECT nid, field, hit, CASE WHEN nid % 6 < 2 THEN 'gate' ELSE 'warn' END AS severity FROM hits""")
def attribution_gate(spark, d):
    notes = spoken_notes(spark, d)
    return C.attribution_gate(notes, notes.where(F.pmod("nid", F.lit(6)) < 2).select("nid"), "Acme")


@query("preservation_gate", """
SELECT doc_id AS nid, CASE WHEN toxic = 1 AND quality = 1
    THEN 'delete would destroy Personal Notes, Textbook' END AS problem
FROM labels WHERE quality = 1 AND toxic = 1 AND doc_id % 5 = 0""")
def preservation_gate(spark, d):
    notes, ops, run = mixed_run(spark, d)
    return J.preservation_gate(notes, run.notes, C.clean_ops(ops), C.op_kinds(run.changelog)).select(
        "nid", "problem")


@query("roundtrip_check", f"""WITH {NOTES}, per AS (SELECT deck, count(*)::BIGINT AS n,
  min(md5(text)) AS least, max(md5(extra)) AS most FROM notes GROUP BY deck)
SELECT 'all' AS deck, sum(n)::BIGINT AS n, NULL AS least, NULL AS most FROM per
UNION ALL SELECT * FROM per""")
def roundtrip_check(spark, d):
    """The rows that came back, in all (none if the check fails) and per deck with digests."""
    path = scratch_path(spark, "roundtrip")
    check = sinks.roundtrip_check(full_notes(spark, d), path)
    none = F.lit(None).cast("string")
    whole = check.select(F.lit("all").alias("deck"), F.when(F.col("pass"), F.col("rows_read")).otherwise(0).alias("n"),
                         none.alias("least"), none.alias("most"))
    return whole.unionByName(spark.read.parquet(path).groupBy("deck").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.md5("text")).alias("least"), F.max(F.md5("extra")).alias("most")))


@query("assign_ids", """
SELECT l_orderkey AS op_seq, part, greatest((SELECT max(o_orderkey) FROM orders) + 1, 500) +
  row_number() OVER (ORDER BY l_orderkey, part) - 1 AS nid
FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey)::BIGINT AS part FROM lineitem)""")
def assign_ids(spark, d):
    per_order = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    parts = per_order.select(F.col("l_orderkey").alias("op_seq"),
                             F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("part"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("nid"))
    return O.assign_ids(parts, orders, 500)


@query("write_changelog", f"WITH {_RUN} SELECT kind, count(*)::BIGINT AS n FROM log GROUP BY kind")
def write_changelog(spark, d):
    path = scratch_path(spark, "changelog")
    log = mixed_run(spark, d)[2].changelog.withColumn("run_id", F.lit("r1"))
    sinks.write_changelog(log.select("run_id", "seq", "kind", "nid", "reason"), path)
    # The same run again adds nothing: only entries that are not there yet are appended.
    again = sinks.read_changelog(spark, path)
    fresh = log.join(again.select("kind", F.col("seq").alias("_s")),
                     (log["seq"] == F.col("_s")) & (log["kind"] == again["kind"]), "left_anti")
    sinks.write_changelog(fresh.select("run_id", "seq", "kind", "nid", "reason"), path)
    return sinks.read_changelog(spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_tail_fields", """
SELECT CASE WHEN doc_id % 5 = 0 THEN 'Personal Notes, Textbook' ELSE '' END AS fields,
  count(*)::BIGINT AS n FROM documents GROUP BY 1""")
def distinct_tail_fields(spark, d):
    from corpusgate.operators.notes import tail_populated
    fields = F.array_join(tail_populated(), ", ").alias("fields")
    return full_notes(spark, d).groupBy(fields).agg(F.count(F.lit(1)).alias("n"))



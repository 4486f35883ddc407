"""Queries over joins, set comparisons and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F


from corpusgate.functions.text import TAG, match_key
from corpusgate.operators import relate as J
from corpusgate.operators import rules as R
from corpusgate.plans.base import (MARKED, NOTES, doc_notes, marked_notes, query, sql_strip,
                                   sub, table)
from corpusgate.plans.checks import _LEDGER
from corpusgate.plans.texts import _MEDIA_SQL, media_pages


@query("orphan_items", """
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 17 <> 3)""")
def orphan_items(spark, d):
    kept = table(spark, d, "orders").where(F.pmod("o_orderkey", F.lit(17)) != 3)
    return J.orphan_children(table(spark, d, "lineitem"), kept, "l_orderkey", "o_orderkey").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"))


@query("orders_without_items", """
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
       bench=True)
def orders_without_items(spark, d):
    return J.childless_parents(table(spark, d, "orders"), table(spark, d, "lineitem"),
                               "o_orderkey", "l_orderkey").select("o_orderkey")


@query("bad_references", """
SELECT c_custkey FROM customer
WHERE nullif(c_nationkey, 3) NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)
UNION ALL SELECT -c_custkey FROM customer
WHERE nullif(c_nationkey, 3) NOT IN (SELECT nullif(n_nationkey, 5) FROM nation)
UNION ALL SELECT 1000000 + c_custkey FROM customer
WHERE nullif(c_nationkey, 3) NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 0)""")
def bad_references(spark, d):
    customers = table(spark, d, "customer").select(
        "c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("nk"))
    nation = table(spark, d, "nation")
    a = J.bad_reference(customers, nation.where("n_regionkey <> 2"), "nk", "n_nationkey")
    b = J.bad_reference(customers, nation.select(
        F.nullif("n_nationkey", F.lit(5)).alias("k")), "nk", "k")
    c = J.bad_reference(customers, nation.where("n_nationkey < 0"), "nk", "n_nationkey")
    return a.select("c_custkey").unionByName(b.select((-F.col("c_custkey")).alias("c_custkey"))
                                             ).unionByName(c.select((F.col("c_custkey") + 1000000)
                                                                    .alias("c_custkey")))


@query("duplicate_texts", """
SELECT md5(text) AS digest, count(*)::BIGINT AS n FROM documents GROUP BY text HAVING count(*) > 1""",
       bench=True)
def duplicate_texts(spark, d):
    # Grouping by a digest moves 32 characters per document instead of its text.
    docs = table(spark, d, "documents").select(F.md5("text").alias("digest"))
    return J.duplicate_keys(docs, "digest")



@query("pair_sources", f"""
SELECT coalesce(a.k, b.k) AS key, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'full'
  WHEN b.k IS NOT NULL THEN 'optimize-only' ELSE 'source-only' END AS mode
FROM (SELECT 'doc ' || doc_id AS k FROM labels) a
FULL JOIN (SELECT 'doc ' || doc_id AS k FROM documents WHERE lang = 'en') b ON a.k = b.k""")
def pair_sources(spark, d):
    n = F.col("doc_id")
    even = F.when(F.pmod(n, F.lit(2)) == 0, "Doc_").otherwise("doc - ")
    sources = table(spark, d, "labels").select(
        match_key(F.concat(F.lit("in/"), even, n, F.lit(".pdf"))).alias("key"))
    decks = table(spark, d, "documents").where("lang = 'en'").select(
        match_key(F.concat(F.lit("Doc "), n, F.lit(" Deck.apkg"))).alias("key"))
    return J.pair_by_key(sources, decks).select("key", "mode")


@query("key_sets", """
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'right'
  WHEN b.doc_id IS NULL THEN 'left' ELSE 'both' END AS side
FROM (SELECT doc_id FROM labels) a FULL JOIN (SELECT doc_id FROM documents WHERE lang = 'en') b
ON a.doc_id = b.doc_id""")
def key_sets(spark, d):
    return J.key_sets(table(spark, d, "labels"),
                      table(spark, d, "documents").where("lang = 'en'"), "doc_id")


@query("priority_match", """
WITH c AS (SELECT 'k' || (o_custkey % 900) AS file_key, 'k' || (o_orderkey % 1300) AS inner_key,
             'p' || lpad(o_orderkey::VARCHAR, 9, '0') AS path FROM orders),
f AS (SELECT file_key AS key, min(path) AS p FROM c GROUP BY 1),
i AS (SELECT inner_key AS key, min(path) AS p FROM c GROUP BY 1),
w AS (SELECT 'k' || c_custkey AS key FROM customer)
SELECT w.key, coalesce(f.p, i.p) AS path,
       CASE WHEN f.p IS NOT NULL THEN 'file' WHEN i.p IS NOT NULL THEN 'inner' END AS via
FROM w LEFT JOIN f ON w.key = f.key LEFT JOIN i ON w.key = i.key""")
def priority_match(spark, d):
    k = F.lit("k")
    candidates = table(spark, d, "orders").select(
        F.concat(k, F.pmod("o_custkey", F.lit(900))).alias("file_key"),
        F.concat(k, F.pmod("o_orderkey", F.lit(1300))).alias("inner_key"),
        F.concat(F.lit("p"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("path"))
    wanted = table(spark, d, "customer").select(F.concat(k, "c_custkey").alias("key"))
    return J.priority_match(wanted, candidates)


@query("exclude_tracked", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def exclude_tracked(spark, d):
    return J.exclude_tracked(table(spark, d, "documents"), table(spark, d, "labels"),
                             "doc_id", "doc_id").select("doc_id")


@query("ledger_reconcile", f"""WITH {MARKED}, {_LEDGER}
SELECT count(*)::BIGINT AS notes,
  (SELECT count(DISTINCT doc_id) FROM labels WHERE quality = 0)::BIGINT AS touched,
  count(*) FILTER (nid NOT IN (SELECT doc_id FROM labels WHERE quality = 0))::BIGINT AS untouched,
  count(*) FILTER (nid NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND len(flags) > 0)
    ::BIGINT AS flagged_untouched,
  (SELECT count(*) FROM benchmark)::BIGINT AS added FROM flags""")
def ledger_reconcile(spark, d):
    ops = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("nid"))
    return J.reconcile_ledger(R.ledger(marked_notes(spark, d)), ops, table(spark, d, "benchmark"))


# ---- survival of tails and media ------------------------------------------------------------------

_TAILS = """tails AS (SELECT c_custkey AS nid, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END
    AS personal, CASE WHEN c_custkey % 3 = 0 THEN 'n' || (c_custkey % 200) ELSE ' ' END AS textbook
  FROM customer), later AS (SELECT nid, personal, textbook FROM tails WHERE nid % 5 <> 1)"""


def tail_notes(spark, d):
    n = F.col("c_custkey")
    blank = F.lit("")
    return table(spark, d, "customer").select(
        n.alias("nid"), F.concat(F.lit("front "), n).alias("text"), blank.alias("extra"),
        F.when(F.pmod(n, F.lit(4)) == 0, "").otherwise(F.col("c_mktsegment")).alias("personal"),
        blank.alias("custom"), blank.alias("missed"),
        F.when(F.pmod(n, F.lit(3)) == 0, F.concat(F.lit("n"), F.pmod(n, F.lit(200))))
        .otherwise(" ").alias("textbook"), blank.alias("resources"))


@query("tail_survival", f"""WITH {_TAILS}
SELECT nid, array_to_string(list_filter([CASE WHEN trim(personal) <> '' THEN 'Personal Notes' END,
    CASE WHEN trim(textbook) <> '' THEN 'Textbook' END], lambda x: x IS NOT NULL), ', ') AS fields
FROM tails WHERE (trim(personal) <> '' OR trim(textbook) <> '')
  AND NOT EXISTS (SELECT 1 FROM later WHERE later.personal = tails.personal
                  AND later.textbook = tails.textbook)""")
def tail_survival(spark, d):
    notes = tail_notes(spark, d)
    return J.tail_survival(notes, notes.where(F.pmod("nid", F.lit(5)) != 1))


@query("media_survival", f"""WITH refs AS ({_MEDIA_SQL}), gone AS (
  SELECT nid, ref FROM refs WHERE ref NOT IN (SELECT ref FROM refs WHERE nid % 3 = 0)),
lost AS (SELECT ref, count(*)::BIGINT AS n_owners FROM gone GROUP BY ref
         HAVING NOT bool_and(nid % 7 = 1)),
ranked AS (SELECT ref, nid, row_number() OVER (PARTITION BY ref ORDER BY nid) AS r FROM gone)
SELECT ref, string_agg(nid::VARCHAR, ', ' ORDER BY nid) AS owners, any_value(n_owners) AS n_owners
FROM lost JOIN ranked USING (ref) WHERE r <= 4 GROUP BY ref""")
def media_survival(spark, d):
    notes = media_pages(spark, d)
    for c in ("extra", "personal", "custom", "missed", "textbook", "resources"):
        notes = notes.withColumn(c, F.lit(""))
    third, week = F.pmod("nid", F.lit(3)), F.pmod("nid", F.lit(7))
    return J.media_survival(notes, notes.where(third == 0), notes.where(week == 1))


# ---- inserts and demotes ------------------------------------------------------------------------

def _insert_key(expr: str) -> str:
    return f"lower({sql_strip(sub(expr, TAG))})"


@query("exact_dupe_inserts", f"""
WITH k AS (SELECT doc_id, {_insert_key('text')} AS k FROM documents),
n AS (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r
      FROM k WHERE doc_id % 3 <> 0)
SELECT doc_id, CASE WHEN r = 1 AND k NOT IN (SELECT k FROM k WHERE doc_id % 3 = 0) THEN 'ADD'
                    ELSE 'DUPE-SKIP' END AS kind FROM n""", bench=True)
def exact_dupe_inserts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    third = F.pmod("doc_id", F.lit(3))
    return J.dedupe_inserts(docs.where(third != 0), docs.where(third == 0), "doc_id").select(
        "doc_id", "kind")


@query("demote_loss", f"""WITH {NOTES}, ops AS (SELECT a.doc_id AS nid, a.doc_id + 1 AS into_nid
  FROM labels a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.quality = 0)
SELECT nid, len(lost)::BIGINT AS n_lost, md5(array_to_string(list_sort(lost), ',')) AS digest FROM (
  SELECT o.nid, list_filter(list_distinct(list_transform(regexp_extract_all(
      {sub("s.text || ' ' || s.extra", TAG, ' ')}, '[A-Za-z]{{6,}}'), lambda w: lower(w))),
    lambda w: NOT contains(lower({sub("s.text || ' ' || t.extra || ' ' || t.text", TAG, ' ')}), w))
    AS lost
  FROM ops o JOIN notes s ON s.nid = o.nid JOIN notes t ON t.nid = o.into_nid)""")
def demote_loss(spark, d):
    notes = doc_notes(spark, d)
    wanted = table(spark, d, "labels").where("quality = 0").select(
        F.col("doc_id").alias("nid"), (F.col("doc_id") + 1).alias("into_nid"))
    ops = wanted.join(notes.select("nid", F.array("text").alias("facts")), "nid")
    return J.demote_loss(ops, notes).select(
        "nid", F.size("lost").cast("bigint").alias("n_lost"),
        F.md5(F.array_join("lost", ",")).alias("digest"))


@query("field_pair_overlap", f"""
WITH t AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(turn) OVER w AS nt,
    lead(text) OVER w AS ne FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id * 1000 + turn AS nid,
    list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS a,
    list_distinct(regexp_extract_all(lower(ne), '[a-z]{{3,}}')) AS b
  FROM t WHERE role = 'user' AND nr = 'assistant' AND nt = turn + 1)
SELECT nid, array_to_string(list_sort(list_intersect(a, b)), ' ') AS shared FROM p""")
def field_pair_overlap(spark, d):
    from corpusgate.functions.text import content_terms
    from corpusgate.operators.claims import shared_values
    from corpusgate.operators.notes import notes_from_conversations
    notes = notes_from_conversations(table(spark, d, "conversations"))
    shared = shared_values(content_terms("text", 3, ()), content_terms("extra", 3, ()))
    return notes.select("nid", F.array_join(shared, " ").alias("shared"))


# ---- registries and manifests ---------------------------------------------------------------------

@query("merge_missing", """
WITH s AS (SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_nationkey END::BIGINT
    AS date, c_mktsegment AS issue FROM customer WHERE c_custkey % 2 = 0),
t AS (SELECT c_custkey AS id, CASE WHEN c_nationkey < 5 THEN NULL ELSE c_nationkey END::BIGINT AS date,
    c_mktsegment || (c_custkey % 3) AS issue FROM customer WHERE c_custkey % 2 = 1
    UNION ALL SELECT id, date, issue FROM s WHERE id % 10 = 0)
SELECT date, issue, false AS merged FROM s UNION ALL SELECT DISTINCT date, issue, true FROM t
WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.date IS NOT DISTINCT FROM t.date AND s.issue = t.issue)""")
def merge_missing(spark, d):
    c = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_nationkey") >= 5, F.col("c_nationkey").cast("bigint")).alias("date"),
        F.col("c_mktsegment").alias("issue"))
    state = c.where(F.pmod("id", F.lit(2)) == 0)
    template = c.where(F.pmod("id", F.lit(2)) == 1).withColumn(
        "issue", F.concat("issue", F.pmod("id", F.lit(3)))).unionByName(
        state.where(F.pmod("id", F.lit(10)) == 0))
    return J.merge_missing(state, template, ["date", "issue"]).select("date", "issue", "merged")


@query("upsert_run", """
WITH old AS (SELECT c_custkey AS name, c_mktsegment AS status, c_nationkey::BIGINT AS note FROM customer),
run AS (SELECT o_custkey AS name, max(o_orderpriority) AS status, count(*)::BIGINT AS added
        FROM orders WHERE o_custkey % 2 = 0 GROUP BY o_custkey
        UNION ALL SELECT -1 - s_suppkey, 'new', 1 FROM supplier)
SELECT coalesce(old.name, run.name) AS name, CASE WHEN run.name IS NULL THEN old.status
       ELSE run.status END AS status, note, added
FROM old FULL JOIN run ON old.name = run.name""")
def upsert_run(spark, d):
    old = table(spark, d, "customer").select(
        F.col("c_custkey").alias("name"), F.col("c_mktsegment").alias("status"),
        F.col("c_nationkey").cast("bigint").alias("note"))
    runs = (table(spark, d, "orders").where(F.pmod("o_custkey", F.lit(2)) == 0)
            .groupBy(F.col("o_custkey").alias("name"))
            .agg(F.max("o_orderpriority").alias("status"), F.count(F.lit(1)).alias("added")))
    fresh = table(spark, d, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("name"), F.lit("new").alias("status"),
        F.lit(1).cast("bigint").alias("added"))
    return J.upsert(old, runs.unionByName(fresh))


_MANIFEST = """m AS (SELECT 'd' || doc_id AS path, sha256(text) AS sha256, doc_id FROM documents),
  actual AS (SELECT path, CASE WHEN doc_id % 11 = 2 THEN sha256('x') ELSE sha256 END AS sha256
             FROM m WHERE doc_id % 13 <> 5)"""


@query("manifest_diff", f"""WITH {_MANIFEST}
SELECT m.path, CASE WHEN a.path IS NULL THEN 'missing' ELSE 'altered' END AS state
FROM m LEFT JOIN actual a ON m.path = a.path WHERE a.path IS NULL OR a.sha256 <> m.sha256""")
def manifest_diff(spark, d):
    n = F.col("doc_id")
    listed = table(spark, d, "documents").select(
        F.concat(F.lit("d"), n).alias("path"), F.sha2("text", 256).alias("sha256"), "doc_id")
    actual = listed.where(F.pmod(n, F.lit(13)) != 5).withColumn("sha256", F.when(
        F.pmod(n, F.lit(11)) == 2, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha256")))
    return J.manifest_diff(listed.drop("doc_id"), actual.drop("doc_id"))


@query("manifest_delta", """
WITH d AS (SELECT doc_id, 'd' || doc_id AS path FROM documents)
SELECT path, 'retired' AS change FROM d WHERE doc_id % 3 <> 0 AND doc_id % 4 = 0
UNION ALL SELECT path, 'retained' FROM d WHERE doc_id % 3 <> 0 AND doc_id % 4 <> 0
UNION ALL SELECT path, 'created' FROM d WHERE doc_id % 4 <> 0 AND doc_id % 5 <> 0""")
def manifest_delta(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"))

    def by(k, keep):
        rest = F.pmod("doc_id", F.lit(k))
        return docs.where(rest == 0 if keep else rest != 0)
    return J.manifest_delta(by(3, False), by(4, False), by(5, True))


_REPORTS = """reports AS (SELECT 'm' || o_custkey AS module, 'REPORT_' || strftime(o_orderdate, '%Y-%m-%d')
  || '.md' AS report FROM orders WHERE o_orderstatus = 'F')"""


def report_files(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("m"), "o_custkey").alias("module"),
        F.concat(F.lit("REPORT_"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".md"))
        .alias("report"))


@query("report_lookup", f"""WITH {_REPORTS}
SELECT 'm' || c_custkey AS name, max(report) IS NOT NULL AS has_report, max(report) AS latest_report
FROM customer LEFT JOIN reports ON module = 'm' || c_custkey GROUP BY 1""")
def report_lookup(spark, d):
    modules = table(spark, d, "customer").select(F.concat(F.lit("m"), "c_custkey").alias("name"))
    return J.report_lookup(modules, report_files(spark, d))


@query("latest_reports", f"WITH {_REPORTS} SELECT module, max(report) AS report FROM reports GROUP BY 1")
def latest_reports(spark, d):
    from corpusgate.operators.order import latest_report
    return latest_report(report_files(spark, d))


@query("untracked_outputs", """
SELECT 'Customer#' || lpad((s_suppkey * 20)::VARCHAR, 9, '0') AS folder FROM supplier
WHERE lower('Customer#' || lpad((s_suppkey * 20)::VARCHAR, 9, '0')) NOT IN
  (SELECT lower(c_name) FROM customer)""")
def untracked_outputs(spark, d):
    outputs = table(spark, d, "supplier").select(F.concat(F.lit("Customer#"), F.lpad(
        (F.col("s_suppkey") * 20).cast("string"), 9, "0")).alias("folder"))
    registry = table(spark, d, "customer").select(F.upper("c_name").alias("name"))
    return J.untracked_outputs(outputs, registry)


# ---- logs ------------------------------------------------------------------------------------------

_LOGS = """prior AS (SELECT 'EDIT' AS kind, doc_id AS nid, 'q' || quality AS reason FROM labels),
  fresh AS (SELECT CASE WHEN toxic = 1 THEN 'DELETE' ELSE 'EDIT' END AS kind,
    CASE WHEN doc_id % 9 = 0 THEN NULL ELSE doc_id END AS nid, 'q1' AS reason FROM labels)"""


def change_logs(spark, d):
    labels = table(spark, d, "labels")
    prior = labels.select(
        F.lit("a").alias("run_id"), F.col("doc_id").alias("seq"), F.lit("EDIT").alias("kind"),
        F.col("doc_id").alias("nid"), F.concat(F.lit("q"), "quality").alias("reason"))
    fresh = labels.select(
        F.col("doc_id").alias("seq"),
        F.when(F.col("toxic") == 1, "DELETE").otherwise("EDIT").alias("kind"),
        F.when(F.pmod("doc_id", F.lit(9)) != 0, F.col("doc_id")).alias("nid"),
        F.lit("q1").alias("reason"))
    return prior, fresh


@query("changelog_union", f"""WITH {_LOGS}
SELECT kind, nid, reason FROM prior UNION SELECT kind, nid, reason FROM fresh""")
def changelog_union(spark, d):
    return J.changelog_union(*change_logs(spark, d))


@query("append_changelog", f"""WITH {_LOGS}
SELECT true AS carried, kind, nid, reason FROM prior p WHERE NOT EXISTS (SELECT 1 FROM fresh f
  WHERE f.kind = p.kind AND f.nid IS NOT DISTINCT FROM p.nid AND f.reason = p.reason)
UNION ALL SELECT false, kind, nid, reason FROM fresh""")
def append_changelog(spark, d):
    prior, fresh = change_logs(spark, d)
    return J.append_changelog(prior, fresh, "b").select("carried", "kind", "nid", "reason")



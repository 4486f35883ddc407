"""Queries over work items, phases, registries and report sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgate.functions import values as V
from corpusgate.operators import order as O
from corpusgate.operators import registry as M
from corpusgate.operators import report as P
from corpusgate.operators import rules as R
from corpusgate.plans.base import query, table
from corpusgate.plans.joins import _REPORTS, report_files

_MODULES_SQL = """modules AS (SELECT 'm' || c_custkey AS name, CASE c_custkey % 6 WHEN 0 THEN 'verified'
    WHEN 1 THEN 'built-unverified' WHEN 2 THEN 'in-progress' WHEN 3 THEN 'pending'
    WHEN 4 THEN 'built-unverified' END AS status, c_custkey % 90 AS cards_before,
    CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 120 END AS cards_after FROM customer)"""


def modules(spark, d):
    n = F.col("c_custkey")
    k = F.pmod(n, F.lit(6))
    status = (F.when(k == 0, "verified").when((k == 1) | (k == 4), "built-unverified")
              .when(k == 2, "in-progress").when(k == 3, "pending"))
    return table(spark, d, "customer").select(
        F.concat(F.lit("m"), n).alias("name"), status.alias("status"),
        F.pmod(n, F.lit(90)).alias("cards_before"),
        F.when(F.pmod(n, F.lit(11)) != 0, F.pmod(n, F.lit(120))).alias("cards_after"))


@query("registry_totals", f"""WITH {_MODULES_SQL}
SELECT count(*) FILTER (coalesce(status, 'unknown') <> 'pending')::BIGINT AS modules_complete,
  count(*) FILTER (status = 'verified')::BIGINT AS modules_verified,
  sum(cards_before)::BIGINT AS cards_before, sum(coalesce(cards_after, 0))::BIGINT AS cards_after
FROM modules""")
def registry_totals(spark, d):
    return M.registry_totals(modules(spark, d))


@query("status_summary", f"""WITH {_MODULES_SQL}
SELECT coalesce(status, 'unknown') AS status, count(*)::BIGINT AS n FROM modules GROUP BY 1""")
def status_summary(spark, d):
    return M.status_summary(modules(spark, d))


@query("status_order", f"""WITH {_MODULES_SQL}
SELECT name, status, row_number() OVER (ORDER BY CASE status WHEN 'in-progress' THEN 0
  WHEN 'built-unverified' THEN 1 WHEN 'pending' THEN 2 WHEN 'verified' THEN 3 ELSE 9 END, name)
  ::BIGINT AS place FROM modules""")
def status_order(spark, d):
    ranked = modules(spark, d).withColumn("rank", O.status_rank())
    return O.numbered_by(ranked, ["rank", "name"], "place").select("name", "status", "place")


_QUEUE_SQL = """queue AS (SELECT 'm' || s_suppkey * 7 AS name, 'f' || s_suppkey AS apkg,
    CASE WHEN s_suppkey % 8 = 0 THEN 'held' ELSE 'pending' END AS status FROM supplier),
  progress AS (SELECT 'm' || s_suppkey * 7 AS module, CASE s_suppkey % 9 WHEN 0 THEN true
      WHEN 1 THEN NULL ELSE false END AS complete FROM supplier WHERE s_suppkey % 3 = 0),
  files AS (SELECT 'f' || s_suppkey AS path FROM supplier WHERE s_suppkey % 5 <> 2)"""


def work_tables(spark, d):
    s = F.col("s_suppkey")
    suppliers = table(spark, d, "supplier")
    name = F.concat(F.lit("m"), s * 7)
    queue = suppliers.select(name.alias("name"), F.concat(F.lit("f"), s).alias("apkg"), F.when(
        F.pmod(s, F.lit(8)) == 0, "held").otherwise("pending").alias("status"))
    ninth = F.pmod(s, F.lit(9))
    progress = suppliers.where(F.pmod(s, F.lit(3)) == 0).select(name.alias("module"), F.when(
        ninth == 0, True).when(ninth != 1, False).alias("complete"))
    files = suppliers.where(F.pmod(s, F.lit(5)) != 2).select(
        F.concat(F.lit("f"), s).alias("path"))
    return queue, progress, files


_PHASES = f"""{_MODULES_SQL}, {_QUEUE_SQL}, {_REPORTS}, p AS (
  SELECT name, CASE WHEN status = 'built-unverified' AND name NOT IN (SELECT module FROM reports) THEN 2
    WHEN status = 'in-progress' THEN 3 WHEN status = 'built-unverified' THEN 5 END AS pr FROM modules
  UNION ALL SELECT name, CASE WHEN name IN (SELECT module FROM progress WHERE complete IS NOT TRUE) THEN 1
    WHEN status = 'pending' AND apkg NOT IN (SELECT path FROM files) THEN -4
    WHEN status = 'pending' THEN 4 END FROM queue),
b AS (SELECT name, arg_min(pr, abs(pr)) AS pr FROM p WHERE pr IS NOT NULL GROUP BY name),
phases AS (SELECT name, CASE pr WHEN 1 THEN 'RESUME' WHEN 2 THEN 'VERIFY' WHEN 3 THEN 'PATCH' WHEN 4
  THEN 'BUILD' WHEN -4 THEN 'BLOCKED' ELSE 'AWAIT' END AS action, abs(pr)::BIGINT AS priority FROM b)"""


@query("next_phase", f"WITH {_PHASES} SELECT name, action, priority FROM phases", bench=True)
def next_phase(spark, d):
    queue, progress, files = work_tables(spark, d)
    found = M.next_phase(modules(spark, d), queue, report_files(spark, d), progress, files)
    return found.withColumn("priority", F.col("priority").cast("bigint"))


@query("next_action", f"WITH {_PHASES} SELECT action, name FROM phases ORDER BY priority, name LIMIT 1")
def next_action(spark, d):
    return M.next_action(next_phase(spark, d))


_DECIDE = f"""WITH {_PHASES}, placed AS (
  SELECT b.*, p.action FROM phases p JOIN (SELECT name, abs(pr) AS priority FROM b) b USING (name)),
first AS (SELECT action, name FROM placed ORDER BY priority, CASE WHEN priority IN (1, 4)
  THEN -substr(name, 2)::BIGINT ELSE substr(name, 2)::BIGINT END, name LIMIT 1)"""


def _decided(spark, d, reports):
    """The queue runs backwards, the registry forwards."""
    queue, progress, files = work_tables(spark, d)
    number = F.substring("name", 2, 20).cast("bigint")
    return M.decide(modules(spark, d).withColumn("place", number), queue.withColumn("place", -number),
                    reports, progress, files)


@query("decide_in_order", f"""{_DECIDE}
SELECT action, CASE WHEN action <> 'AWAIT' THEN name END AS name FROM first""")
def decide_in_order(spark, d):
    return _decided(spark, d, report_files(spark, d))


@query("decide_without_reports", f"""WITH {_MODULES_SQL}
SELECT CASE WHEN count(*) FILTER (WHERE status = 'built-unverified') > 0 THEN 'BLOCKED' END AS action,
  NULL::VARCHAR AS name FROM modules""")
def decide_without_reports(spark, d):
    return _decided(spark, d, None)


@query("validate_state", """
SELECT 'c' || c_custkey AS path, problem, item FROM (
  SELECT c_custkey, unnest(CASE c_custkey % 6
    WHEN 1 THEN ['not a list'] WHEN 2 THEN ['not a count'] WHEN 3 THEN ['not an object']
    WHEN 4 THEN ['not a list', 'not an object', 'not a count'] WHEN 5 THEN ['not a count'] ELSE [] END) AS problem,
  unnest(CASE c_custkey % 6 WHEN 1 THEN ['modules'] WHEN 2 THEN ['run_count'] WHEN 3 THEN ['']
    WHEN 4 THEN ['session_log', 'paths', 'run_count'] WHEN 5 THEN ['run_count'] ELSE [] END) AS item
  FROM customer)""")
def validate_state(spark, d):
    """One registry file per customer: right ones, and ones with each kind of fault."""
    key = F.col("c_custkey")
    part, name = F.pmod(key, F.lit(6)), F.to_json(F.struct("c_name"))
    text = (F.when(part == 0, F.concat(F.lit('{"modules": ['), name, F.lit('], "run_count": 3, "paths": {}}')))
            .when(part == 1, F.concat(F.lit('{"modules": '), name, F.lit('}')))
            .when(part == 2, F.lit('{"run_count": -1, "pending_modules": []}'))
            .when(part == 3, F.concat(F.lit('['), name, F.lit(']')))
            .when(part == 4, F.lit('{"session_log": 4, "paths": [], "run_count": "5"}'))
            .otherwise(F.lit('{"run_count": 2.5, "extra": 1}')))
    states = table(spark, d, "customer").select(
        F.concat(F.lit("c"), key).alias("path"), text.alias("text"))
    return R.validate_state(states)


@query("unfinished_items", f"""WITH {_QUEUE_SQL}
SELECT module FROM progress WHERE complete IS NOT TRUE""")
def unfinished_items(spark, d):
    return M.unfinished_items(work_tables(spark, d)[1]).select("module")


_DECKS = """decks AS (SELECT 'k' || p_partkey AS key, 'a' || p_partkey AS apkg, p_partkey AS deck_id,
    'n' || (p_partkey % 1500) AS name, 'Root::' || p_name AS deck_path, p_size::BIGINT AS cards_before
  FROM part), sources AS (SELECT 'k' || p_partkey AS key, 's' || p_partkey AS pdf FROM part
  WHERE p_size % 2 = 0 UNION ALL SELECT 'z' || s_suppkey, 'q' || s_suppkey FROM supplier)"""


@query("work_queue", f"""WITH {_DECKS}
SELECT name, deck_id, deck_path, apkg, pdf, CASE WHEN pdf IS NULL THEN 'optimize-only' ELSE 'full' END
  AS mode, cards_before, 'pending' AS status FROM decks LEFT JOIN sources USING (key)
WHERE name NOT IN (SELECT 'n' || c_custkey FROM customer WHERE c_custkey % 2 = 0)""", bench=True)
def work_queue(spark, d):
    p = F.col("p_partkey")
    parts = table(spark, d, "part")
    decks = parts.select(
        F.concat(F.lit("k"), p).alias("key"), F.concat(F.lit("a"), p).alias("apkg"),
        p.alias("deck_id"), F.concat(F.lit("n"), F.pmod(p, F.lit(1500))).alias("name"),
        F.concat(F.lit("Root" + V.FIELD_SEP), "p_name").alias("deck_path"),
        F.col("p_size").cast("bigint").alias("cards_before"))
    even = parts.where(F.pmod("p_size", F.lit(2)) == 0).select(
        F.concat(F.lit("k"), p).alias("key"), F.concat(F.lit("s"), p).alias("pdf"))
    loose = table(spark, d, "supplier").select(
        F.concat(F.lit("z"), "s_suppkey").alias("key"), F.concat(F.lit("q"), "s_suppkey").alias("pdf"))
    known = table(spark, d, "customer").where(F.pmod("c_custkey", F.lit(2)) == 0).select(
        F.concat(F.lit("n"), "c_custkey").alias("name"))
    return M.work_queue(even.unionByName(loose), decks, known)


@query("deck_review", f"""WITH {_MODULES_SQL}, {_REPORTS}, calls AS (
  SELECT 'm' || (o_custkey % 400) AS module, count(*)::BIGINT AS judgements FROM orders
  WHERE o_orderstatus = 'P' GROUP BY 1),
rows_ AS (SELECT name, coalesce(status, 'unknown') AS status, cards_before, cards_after FROM modules
  UNION ALL SELECT 'M' || s_suppkey * 31, 'untracked', NULL, NULL FROM supplier
  WHERE 'm' || s_suppkey * 31 NOT IN (SELECT name FROM modules))
SELECT name, r.status, r.status = 'verified' AS verified, cards_before, cards_after,
  coalesce(judgements, 0) AS judgements,
  name IN (SELECT module FROM reports) AND r.status <> 'untracked' AS has_report,
  (SELECT max(report) FROM reports x WHERE x.module = name) AS latest_report
FROM rows_ r LEFT JOIN calls ON module = name""")
def deck_review(spark, d):
    calls = table(spark, d, "orders").where("o_orderstatus = 'P'").select(
        F.concat(F.lit("m"), F.pmod("o_custkey", F.lit(400))).alias("module"))
    outputs = table(spark, d, "supplier").select(
        F.concat(F.lit("M"), F.col("s_suppkey") * 31).alias("folder"))
    return M.deck_review(modules(spark, d), report_files(spark, d), calls, outputs)


@query("history_preserved", """
SELECT (count(*) FILTER (o_orderkey % 100 = 7) * 2 + count(*) FILTER (o_orderkey % 100 = 8))::BIGINT
  AS changed, false AS pass FROM orders""")
def history_preserved(spark, d):
    before = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run"), F.col("o_orderstatus").alias("status"))
    rest = F.pmod("run", F.lit(100))
    after = before.where(rest != 8).withColumn("status", F.when(rest == 7, "X").otherwise(
        F.col("status")))
    return M.history_preserved(before, after, ["run", "status"])


@query("add_defaults", """
SELECT c_custkey, coalesce(CASE WHEN c_nationkey > 9 THEN c_mktsegment END, 'none') AS segment,
  coalesce(CASE WHEN c_acctbal > 0 THEN c_nationkey END, 0)::BIGINT AS nation,
  concat_ws(',', CASE WHEN c_nationkey <= 9 THEN 'segment' END, CASE WHEN c_acctbal <= 0 THEN 'nation' END)
  AS added FROM customer""")
def add_defaults(spark, d):
    state = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") > 9, F.col("c_mktsegment")).alias("segment"),
        F.when(F.col("c_acctbal") > 0, F.col("c_nationkey").cast("bigint")).alias("nation"))
    done = M.add_defaults(state, {"segment": "none", "nation": 0})
    return done.withColumn("nation", F.col("nation").cast("bigint")).withColumn(
        "added", F.array_join("added", ","))


@query("last_runs", """
SELECT o_orderkey AS run, o_orderpriority AS summary FROM orders ORDER BY o_orderkey DESC LIMIT 8""")
def last_runs(spark, d):
    log = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("summary"))
    return O.last_runs(log, 8)


@query("deepest_deck", """
SELECT r AS home, did, depth::BIGINT AS depth FROM (SELECT s_nationkey AS r, s_suppkey AS did,
  s_suppkey % 3 AS depth, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 DESC, s_suppkey)
  AS k FROM supplier WHERE s_suppkey % 4 <> 1) WHERE k = 1""")
def deepest_deck(spark, d):
    s = F.col("s_suppkey")
    name = F.when(F.pmod(s, F.lit(4)) == 1, "Default").otherwise(F.concat(
        F.repeat(F.lit("Up" + V.FIELD_SEP), F.pmod(s, F.lit(3)).cast("int")), "s_name"))
    decks = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("home"), s.alias("did"), name.alias("name"))
    return O.deepest_deck(decks, ["home"]).select(
        "home", "did", F.col("depth").cast("bigint").alias("depth"))


# ---- markdown sections -------------------------------------------------------------------------------

_SECTIONS = """sections AS (SELECT 'c' || conv_id AS path, turn + 1 AS ord, role || ' ' || turn AS heading,
  '## ' || role || ' ' || turn || chr(10) || replace(text, '#', '') AS body FROM conversations)"""


def reports_text(spark, d):
    """One markdown report per conversation, a section per turn."""
    piece = F.concat(F.lit("## "), "role", F.lit(" "), "turn", F.lit("\n"),
                     F.replace("text", F.lit("#"), F.lit("")))
    return (table(spark, d, "conversations").groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", piece.alias("p")))).alias("ps"))
        .select(F.concat(F.lit("c"), "conv_id").alias("path"), F.concat(
            F.lit("intro\n"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n")).alias("text")))


@query("markdown_sections", f"""WITH {_SECTIONS}
SELECT path, (row_number() OVER (PARTITION BY path ORDER BY ord))::BIGINT AS ord, trim(heading) AS heading,
  md5(body) AS body FROM sections""")
def markdown_sections(spark, d):
    from corpusgate.sources.texts import sections
    return sections(reports_text(spark, d)).select(
        "path", F.col("ord").cast("bigint").alias("ord"), "heading", F.md5("body").alias("body"))


@query("section_sizes", f"""WITH {_SECTIONS}
SELECT coalesce(path, '(all)') AS path, coalesce(heading, '(all)') AS heading,
  sum(length(body))::BIGINT AS n_chars, (sum(length(body))::BIGINT // 4)::BIGINT AS n_tokens
FROM sections GROUP BY ROLLUP (path, heading)""")
def section_sizes(spark, d):
    from corpusgate.sources.texts import sections
    rolled = P.section_sizes(sections(reports_text(spark, d)))
    return rolled.select(F.coalesce("path", F.lit("(all)")).alias("path"),
                         F.coalesce("heading", F.lit("(all)")).alias("heading"), "n_chars", "n_tokens")


@query("judgement_lines", """
WITH l AS (SELECT 'c' || conv_id || '-' || turn AS path, unnest(string_split(text, chr(10))) AS line,
    unnest(range(len(string_split(text, chr(10))))) AS ix FROM conversations WHERE turn % 5 < 4),
r AS (SELECT path, trim(line) AS line, row_number() OVER (PARTITION BY path ORDER BY ix) AS place
  FROM l WHERE trim(line) <> '')
SELECT path, place::BIGINT AS place, md5(line) AS line FROM r WHERE place <= 40""")
def judgement_lines(spark, d):
    """One report per turn: the section under each of four heading levels, or under none."""
    level = F.pmod("turn", F.lit(5)).cast("int")
    heading = F.when(level < 4, F.concat(F.repeat(F.lit("#"), level + 1), F.lit(" JUDGMENT calls"))
                     ).otherwise("##### Judgement calls")
    reports = table(spark, d, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("path"),
        F.concat(F.lit("# Summary\nnot this\n"), heading, F.lit("\n"), "text",
                 F.lit("\n#### Next\nnor this\n"),
                 F.when(level < 4, "## Judgement calls\nnor a second one\n").otherwise("")
                 ).alias("text"))
    return P.judgement_lines(reports).select(
        "path", F.col("place").cast("bigint").alias("place"), F.md5("line").alias("line"))

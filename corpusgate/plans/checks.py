"""Queries over single-note checks, ledgers and the violations table."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgate.functions import values as V
from corpusgate.functions.base import WS
from corpusgate.functions.text import CLOZE, ENTITY, TAG
from corpusgate.operators import order as O
from corpusgate.operators import report as P
from corpusgate.operators import rules as R
from corpusgate.plans.base import (MARKED, ascii_words, find, has, lit, marked_notes,
                                   query, spread_table, sql_strip, sub, table)
from corpusgate.plans.texts import _compact_sql


def _count(expr: str, needle: str) -> str:
    return f"((length({expr}) - length(replace({expr}, {lit(needle)}, ''))) // {len(needle)})"


def _rules_sql(audit: bool) -> str:
    c1 = "len(regexp_extract_all(text, '\\{\\{c1::'))"
    rules = [(f"{c1} = 0", "no cloze"), (f"{c1} > 3", ">3 clozes"),
             ("contains(text, '{{c2::') OR contains(text, '{{c3::')", "c2/c3"),
             (f"contains({sub('text', ENTITY)}, ';')", "semicolon"),
             (f"{_count('text', '{{')} <> {_count('text', '}}')}", "unbalanced braces")]
    rules += [(f"{_count('extra', f'<{t}>')} <> {_count('extra', f'</{t}>')}",
               f"unbalanced <{t}>") for t in "bui"]
    if audit:
        rules.append((f"{sql_strip('extra')} = ''", "empty Extra"))
    cases = " UNION ALL ".join(f"SELECT nid, deck, {lit(n)} AS rule FROM marked WHERE {c}"
                               for c, n in rules)
    return cases


@query("house_rules", f"WITH {MARKED} SELECT nid, rule FROM ({_rules_sql(False)})")
def house_rules(spark, d):
    return marked_notes(spark, d).select("nid", F.explode(R.house_rules()).alias("rule"))


@query("house_rules_audit", f"""WITH {MARKED}
SELECT rule, count(*)::BIGINT AS n FROM ({_rules_sql(True)}) GROUP BY rule""", bench=True)
def house_rules_audit(spark, d):
    found = marked_notes(spark, d).select(F.explode(R.house_rules(audit=True)).alias("rule"))
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


_ANSWERS = f"""answers AS (SELECT nid, {sql_strip(sub('a', TAG))} AS item FROM (
  SELECT nid, unnest({find('text', '{{c1::([^' + chr(92) + 'n]*?)}}'.replace('{', chr(92) + '{').replace('}', chr(92) + '}'), 1)}) AS a FROM marked))"""


@query("cloze_mechanics", f"""WITH {MARKED}, {_ANSWERS}
SELECT nid, 'long answer' AS kind, item FROM answers WHERE len(list_filter(
  regexp_split_to_array(item, {lit(WS + '+')}), lambda w: w <> '')) > 3
UNION ALL SELECT nid, 'unit in answer', item FROM answers
  WHERE {has(ascii_words('item'), R.AUDIT_UNIT)}
UNION ALL SELECT nid, 'punctuation in answer', item FROM answers
  WHERE {has('item', r'[,;:]|\.[ \t\r\n]|\.$')}
UNION ALL SELECT nid, 'bare short form', item FROM (SELECT DISTINCT nid, text,
    unnest({find(ascii_words('text'), r'\b([A-Z]{3,})\b', 1)}) AS item FROM marked)
  WHERE NOT contains(text, '(' || item || ')') AND item NOT IN
    ('ASIS', 'TLF', 'PVS', 'IIM', 'TAP', 'QL')""")
def cloze_mechanics(spark, d):
    return R.cloze_mechanics(marked_notes(spark, d))


def _word(expr, words, flags="(?i)"):
    return has(ascii_words(expr), rf"{flags}\b(?:{'|'.join(words)})\b")


_SHORT = (f"list_filter({find(ascii_words('bare'), chr(92) + 'b[A-Z]{2,6}' + chr(92) + 'b')}, "
          "lambda a: a NOT IN ('IO', 'NCE'))")
_FLAGS = [
    ("n_ids > 1", "'multi-cloze:' || n_ids"), ("n_ids > 3", "'over-3-clozes'"),
    (f"len(list_filter(answers, lambda a: len(list_filter(regexp_split_to_array(a, "
     f"{lit(WS + '+')}), lambda w: w <> '')) > 2)) > 0", "'long-cloze'"),
    ("len(list_filter(answers, lambda a: regexp_matches(a, '[.,;:]'))) > 0",
     "'punctuation-in-cloze'"),
    (has(ascii_words("text"), R.LEDGER_UNIT_IN_CLOZE), "'unit-inside-cloze'"),
    ("contains(text, '{{c') AND len(answers) = 0", "'malformed-cloze'"),
    (has("bare || extra", "(?i)" + "|".join(V.LEDGER_ATTRIBUTIONS)), "'attribution'"),
    (_word("bare", V.LEDGER_CERTAINTY), "'certainty-word'"),
    (has("bare", "[0-9]"), "'has-number'"),
    (_word("bare", V.LEDGER_DIRECTIONS), "'direction'"),
    (_word("bare", V.LEDGER_DOSE_UNITS, ""), "'dose-or-volume'"),
    ("length(text) > 900", "'long-front'"),
    (has(_compact_sql("bare"), r"(?:^|⏎)\s*[-•]\s[^\n]*⏎\s*[-•]\s"), "'laundry-list'"),
    (f"len({_SHORT}) > 0 AND extra = ''", "'abbrev-no-extra'"),
    (f"{sql_strip('extra')} = ''", "'empty-extra'"),
]
_LEDGER = f"""parts AS (SELECT nid, deck, text, extra, {sub('text', CLOZE, chr(92) + '2')} AS bare,
    {find('text', CLOZE, 2)} AS answers,
    len(list_distinct(list_transform({find('text', CLOZE, 1)}, lambda o: o::INT))) AS n_ids
  FROM marked),
flags AS (SELECT nid, deck, text, extra, list_filter([
    {', '.join(f'CASE WHEN {c} THEN {n} END' for c, n in _FLAGS)}],
    lambda f: f IS NOT NULL) AS flags FROM parts)"""


@query("structural_flags", f"""WITH {MARKED}, {_LEDGER}
SELECT nid, array_to_string(flags, ',') AS flags, len(flags)::BIGINT AS n_flags,
       length(text)::BIGINT AS len_text, length(extra)::BIGINT AS len_extra FROM flags""",
       bench=True)
def structural_flags(spark, d):
    return R.ledger(marked_notes(spark, d)).select(
        "nid", F.array_join("flags", ",").alias("flags"),
        F.col("n_flags").cast("bigint").alias("n_flags"),
        F.col("len_text").cast("bigint").alias("len_text"),
        F.col("len_extra").cast("bigint").alias("len_extra"))


@query("flag_histogram", f"""WITH {MARKED}, {_LEDGER}
SELECT flag, count(*)::BIGINT AS n FROM (SELECT unnest(flags) AS flag FROM flags) GROUP BY flag""")
def flag_histogram(spark, d):
    return P.flag_histogram(R.ledger(marked_notes(spark, d)))


@query("multi_cloze_rate", f"""WITH {MARKED}, {_LEDGER}
SELECT count(*)::BIGINT AS notes, count(*) FILTER (flags[1] LIKE 'multi-cloze%')::BIGINT AS multi,
  round(avg(CASE WHEN flags[1] LIKE 'multi-cloze%' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate
FROM flags""")
def multi_cloze_rate(spark, d):
    return P.multi_cloze_rate(R.ledger(marked_notes(spark, d))).withColumn(
        "rate", F.round("rate", 6))


@query("ledger_order", f"""WITH {MARKED}, {_LEDGER}
SELECT nid, len(flags)::BIGINT AS n_flags,
  row_number() OVER (ORDER BY len(flags) DESC, nid)::BIGINT AS place FROM flags""")
def ledger_order(spark, d):
    return O.ledger_places(R.ledger(marked_notes(spark, d)), "place").select(
        "nid", F.col("n_flags").cast("bigint").alias("n_flags"), "place")


@query("write_ledger", f"""WITH {MARKED}, {_LEDGER}
SELECT nid, array_to_string(flags, ',') AS flags FROM flags""")
def write_ledger(spark, d):
    from corpusgate.session import scratch_path
    from corpusgate.sources import sinks
    path = scratch_path(spark, "ledger")
    sinks.write_ledger(R.ledger(marked_notes(spark, d)), path)
    return sinks.read_ledger(spark, path).select("nid", F.array_join("flags", ",").alias("flags"))


# ---- rules that need domain wording: sentences written from table columns -----------------------

_SPOKEN = """spoken AS (SELECT p_partkey AS nid, p_brand AS deck,
  CASE p_partkey % 9
    WHEN 0 THEN 'According to Acme, the ' || p_name || ' is small.'
    WHEN 1 THEN 'The module states that the ' || p_name || ' is ' || p_size || '.'
    WHEN 2 THEN 'The iliac acme of the ' || p_name || ' is here.'
    WHEN 3 THEN 'Advance the ' || p_name || ' medially to ' || p_size || ' cm.'
    WHEN 4 THEN 'Advanced medially: exactly ' || p_size || ' cm of ' || p_name || '.'
    WHEN 5 THEN 'Give 0.' || p_size || ' mg/kg of ' || p_name || '.'
    WHEN 6 THEN 'Give 0.' || p_size || ' mL/kg of bupivacaine, as taught in the lecture.'
    WHEN 7 THEN 'It is always ' || p_name || ', whereas this one is shorter.'
    ELSE 'Plain ' || p_name || ' text.' END AS text,
  CASE p_partkey % 4 WHEN 0 THEN 'The textbook''s chapter on ' || p_type || ' and Acme parts.'
    WHEN 1 THEN 'It is never more than ' || p_size || '.' ELSE '' END AS extra,
  CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_type END AS textbook,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'tag' END AS tags FROM part)"""


def spoken_notes(spark, d):
    """Notes whose wording is written around the columns of each part."""
    key, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    k, x = F.pmod(key, F.lit(9)), F.pmod(key, F.lit(4))

    def say(*bits):
        return F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])

    text = (F.when(k == 0, say("According to Acme, the ", name, " is small."))
            .when(k == 1, say("The module states that the ", name, " is ", size, "."))
            .when(k == 2, say("The iliac acme of the ", name, " is here."))
            .when(k == 3, say("Advance the ", name, " medially to ", size, " cm."))
            .when(k == 4, say("Advanced medially: exactly ", size, " cm of ", name, "."))
            .when(k == 5, say("Give 0.", size, " mg/kg of ", name, "."))
            .when(k == 6, say("Give 0.", size, " mL/kg of bupivacaine, as taught in the lecture."))
            .when(k == 7, say("It is always ", name, ", whereas this one is shorter."))
            .otherwise(say("Plain ", name, " text.")))
    extra = (F.when(x == 0, say("The textbook's chapter on ", F.col("p_type"), " and Acme parts."))
             .when(x == 1, say("It is never more than ", size, ".")).otherwise(""))
    return spread_table(spark, d, "part").select(
        key.alias("nid"), F.col("p_brand").alias("deck"), text.alias("text"),
        extra.alias("extra"),
        F.when(F.pmod(key, F.lit(3)) == 0, "  ").otherwise(F.col("p_type")).alias("textbook"),
        F.when(F.pmod(key, F.lit(5)) == 0, "").otherwise("tag").alias("tags"))


_ATTRIBUTED = f"""hits AS (
  SELECT nid, 'Text' AS field, unnest({find('text', R.ATTRIBUTION)}) AS hit FROM spoken
  UNION ALL SELECT nid, 'Extra', unnest({find('extra', R.ATTRIBUTION)}) FROM spoken
  UNION ALL SELECT nid, 'Text', '...' || trim(left(text, 47)) || '...' FROM spoken
    WHERE nid % 9 = 0
  UNION ALL SELECT nid, 'Extra', '...' || trim(substr(extra, position('Acme' IN extra) - 30)) || '...'
    FROM spoken WHERE nid % 4 = 0)"""


@query("source_attribution", f"WITH {_SPOKEN}, {_ATTRIBUTED} SELECT nid, field, hit FROM hits")
def source_attribution(spark, d):
    return R.attribution_hits(spoken_notes(spark, d), "Acme")


@query("procedural_notes", f"""WITH {_SPOKEN}
SELECT nid FROM spoken WHERE nid % 9 = 4 OR (nid % 9 = 3 AND
  {has('text', '(?i)' + chr(92) + 'b(?:' + '|'.join(V.PROCEDURE_VERBS) + ')' + chr(92) + 'b')})""")
def procedural_notes(spark, d):
    return spoken_notes(spark, d).where(R.is_procedural()).select("nid")


@query("dose_without_drug", f"WITH {_SPOKEN} SELECT nid FROM spoken WHERE nid % 9 = 5")
def dose_without_drug(spark, d):
    return spoken_notes(spark, d).where(R.dose_without_drug()).select("nid")


@query("certainty_on_measure", f"""WITH {_SPOKEN}
SELECT nid, 'Text' AS field, text AS hit FROM spoken WHERE nid % 9 = 4
UNION ALL SELECT nid, 'Extra', extra FROM spoken WHERE nid % 4 = 1""")
def certainty_on_measure(spark, d):
    return R.certainty_hits(spoken_notes(spark, d))


@query("provenance_blank", f"""WITH {_SPOKEN}
SELECT nid, 'no textbook' AS rule FROM spoken WHERE nid % 3 = 0
UNION ALL SELECT nid, 'no tags' FROM spoken WHERE nid % 5 = 0""")
def provenance_blank(spark, d):
    return spoken_notes(spark, d).select("nid", F.explode(R.provenance_blank()).alias("rule"))


@query("provenance_coverage", f"""WITH {_SPOKEN}
SELECT count(*)::BIGINT AS total, count(*) FILTER (trim(textbook) = '')::BIGINT AS blank_textbook,
       count(*) FILTER (trim(tags) = '')::BIGINT AS blank_tags FROM spoken""")
def provenance_coverage(spark, d):
    from corpusgate.operators.relate import blank_fields
    return blank_fields(spoken_notes(spark, d), "textbook", "tags")


@query("cross_references", f"""WITH {_SPOKEN}
SELECT nid FROM spoken WHERE nid % 9 = 7 OR nid % 4 = 1""")
def cross_references(spark, d):
    both = F.concat_ws(" ", "text", "extra")
    return spoken_notes(spark, d).where(R.is_cross_reference(both)).select("nid")


_VIOLATIONS = f"""{_SPOKEN}, {_ATTRIBUTED}, found AS (
  SELECT nid, deck, 'B' AS section, 'gate' AS severity, 'no cloze' AS rule FROM spoken
  UNION ALL SELECT nid, deck, 'B', 'gate', 'empty Extra' FROM spoken WHERE trim(extra) = ''
  UNION ALL SELECT nid, deck, 'B', 'gate',
    'source named in ' || lower(field) FROM hits JOIN spoken USING (nid)
  UNION ALL SELECT nid, deck, 'I', 'soft', 'procedure direction' FROM spoken WHERE nid % 9 = 4
  UNION ALL SELECT nid, deck, 'I', 'gate', 'dose without drug' FROM spoken WHERE nid % 9 = 5
  UNION ALL SELECT nid, deck, 'J', 'soft', 'certainty word in text' FROM spoken WHERE nid % 9 = 4
  UNION ALL SELECT nid, deck, 'J', 'soft', 'certainty word in extra' FROM spoken WHERE nid % 4 = 1
  UNION ALL SELECT nid, deck, 'K', 'soft', 'no textbook' FROM spoken WHERE nid % 3 = 0
  UNION ALL SELECT nid, deck, 'K', 'soft', 'no tags' FROM spoken WHERE nid % 5 = 0)"""


@query("violations", f"""WITH {_VIOLATIONS}
SELECT deck, nid, section, severity, rule FROM found
UNION ALL SELECT deck, nid, 'I', 'soft', 'procedure direction' FROM spoken WHERE nid % 9 = 3
  AND {has('text', '(?i)' + chr(92) + 'b(?:' + '|'.join(V.PROCEDURE_VERBS) + ')' + chr(92) + 'b')}""")
def violations(spark, d):
    return P.violations(spoken_notes(spark, d), "Acme")


@query("violation_rollup", f"""WITH {_VIOLATIONS}, every AS (SELECT deck, section, severity FROM found
  UNION ALL SELECT deck, 'I', 'soft' FROM spoken WHERE nid % 9 = 3 AND
  {has('text', '(?i)' + chr(92) + 'b(?:' + '|'.join(V.PROCEDURE_VERBS) + ')' + chr(92) + 'b')})
SELECT coalesce(deck, '(all)') AS deck, coalesce(section, '(all)') AS section,
  count(*)::BIGINT AS n, count(*) FILTER (severity = 'gate')::BIGINT AS n_gating
FROM every GROUP BY ROLLUP (deck, section)""", bench=True)
def violation_rollup(spark, d):
    rolled = P.violation_rollup(P.violations(spoken_notes(spark, d), "Acme"))
    return rolled.select(F.coalesce("deck", F.lit("(all)")).alias("deck"),
                         F.coalesce("section", F.lit("(all)")).alias("section"), "n", "n_gating")


@query("capped_groups", f"""WITH {MARKED}, v AS ({_rules_sql(True)}), r AS (
  SELECT rule, nid, row_number() OVER (PARTITION BY rule ORDER BY nid) AS place,
         count(*) OVER (PARTITION BY rule) AS size FROM v)
SELECT rule, nid, place::BIGINT AS place, greatest(size - 12, 0)::BIGINT AS more
FROM r WHERE place <= 12""")
def capped_groups(spark, d):
    found = marked_notes(spark, d).select("nid", F.explode(R.house_rules(audit=True)).alias("rule"))
    return O.capped_groups(found, "rule", ["nid"], 12).select(
        "rule", "nid", F.col("place").cast("bigint").alias("place"), "more")


@query("supported_sources", """
SELECT ext, count(*)::BIGINT AS n FROM (SELECT CASE page_id % 5 WHEN 0 THEN 'PDF' WHEN 1 THEN 'exe'
  WHEN 2 THEN 'md' WHEN 3 THEN 'zip' ELSE 'Jpeg' END AS ext FROM pages)
WHERE lower(ext) IN ('pdf', 'md', 'jpeg') GROUP BY ext""")
def supported_sources(spark, d):
    k = F.pmod("page_id", F.lit(5))
    ext = (F.when(k == 0, "PDF").when(k == 1, "exe").when(k == 2, "md").when(k == 3, "zip")
           .otherwise("Jpeg"))
    files = table(spark, d, "pages").select(ext.alias("ext")).where(R.supported_source("ext"))
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("n"))


@query("supported_folders", """
SELECT DISTINCT split_part(url, '/', 3) AS folder FROM pages WHERE page_id % 5 IN (0, 2)""")
def supported_folders(spark, d):
    k = F.pmod("page_id", F.lit(5))
    ext = F.when(k == 0, "pdf").when(k == 2, "md").otherwise("bin")
    files = table(spark, d, "pages").select(
        F.split_part("url", F.lit("/"), F.lit(3)).alias("folder"), ext.alias("extension"))
    return R.supported_folders(files)


@query("validate_registry", """
WITH m AS (SELECT c_mktsegment || (c_custkey % 700) AS name, c_custkey % 40 - 1 AS cards_before
  FROM customer)
SELECT 'duplicate name' AS problem, name AS item FROM m GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'negative count', name FROM m WHERE cards_before < 0""")
def validate_registry(spark, d):
    modules = table(spark, d, "customer").select(
        F.concat("c_mktsegment", F.pmod("c_custkey", F.lit(700))).alias("name"),
        (F.pmod("c_custkey", F.lit(40)) - 1).alias("cards_before"), F.lit(0).alias("cards_after"))
    return R.validate_registry(modules)

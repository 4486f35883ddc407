"""Queries over claims: extraction, collisions, consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgate.functions import facts as A
from corpusgate.functions import subjects as S
from corpusgate.operators import claims as C
from corpusgate.operators import relate as J
from corpusgate.operators import rules as R
from corpusgate.plans.base import query, spread_table, table
from corpusgate.session import materialize, scratch_path
from corpusgate.sources import sinks

# ---- a claims table read off the line items -------------------------------------------------------

_CLAIMS = """claims AS (SELECT l_returnflag AS deck, l_orderkey AS nid,
  CASE l_linestatus WHEN 'O' THEN 'Text' ELSE 'Extra' END AS field,
  'part ' || l_partkey || CASE WHEN l_partkey % 3 = 0 THEN '' ELSE ' of ' || l_suppkey END AS subject,
  CASE l_linenumber % 3 WHEN 0 THEN 'tax[percent]' WHEN 1 THEN 'count[item]' ELSE 'spinal-level' END
    AS attribute, round(l_tax * 100)::INT::VARCHAR AS value, '%' AS unit,
  round(l_tax * 100)::DOUBLE AS lo, round(l_tax * 100)::DOUBLE + l_linenumber % 2 AS hi,
  CASE WHEN l_linenumber = 7 THEN 'categorical' ELSE 'numeric' END AS kind,
  l_discount > 0.08 AS xref FROM lineitem)"""


def item_claims(spark, d, *more):
    part, supp, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    tax = F.round(F.col("l_tax") * 100)
    third = F.pmod(ln, F.lit(3))
    subject = F.concat(F.lit("part "), part, F.when(F.pmod(part, F.lit(3)) == 0, "").otherwise(
        F.concat(F.lit(" of "), supp)))
    attribute = (F.when(third == 0, "tax[percent]").when(third == 1, "count[item]")
                 .otherwise("spinal-level"))
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("deck"), F.col("l_orderkey").alias("nid"),
        F.when(F.col("l_linestatus") == "O", "Text").otherwise("Extra").alias("field"),
        subject.alias("subject"), attribute.alias("attribute"),
        tax.cast("int").cast("string").alias("value"), F.lit("%").alias("unit"),
        F.struct(tax.alias("lo"), (tax + F.pmod(ln, F.lit(2))).alias("hi")).alias("span"),
        F.when(ln == 7, "categorical").otherwise("numeric").alias("kind"),
        (F.col("l_discount") > 0.08).alias("xref"), *more)


_GROUPS = f"""{_CLAIMS}, g AS (SELECT kind, subject, attribute, count(*)::BIGINT AS n_claims,
  count(DISTINCT value)::BIGINT AS n_values, count(DISTINCT deck)::BIGINT AS n_decks,
  max(lo) > min(hi) AS disjoint FROM claims GROUP BY ALL
  HAVING count(DISTINCT value) >= 2 AND count(DISTINCT (nid, field)) >= 2)"""


@query("collisions_numeric", f"""WITH {_GROUPS}
SELECT subject, attribute, n_claims, n_values, disjoint,
  CASE WHEN attribute = 'tax[percent]' THEN 'gate' ELSE 'soft' END AS severity
FROM g WHERE kind = 'numeric'""", bench=True)
def collisions_numeric(spark, d):
    found = C.measured_vs_soft(C.collisions(item_claims(spark, d), "numeric"))
    return found.select("subject", "attribute", "n_claims", "n_values", "disjoint", "severity")


@query("collisions_categorical", f"""WITH {_GROUPS}
SELECT subject, attribute, n_claims, n_values FROM g WHERE kind = 'categorical'""")
def collisions_categorical(spark, d):
    return C.collisions(item_claims(spark, d), "categorical").select(
        "subject", "attribute", "n_claims", "n_values")


@query("collisions_cross_deck", f"""WITH {_GROUPS}
SELECT subject, attribute, kind, n_decks, n_values FROM g WHERE n_decks >= 2""", bench=True)
def collisions_cross_deck(spark, d):
    return C.collisions(item_claims(spark, d), cross_deck=True).select(
        "subject", "attribute", "kind", "n_decks", "n_values")


@query("collision_members", f"""WITH {_GROUPS}
SELECT DISTINCT subject, attribute, value, nid, field FROM claims
WHERE (subject, attribute) IN (SELECT (subject, attribute) FROM g WHERE kind = 'numeric'
  AND attribute = 'tax[percent]')""")
def collision_members(spark, d):
    claims = item_claims(spark, d)
    found = C.collisions(claims, "numeric").where(R.is_measured())
    return C.collision_members(claims, found).drop("unit")


@query("new_collisions", f"""WITH {_GROUPS}
SELECT subject, attribute FROM g WHERE kind = 'numeric' AND NOT (n_decks = 1)""")
def new_collisions(spark, d):
    # Read twice: as what there is and as what was known.
    found = materialize(C.collisions(item_claims(spark, d), "numeric"), "collisions")
    return J.new_collisions(found, found.where("n_decks = 1")).select("subject", "attribute")


@query("write_baseline", f"WITH {_GROUPS} SELECT DISTINCT subject, attribute FROM g WHERE kind = 'numeric'")
def write_baseline(spark, d):
    path = scratch_path(spark, "baseline")
    sinks.write_baseline(C.collisions(item_claims(spark, d), "numeric"), path)
    return sinks.read_baseline(spark, path)


@query("write_claims", f"WITH {_CLAIMS} SELECT kind, count(*)::BIGINT AS n FROM claims GROUP BY kind")
def write_claims(spark, d):
    path = scratch_path(spark, "claims")
    sinks.write_claims(item_claims(spark, d), path)
    saved = spark.read.parquet(path)
    return saved.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("front_back_conflict", f"""WITH {_CLAIMS}, c AS (SELECT nid, attribute, value, field FROM claims
  WHERE kind = 'numeric' AND NOT xref), s AS (SELECT nid, attribute,
  list_sort(list_distinct(list(value) FILTER (field = 'Text'))) AS t,
  list_sort(list_distinct(list(value) FILTER (field = 'Extra'))) AS e FROM c GROUP BY ALL)
SELECT nid, attribute, array_to_string(t, ',') AS text_values, array_to_string(e, ',') AS extra_values,
  attribute = 'tax[percent]' AS measured FROM s
WHERE len(t) > 0 AND len(e) > 0 AND len(list_intersect(t, e)) = 0""", bench=True)
def front_back_conflict(spark, d):
    claims = item_claims(spark, d).withColumn("subject", F.lit("order"))
    found = C.front_back_conflict(claims)
    return found.select("nid", "attribute", F.array_join("text_values", ",").alias("text_values"),
                        F.array_join("extra_values", ",").alias("extra_values"), "measured")


@query("verification_buckets", f"""WITH {_CLAIMS}
SELECT split_part(attribute, '[', 1) AS head, count(DISTINCT (subject, value || ' ' || unit, nid))
  ::BIGINT AS n FROM claims WHERE attribute <> 'tax[percent]' GROUP BY 1""")
def verification_buckets(spark, d):
    return C.verification_buckets(item_claims(spark, d))


@query("checkable_claims", f"""WITH {_CLAIMS}
SELECT attribute, count(*)::BIGINT AS n FROM claims WHERE attribute <> 'tax[percent]' GROUP BY 1""")
def checkable_claims(spark, d):
    rows = item_claims(spark, d).where(R.is_checkable())
    return rows.groupBy("attribute").agg(F.count(F.lit(1)).alias("n"))


# ---- claims extracted from sentences that are written from the orders ------------------------------

_ORDERS = "SELECT o_orderkey AS nid, o_orderkey % 6 AS k, o_custkey % 7 AS a, o_custkey AS c FROM orders"


def order_notes(spark, d):
    """Notes whose claims can be told from the order's columns."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    k, a = F.pmod(key, F.lit(6)), F.pmod(cust, F.lit(7))

    def say(*bits):
        return F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])

    depth = say("The transverse process is contacted at a depth of {{c1::", a, " to ", a + 3, "}} cm in the ")
    text = (F.when(k == 0, say(depth, "thoracic region."))
            .when(k == 1, say(depth, "lumbar region."))
            .when((k == 2) & (F.pmod(cust, F.lit(5)) == 0), say(
                "It is given at 0.", a, " mg/kg for rapid intubation."))
            .when(k == 2, say("Succinylcholine is given at 0.", a, " mg/kg for rapid intubation."))
            .when(k == 3, say("The lateral pectoral nerve arises at C", a + 1, " to C8."))
            .when(k == 4, say("The sheath has ", a, " layers near the vagus nerve."))
            .otherwise("For a femoral block the patient is supine."))
    extra = (F.when(k == 3, "It is always C5.")
             .when(k == 5, say("A ", a, " cm needle is used.")).otherwise(" "))
    return spread_table(spark, d, "orders").select(
        F.concat(F.lit("d"), F.pmod(key, F.lit(9))).alias("deck"), key.alias("nid"),
        text.alias("text"), extra.alias("extra"))


_EXTRACTED = f"""extracted AS (
  SELECT nid, 'Text' AS field, CASE k WHEN 0 THEN 'thoracic' ELSE 'lumbar' END || ' transverse process'
      AS subject, 'depth-to-landmark[length]' AS attribute, a || '-' || (a + 3) AS value, 'cm' AS unit,
      a * 10.0::DOUBLE AS lo, (a + 3) * 10.0::DOUBLE AS hi, 'numeric' AS kind FROM ({_ORDERS}) WHERE k IN (0, 1)
  UNION ALL SELECT nid, 'Text', CASE WHEN c % 5 = 0 THEN 'kg rapid intubation' ELSE 'succinylcholine' END,
      'dose-mass[dose-mass]', CASE a WHEN 0 THEN '0' ELSE '0.' || a END, 'mg/kg', NULL, NULL, 'numeric'
      FROM ({_ORDERS}) WHERE k = 2
  UNION ALL SELECT nid, 'Text', 'lateral pectoral nerve', 'spinal-level', 'C' || (a + 1) || '-C8', '',
      NULL, NULL, 'numeric' FROM ({_ORDERS}) WHERE k = 3
  UNION ALL SELECT nid, 'Extra', 'lateral pectoral nerve', 'spinal-level', 'C5', '', NULL, NULL, 'numeric'
      FROM ({_ORDERS}) WHERE k = 3
  UNION ALL SELECT nid, 'Text', 'vagus nerve', 'count[layer]', a::VARCHAR, '', NULL, NULL, 'numeric'
      FROM ({_ORDERS}) WHERE k = 4
  UNION ALL SELECT nid, 'Text', 'femoral block', 'body-position', 'supine', '', NULL, NULL, 'categorical'
      FROM ({_ORDERS}) WHERE k = 5
  UNION ALL SELECT nid, 'Extra', 'femoral block', 'needle-length[length]', a::VARCHAR, 'cm', a * 10.0,
      a * 10.0, 'numeric' FROM ({_ORDERS}) WHERE k = 5)"""


@query("extract_claims", f"""WITH {_EXTRACTED}
SELECT nid, field, subject, attribute, value, unit, lo, hi, kind, false AS xref FROM extracted""", bench=True)
def extract_claims(spark, d):
    found = C.extract_claims(order_notes(spark, d))
    return found.select("nid", "field", "subject", "attribute", "value", "unit",
                        F.col("span.lo").alias("lo"), F.col("span.hi").alias("hi"), "kind", "xref")


@query("landmark_claims", f"""
WITH o AS (SELECT nid, k, c % 5 + 1 AS a FROM ({_ORDERS}))
SELECT nid, 'l' || a || ' transverse process' AS subject, 'identity' AS attribute, 'L' || a AS value
FROM o WHERE k < 2
UNION ALL SELECT nid, 'transverse process', 'spinal-level', 'L2' FROM o WHERE k = 1 AND a <> 2
UNION ALL SELECT nid, CASE k WHEN 2 THEN 'lumbar' ELSE 'thoracic' END || ' transverse process',
  'depth-to-landmark[length]', a::VARCHAR FROM o WHERE k IN (2, 5)
UNION ALL SELECT nid, 'transverse process', 'depth-to-landmark[length]', a::VARCHAR FROM o WHERE k = 3
UNION ALL SELECT nid, 'femoral nerve', 'volume[volume]', (a * 5)::VARCHAR FROM o WHERE k = 4""")
def landmark_claims(spark, d):
    """Levels that name a landmark, two regions in a sentence, an attribute claimed twice.

    A level that names the landmark anywhere in a sentence is no claim of its own there.
    """
    k, a = F.pmod(F.col("o_orderkey"), F.lit(6)), F.pmod(F.col("o_custkey"), F.lit(5)) + 1

    def say(*bits):
        return F.concat(*[F.lit(b) if isinstance(b, str) else b for b in bits])

    contact = say("The needle contacts the L", a, " transverse process")
    deep = say("region the transverse process is contacted at a depth of ", a, " cm.")
    text = (F.when(k == 0, say(contact, "."))
            .when(k == 1, say(contact, " and then the L2 level of the transverse process."))
            .when(k == 2, say("In the thoracic and lumbar ", deep))
            .when(k == 3, say("The transverse process is at a depth of ", a,
                              " cm and the transverse process is at a depth of ", a + 2, " cm."))
            .when(k == 4, say("A volume of ", a * 5, " mL of local anesthetic is injected for the "
                              "femoral nerve block."))
            .otherwise(say("In the lumbar and thoracic ", deep)))
    notes = spread_table(spark, d, "orders").select(
        F.lit("d").alias("deck"), F.col("o_orderkey").alias("nid"), text.alias("text"),
        F.lit("").alias("extra"))
    return C.extract_claims(notes).select("nid", "subject", "attribute", "value")


@query("note_topics", f"""
SELECT nid, CASE k WHEN 2 THEN 'kg rapid intubation' WHEN 3 THEN 'lateral pectoral nerve'
  WHEN 4 THEN 'vagus nerve' WHEN 5 THEN 'femoral block' ELSE 'transverse process' END AS topic
FROM ({_ORDERS})""")
def note_topics(spark, d):
    notes = order_notes(spark, d)
    cands = C.sentence_subjects(C.note_sentences(notes).where("field = 'Text'"),
                                C.build_lexicon(notes))
    return C.note_topics(cands)


@query("consistency_sections", f"""WITH {_EXTRACTED}, g AS (SELECT subject, attribute, kind FROM extracted
  GROUP BY ALL HAVING count(DISTINCT value) >= 2 AND count(DISTINCT (nid, field)) >= 2)
SELECT CASE WHEN attribute LIKE '%[%' AND attribute NOT LIKE 'count%' THEN 'G1a' ELSE 'G1b' END AS section,
  count(*)::BIGINT AS n FROM g WHERE kind = 'numeric' GROUP BY 1
UNION ALL SELECT 'G2', count(*)::BIGINT FROM ({_ORDERS}) WHERE k = 3
UNION ALL SELECT 'H', count(*)::BIGINT FROM extracted WHERE kind = 'numeric'
UNION ALL SELECT 'I', count(*)::BIGINT FROM ({_ORDERS}) WHERE k = 2 AND c % 5 = 0
UNION ALL SELECT 'J', count(*)::BIGINT FROM ({_ORDERS}) WHERE k = 3""")
def consistency_sections(spark, d):
    notes = order_notes(spark, d)
    claims = materialize(C.extract_claims(notes), "claims")
    report = C.consistency_report(notes, claims)
    return report.groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query("consistency_verdict", f"""WITH {_EXTRACTED}, g AS (SELECT subject, attribute FROM extracted
  WHERE kind = 'numeric' AND attribute LIKE '%[%' AND attribute NOT LIKE 'count%' GROUP BY ALL
  HAVING count(DISTINCT value) >= 2 AND count(DISTINCT (nid, field)) >= 2),
f AS (SELECT 'G1a' AS section FROM g UNION SELECT 'I' FROM ({_ORDERS}) WHERE k = 2 AND c % 5 = 0)
SELECT count(*)::BIGINT AS failing, count(*) = 0 AS pass FROM f""")
def consistency_verdict(spark, d):
    notes = order_notes(spark, d)
    claims = materialize(C.extract_claims(notes), "claims")
    return C.consistency_verdict(C.consistency_report(notes, claims))


# ---- the lexicon ------------------------------------------------------------------------------------

_LEX = """n AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 2) END
  || ' nerve' AS raw, count(*)::BIGINT AS n FROM part GROUP BY 1)"""


@query("subject_lexicon", f"""WITH {_LEX}
SELECT 'the ' || raw AS phrase, n, CASE WHEN len(string_split(raw, ' ')) = 3 AND
  array_to_string(string_split(raw, ' ')[2:], ' ') IN (SELECT raw FROM n)
  THEN array_to_string(string_split(raw, ' ')[2:], ' ') ELSE raw END AS subject FROM n""")
def subject_lexicon(spark, d):
    even = F.pmod("p_partkey", F.lit(2)) == 0
    name = F.when(even, F.col("p_name")).otherwise(F.split_part("p_name", F.lit(" "), F.lit(2)))
    notes = table(spark, d, "part").select(F.col("p_partkey").alias("nid"), F.concat(
        F.lit("The "), name, F.lit(" nerve is here.")).alias("text"), F.lit("").alias("extra"))
    return C.build_lexicon(notes).subjects.select("phrase", "n", "subject")


@query("norm_subjects", """
SELECT p_partkey AS nid, CASE p_partkey % 3 WHEN 0 THEN 'lateral ' || p_name || ' nerve'
  WHEN 1 THEN p_name || ' block' ELSE p_name || ' 5 artery' END AS subject FROM part""")
def norm_subjects(spark, d):
    k = F.pmod("p_partkey", F.lit(3))
    phrase = (F.when(k == 0, F.concat(F.lit("Contact the lateral "), "p_name", F.lit(" Nerves")))
              .when(k == 1, F.concat(F.lit("a landmark lateral "), "p_name", F.lit(" block")))
              .otherwise(F.concat(F.lit("the "), "p_name", F.lit(" V arteries"))))
    return table(spark, d, "part").select(F.col("p_partkey").alias("nid"),
                                          S.norm_subject(phrase).alias("subject"))


@query("attribute_cues", """
SELECT l_orderkey AS nid, CASE l_linenumber WHEN 1 THEN 'total' WHEN 2 THEN 'depth-to-landmark'
  WHEN 3 THEN 'volume' WHEN 4 THEN 'needle-length' WHEN 5 THEN 'advancement' WHEN 6
  THEN 'volume-per-level' END AS attribute FROM lineitem""")
def attribute_cues(spark, d):
    ln = F.col("l_linenumber")
    text = (F.when(ln == 1, "a total of 5 mL is injected").when(ln == 2, "contacted at a depth of 5 cm")
            .when(ln == 3, "inject 5 mL").when(ln == 4, "the needle is 5 cm")
            .when(ln == 5, "advanced 5 mm past the bone").when(ln == 6, "5 mL per level")
            .otherwise("it was 5 cm wide"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("nid"), text.alias("t"))
    return rows.select("nid", A.attribute_for("t", F.instr("t", "5") - 1).alias("attribute"))


@query("nearest_drug", """
SELECT l_orderkey AS nid, CASE WHEN l_linenumber % 2 = 0 THEN 'propofol' ELSE 'ketamine' END AS drug
FROM lineitem""")
def nearest_drug(spark, d):
    even = F.pmod("l_linenumber", F.lit(2)) == 0
    text = F.when(even, F.concat(F.lit("Ketamine, then propofol "), "l_suppkey", F.lit(" mg."))
                  ).otherwise(F.concat(F.lit("Ketamine "), "l_suppkey", F.lit(" mg, then propofol.")))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("nid"), text.alias("t"))
    at = F.regexp_instr("t", F.lit("[0-9]")) - 1
    return rows.select("nid", C.nearest_drug(F.col("t"), at).alias("drug"))

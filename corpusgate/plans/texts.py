"""Queries over text functions and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgate.functions import facts as A
from corpusgate.functions import sql as Q
from corpusgate.functions import subjects as S
from corpusgate.functions import text as T
from corpusgate.functions import values as V
from corpusgate.functions.base import WS
from corpusgate.plans.base import (MARKED, ascii_words, find, has, lit, marked_notes, query,
                                   sql_plain, sql_sort_field, sql_stop, sql_strip, sub, table,
                                   wide_table)


def _digest(df, key, value):
    """Key, length and digest of a text column: full check, small result."""
    return df.select(key, value.alias("_v")).select(
        key, F.length("_v").cast("bigint").alias("n_chars"), F.md5("_v").alias("digest"))


def _digest_sql(source: str, key: str, expr: str, prefix: str = "") -> str:
    return (f"{prefix}SELECT {key}, length(v)::BIGINT AS n_chars, md5(v) AS digest "
            f"FROM (SELECT {key}, {expr} AS v FROM {source})")


@query("strip_tags", _digest_sql("pages", "page_id", sub("html", T.TAG, " ")))
def strip_tags(spark, d):
    return _digest(table(spark, d, "pages"), "page_id", T.strip_tags("html", " "))


@query("plain_text", _digest_sql("pages", "page_id", sql_plain("html")), bench=True)
def plain_text(spark, d):
    return _digest(wide_table(spark, d, "pages"), "page_id", T.plain("html"))


@query("plain_text_of_cloze", _digest_sql("marked", "nid", sql_plain("text"),
                                          f"WITH {MARKED} "))
def plain_text_of_cloze(spark, d):
    return _digest(marked_notes(spark, d), "nid", T.plain("text"))


def _compact_sql(expr: str) -> str:
    out = f"replace({expr}, '&nbsp;', ' ')"
    for pattern, replacement in ((T.PRESENTATION, ""), (T.LINE_BREAK, "⏎"), (T.LINE_END, "⏎"),
                                 (T.LIST_ITEM, "⏎- "), (T.LAYOUT, ""), (T.TAG, ""),
                                 (r"[ \t]+", " "), (rf"(?:⏎{WS}*){{3,}}", "⏎⏎")):
        out = sub(out, pattern, replacement)
    return sql_strip(out)


@query("sql_plain_text", _digest_sql("pages", "page_id", sql_plain("html")))
def sql_plain_text(spark, d):
    """Written in SQL only, with the registered function."""
    Q.register(spark)
    return spark.sql("""SELECT page_id, length(v) :: BIGINT AS n_chars, md5(v) AS digest
        FROM (SELECT page_id, plain_text(html) AS v FROM {pages})""", pages=table(spark, d, "pages"))


@query("sql_checksums", f"""
SELECT doc_id, ('0x' || substr(sha1({sql_sort_field('text')}), 1, 8))::BIGINT AS csum,
  md5({sql_sort_field('text')}) AS digest, {sub('text', T.ENTITY)} LIKE '%;%' AS semicolon FROM documents""")
def sql_checksums(spark, d):
    Q.register(spark)
    return spark.sql("""SELECT doc_id, checksum32(text) AS csum, md5(sort_field(text)) AS digest,
        has_semicolon(text) AS semicolon FROM {docs}""", docs=table(spark, d, "documents"))


@query("sql_same_names", """
SELECT c_custkey, s_suppkey FROM customer JOIN supplier
  ON lower(split_part(c_name, '#', 2)) = lower(split_part(s_name, '#', 2))""")
def sql_same_names(spark, d):
    """Names that differ in case only; the comparison is an equi-join key."""
    Q.register(spark)
    return spark.sql("""SELECT c_custkey, s_suppkey FROM {c} JOIN {s}
        ON same_name(concat('No ', split_part(c_name, '#', 2)), concat('nO ', split_part(s_name, '#', 2)))""",
                     c=table(spark, d, "customer"), s=table(spark, d, "supplier"))


@query("compact_text", _digest_sql("pages", "page_id", _compact_sql("html")))
def compact_text(spark, d):
    return _digest(wide_table(spark, d, "pages"), "page_id", T.compact("html"))


@query("digest_ratio", f"""
SELECT count(*)::BIGINT AS notes, sum(length(html))::BIGINT AS raw_chars,
       sum(length({_compact_sql('html')}))::BIGINT AS compact_chars,
       (sum(length(html))::BIGINT // 4)::BIGINT AS raw_tokens,
       (sum(length({_compact_sql('html')}))::BIGINT // 4)::BIGINT AS compact_tokens
FROM pages""", bench=True)
def digest_ratio(spark, d):
    from corpusgate.operators.report import digest_ratio as ratio
    pages = wide_table(spark, d, "pages").select(F.col("page_id").alias("nid"),
                                            F.col("html").alias("text"),
                                            F.lit("").alias("extra"))
    return ratio(pages)


@query("sort_field", _digest_sql("documents", "doc_id", sql_sort_field("text")))
def sort_field(spark, d):
    return _digest(table(spark, d, "documents"), "doc_id", T.sort_field("text"))


@query("checksum_sort_field", f"""
SELECT doc_id, ('0x' || substr(sha1({sql_sort_field('text')}), 1, 8))::BIGINT AS csum
FROM documents""", bench=True)
def checksum_sort_field(spark, d):
    return table(spark, d, "documents").select("doc_id", T.checksum32("text").alias("csum"))


_SENTENCE_LIST = (f"list_filter(list_transform(string_split("
                  + sub(sub("text", rf"([.!?]){WS}+", r"\1" + "\x02"),
                        rf"{WS}+\.(?:{WS}|\x02)+", "\x02")
                  + ", chr(2)), lambda s: " + sql_strip("s") + "), lambda s: s <> '')")


@query("sentence_count", f"""
SELECT doc_id, len(l)::BIGINT AS n_sentences, list_max(list_transform(l, lambda s: length(s)))
       ::BIGINT AS longest
FROM (SELECT doc_id, {_SENTENCE_LIST} AS l FROM documents)""")
def sentence_count(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.sentences("text").alias("s"))
    return docs.select("doc_id", F.size("s").cast("bigint").alias("n_sentences"),
                       F.array_max(F.transform("s", F.length)).cast("bigint").alias("longest"))


@query("cloze_answers", f"""
WITH {MARKED}
SELECT nid, ord::BIGINT AS ord, count(*)::BIGINT AS n, sum(n_words)::BIGINT AS n_words
FROM (SELECT nid, unnest({find('text', T.CLOZE, 1)}) AS ord,
             len(list_filter(regexp_split_to_array(unnest({find('text', T.CLOZE, 2)}),
                 {lit(WS + '+')}), lambda w: w <> '')) AS n_words FROM marked)
GROUP BY ALL""")
def cloze_answers(spark, d):
    found = marked_notes(spark, d).select("nid", F.explode(T.clozes("text")).alias("c"))
    return found.groupBy("nid", F.col("c.ord").cast("bigint").alias("ord")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("c.n_words").alias("n_words"))


@query("semicolon_fronts", f"""
WITH {MARKED} SELECT nid, {sub('text', T.ENTITY)} LIKE '%;%' AS semicolon FROM marked
UNION ALL SELECT -1 - page_id, {sub('html', T.ENTITY)} LIKE '%;%' FROM pages""")
def semicolon_fronts(spark, d):
    a = marked_notes(spark, d).select("nid", T.has_semicolon("text").alias("semicolon"))
    b = table(spark, d, "pages").select((-1 - F.col("page_id")).alias("nid"),
                                        T.has_semicolon("html").alias("semicolon"))
    return a.unionByName(b)


_MEDIA_SQL = """
  SELECT page_id AS nid, unnest(list_distinct(list_filter(list_concat(
     regexp_extract_all(v, {p}, 1), regexp_extract_all(v, {p}, 2),
     regexp_extract_all(v, {p}, 3), regexp_extract_all(v, {p}, 4)), lambda m: m <> ''))) AS ref
  FROM (SELECT page_id, html || '<img class="f" src="f' || (page_id % 40) || '.png"><IMG src='
        || chr(39) || 'g' || (page_id % 3) || '.jpg' || chr(39) || '>[sound:s' || page_id
        || '.mp3]<object data="o' || (page_id % 7) || '.svg"></object>' AS v FROM pages)
""".replace("{p}", lit(T.MEDIA))


def media_pages(spark, d):
    """Pages with media tags that carry names made from the page number."""
    n = F.col("page_id")
    tail = F.concat(
        F.lit('<img class="f" src="f'), F.pmod(n, F.lit(40)), F.lit(".png\"><IMG src='g"),
        F.pmod(n, F.lit(3)), F.lit(".jpg'>[sound:s"), n, F.lit('.mp3]<object data="o'),
        F.pmod(n, F.lit(7)), F.lit('.svg"></object>'))
    return table(spark, d, "pages").select(n.alias("nid"), F.concat("html", tail).alias("text"))


@query("media_references", _MEDIA_SQL)
def media_references(spark, d):
    return media_pages(spark, d).select("nid", F.explode(T.media_refs("text")).alias("ref"))


@query("distinct_media", f"SELECT count(DISTINCT ref)::BIGINT AS n_media FROM ({_MEDIA_SQL})")
def distinct_media(spark, d):
    from corpusgate.operators.relate import distinct_media as count
    notes = media_pages(spark, d)
    for name in V.NOTE_FIELDS[1:]:
        notes = notes.withColumn(name, F.lit(""))
    return count(notes)


@query("normalize_extra", _digest_sql(
    "marked", "nid", f"CASE WHEN {sql_strip('extra')} = '' THEN extra ELSE ' ' || "
    f"regexp_replace(extra, {lit('^' + WS + '+')}, '') END", f"WITH {MARKED} "))
def normalize_extra(spark, d):
    return _digest(marked_notes(spark, d), "nid", T.normalize_extra("extra"))


@query("natural_order", f"""
SELECT page_id, row_number() OVER (ORDER BY k, page_id)::BIGINT AS place FROM (
  SELECT page_id, list_transform(range(len(w)), lambda i: w[i + 1] || chr(1) ||
     coalesce(lpad(length(n[i + 1])::VARCHAR, 4, '0') || n[i + 1], '')) AS k
  FROM (SELECT page_id, list_transform(regexp_split_to_array(url, '[0-9]+'),
               lambda x: lower(x)) AS w,
          list_transform(regexp_extract_all(url, '[0-9]+'),
               lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END) AS n
        FROM pages))""")
def natural_order(spark, d):
    from corpusgate.operators.order import numbered_by
    pages = table(spark, d, "pages").select("page_id", T.natural_key("url").alias("k"))
    return numbered_by(pages, ["k", "page_id"], "place").select("page_id", "place")


@query("match_key", f"""
SELECT page_id, {sql_strip(sub(sub(sub(
    "regexp_replace(lower(regexp_replace(url, '(?s)^.*/', '')), "
    "'(?s)^(" + chr(92) + ".*[^.].*)" + chr(92) + ".[^.]*$', '" + chr(92) + "1')",
    WS.replace('[', '[_' + chr(92) + '-', 1) + '+', ' '),
    chr(92) + 'b(?:module|deck)' + chr(92) + 'b'), WS + '+', ' '))} AS key FROM pages""")
def match_key(spark, d):
    return table(spark, d, "pages").select("page_id", T.match_key("url").alias("key"))


@query("content_terms", f"""
SELECT doc_id, len(a)::BIGINT AS n3, len(b)::BIGINT AS n6,
       md5(array_to_string(list_sort(a), ' ')) AS digest
FROM (SELECT doc_id,
  list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{{3,}}')),
              lambda w: w NOT IN {sql_stop()}) AS a,
  list_distinct(regexp_extract_all(lower(text), '[a-z]{{6,}}')) AS b FROM documents)""")
def content_terms(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.size(T.content_terms("text")).cast("bigint").alias("n3"),
        F.size(T.content_terms("text", 6, ())).cast("bigint").alias("n6"),
        F.md5(F.array_join(F.sort_array(T.content_terms("text")), " ")).alias("digest"))


_MEASURED_SQL = """measured AS (
  SELECT o_orderkey AS nid, 'deck' || (o_custkey % 12) AS deck,
    CASE o_orderkey % 4
      WHEN 0 THEN 'Give {{c1::' || (o_custkey % 50 + 1) || '}} mg/kg at T' || (o_custkey % 12 + 1)
        || ' for ' || (o_orderkey % 97) || ' hours.'
      WHEN 1 THEN 'Inject ' || (o_custkey % 50 + 1) || '-' || (o_custkey % 50 + 3) || ' mL or '
        || (o_custkey % 9) || '.5 cm in ' || (o_orderkey % 31) || ' min.'
      WHEN 2 THEN 'The TAP and cv dose is ' || (o_custkey % 47) || '% of ' || (o_custkey % 50 + 1)
        || ' L over 2 hour.'
      ELSE 'Gauge ' || (o_custkey % 29) || ' gauge, ' || (o_custkey % 50 + 1)
        || ' degrees, central nervous system, C5 C6.' END AS text,
    '' AS extra FROM orders)"""


def measured_notes(spark, d):
    """Short notes with numbers and units, written from the columns of each order."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    q, kind = F.pmod(cust, F.lit(50)) + 1, F.pmod(key, F.lit(4))
    text = (F.when(kind == 0, F.concat(
        F.lit("Give {{c1::"), q, F.lit("}} mg/kg at T"), F.pmod(cust, F.lit(12)) + 1,
        F.lit(" for "), F.pmod(key, F.lit(97)), F.lit(" hours.")))
        .when(kind == 1, F.concat(
            F.lit("Inject "), q, F.lit("-"), q + 2, F.lit(" mL or "), F.pmod(cust, F.lit(9)),
            F.lit(".5 cm in "), F.pmod(key, F.lit(31)), F.lit(" min.")))
        .when(kind == 2, F.concat(
            F.lit("The TAP and cv dose is "), F.pmod(cust, F.lit(47)), F.lit("% of "), q,
            F.lit(" L over 2 hour.")))
        .otherwise(F.concat(
            F.lit("Gauge "), F.pmod(cust, F.lit(29)), F.lit(" gauge, "), q,
            F.lit(" degrees, central nervous system, C5 C6."))))
    return wide_table(spark, d, "orders").select(
        key.alias("nid"), F.concat(F.lit("deck"), F.pmod(cust, F.lit(12))).alias("deck"),
        text.alias("text"), F.lit("").alias("extra"))


_FACT_TEXT = "lower(" + sub(sub("text", T.CLOZE_LINE, r"\1"), T.TAG, " ") + ")"


@query("numeric_facts", f"""
WITH {_MEASURED_SQL}, f AS (SELECT nid, {_FACT_TEXT} AS t FROM measured), g AS (
  SELECT nid, unnest({find('t', A.TOPIC_NUMBER, 1)}) AS n, unnest({find('t', A.TOPIC_NUMBER, 2)})
         AS u FROM f UNION ALL SELECT nid, unnest({find('t', A.LEVEL_TOKEN, 1)}), '' FROM f)
SELECT fact, count(*)::BIGINT AS n FROM (SELECT DISTINCT nid, n || CASE u WHEN 'l' THEN 'ml'
  WHEN 'hour' THEN 'hours' WHEN 'min' THEN 'minutes' ELSE u END AS fact FROM g) GROUP BY fact""")
def numeric_facts(spark, d):
    notes = measured_notes(spark, d)
    return (notes.select(F.explode(A.numeric_facts(A.fact_text("text"))).alias("fact"))
            .groupBy("fact").agg(F.count(F.lit(1)).alias("n")))


@query("corpus_numbers", f"""
WITH {_MEASURED_SQL} SELECT number, count(*)::BIGINT AS n FROM (
  SELECT DISTINCT nid, {sub('lower(m)', WS + '+')} AS number
  FROM (SELECT nid, unnest({find('text', A.INVENTORY_NUMBER)}) AS m FROM measured))
GROUP BY number""")
def corpus_numbers(spark, d):
    return (measured_notes(spark, d).select(F.explode(A.corpus_numbers("text")).alias("number"))
            .groupBy("number").agg(F.count(F.lit(1)).alias("n")))


def _expand_sql(expr: str, n: int) -> str:
    """Chained CTEs, one per dictionary entry."""
    steps = [f"x0 AS (SELECT nid, {expr} AS t FROM measured)"]
    for i, (short, full) in enumerate(V.ABBREVIATIONS[:n]):
        steps.append(f"y{i} AS (SELECT nid, t || CASE WHEN regexp_matches(t, '\\b{short}\\b') "
                     f"THEN ' {full}' ELSE '' END AS t FROM x{i})")
        steps.append(f"x{i + 1} AS (SELECT nid, t || CASE WHEN contains(t, '{full}') "
                     f"THEN ' {short}' ELSE '' END AS t FROM y{i})")
    return ", ".join(steps)


@query("expand_abbreviations", f"""
WITH {_MEASURED_SQL}, {_expand_sql(_FACT_TEXT, len(V.ABBREVIATIONS))}
SELECT nid, t AS expanded FROM x{len(V.ABBREVIATIONS)}""")
def expand_abbreviations(spark, d):
    notes = measured_notes(spark, d).select("nid", A.fact_text("text").alias("t"))
    return notes.select("nid", A.expand_abbreviations("t").alias("expanded"))


@query("mined_abbreviations", f"""
WITH defs AS (SELECT o_orderkey AS nid, 'the Fresh ' || CASE o_orderpriority
    WHEN '1-URGENT' THEN 'Urgent Nerve' WHEN '2-HIGH' THEN 'High Blocks'
    ELSE 'Calm Artery' END || ' (' || CASE o_orderstatus WHEN 'F' THEN 'FUN' WHEN 'O' THEN 'FHB'
    ELSE 'FCA' END || ') here' AS text FROM orders)
SELECT short, arg_max(full_form, nid) AS full_form FROM (
  SELECT nid, lower(regexp_extract(text, '\\(([A-Z]{{2,6}})\\)', 1)) AS short,
    'fresh ' || CASE WHEN text LIKE '%Urgent%' THEN 'urgent nerve'
       WHEN text LIKE '%High%' THEN 'high block' ELSE 'calm artery' END AS full_form FROM defs)
GROUP BY short""")
def mined_abbreviations(spark, d):
    from corpusgate.operators.claims import mined_abbreviations as mine
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    name = (F.when(p == "1-URGENT", "Urgent Nerve").when(p == "2-HIGH", "High Blocks")
            .otherwise("Calm Artery"))
    short = F.when(s == "F", "FUN").when(s == "O", "FHB").otherwise("FCA")
    notes = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("nid"),
        F.concat(F.lit("the Fresh "), name, F.lit(" ("), short, F.lit(") here")).alias("text"),
        F.lit("").alias("extra"))
    return mine(notes)


_RANGE_SQL = """SELECT l_orderkey * 8 + l_linenumber AS nid, l_quantity::INT AS a,
  l_linenumber AS b, l_tax AS t, CASE l_linenumber % 5 WHEN 0 THEN 'cm' WHEN 1 THEN 'mL'
  WHEN 2 THEN 'mm' WHEN 3 THEN 'inch' ELSE 'widget' END AS unit FROM lineitem"""


def _ranges(spark, d):
    ln = F.pmod("l_linenumber", F.lit(5))
    unit = (F.when(ln == 0, "cm").when(ln == 1, "mL").when(ln == 2, "mm").when(ln == 3, "inch")
            .otherwise("widget"))
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("nid"),
        F.concat(F.col("l_quantity").cast("int"), F.lit(" to "), "l_linenumber",
                 F.lit(".50")).alias("value"),
        unit.alias("unit"))


@query("norm_range", f"SELECT nid, a || '-' || b || '.5' AS value FROM ({_RANGE_SQL})")
def norm_range(spark, d):
    return _ranges(spark, d).select("nid", A.norm_range("value").alias("value"))


@query("unit_family", f"""
SELECT unit, family, count(*)::BIGINT AS n FROM (SELECT unit, CASE unit WHEN 'mL' THEN 'volume'
  WHEN 'widget' THEN 'widget' ELSE 'length' END AS family FROM ({_RANGE_SQL})) GROUP BY ALL""")
def unit_family(spark, d):
    return (_ranges(spark, d).groupBy("unit", A.unit_family("unit").alias("family"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("span_mm", f"""
SELECT nid, round(least(a, b + 0.5) * f, 4)::DOUBLE AS lo,
       round(greatest(a, b + 0.5) * f, 4)::DOUBLE AS hi
FROM (SELECT *, CASE unit WHEN 'cm' THEN 10.0 WHEN 'mm' THEN 1.0 WHEN 'inch' THEN 25.4 END AS f
      FROM ({_RANGE_SQL}))""")
def span_mm(spark, d):
    spans = _ranges(spark, d).select("nid", A.span_mm("value", "unit").alias("s"))
    return spans.select("nid", F.round("s.lo", 4).alias("lo"), F.round("s.hi", 4).alias("hi"))


@query("singular_tokens", f"""
SELECT token, CASE WHEN length(token) < 5 OR regexp_matches(token, '(ss|us|is|as|os)$') THEN token
  WHEN token LIKE '%ies' THEN left(token, length(token) - 3) || 'y'
  WHEN regexp_matches(token, '[sxzhc]es$') THEN left(token, length(token) - 2)
  WHEN token LIKE '%s' THEN left(token, length(token) - 1) ELSE token END AS singular,
  n FROM (SELECT token, count(*)::BIGINT AS n FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents)
  GROUP BY token)""")
def singular_tokens(spark, d):
    tokens = table(spark, d, "documents").select(F.explode(
        F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("token", S.singular(F.col("token")).alias("singular"), "n")


@query("count_claims", """
SELECT o_orderkey AS nid, 'count[' || CASE o_orderkey % 3 WHEN 0 THEN 'layer' WHEN 1 THEN 'branche'
   ELSE 'leave' END || ']' AS attribute,
   CASE o_orderpriority WHEN '1-URGENT' THEN '1' WHEN '2-HIGH' THEN '12' ELSE '7' END AS value
FROM orders""")
def count_claims(spark, d):
    p, k = F.col("o_orderpriority"), F.pmod("o_orderkey", F.lit(3))
    number = F.when(p == "1-URGENT", "One").when(p == "2-HIGH", "twelve").otherwise("7")
    noun = F.when(k == 0, "layers").when(k == 1, "branches").otherwise("leaves")
    notes = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("nid"),
        F.concat(F.lit("The wall has "), number, F.lit(" "), noun, F.lit(" and 3 tails.")).alias("t"))
    found = notes.select("nid", F.explode(A.count_claims(F.col("t"))).alias("c"))
    return found.select("nid", F.concat(F.lit("count["), A.count_noun(F.col("c.g2")), F.lit("]"))
                        .alias("attribute"), A.count_value(F.col("c.g1")).alias("value"))


@query("level_tokens", """
SELECT l_orderkey * 8 + l_linenumber AS nid, CASE l_linenumber % 3 WHEN 0
  THEN 'C' || (l_suppkey % 8 + 1) || '-T' || (l_partkey % 12 + 1)
  ELSE 'L' || (l_partkey % 5 + 1) END AS level FROM lineitem WHERE l_linenumber % 3 <> 2""")
def level_tokens(spark, d):
    ln, part = F.pmod("l_linenumber", F.lit(3)), F.col("l_partkey")
    c, t = F.pmod("l_suppkey", F.lit(8)) + 1, F.pmod(part, F.lit(12)) + 1
    lumbar = F.pmod(part, F.lit(5)) + 1
    text = (F.when(ln == 0, F.concat(F.lit("roots C"), c, F.lit(" to T"), t, F.lit(".")))
            .when(ln == 1, F.concat(F.lit("at L"), lumbar, F.lit(" only")))
            .otherwise(F.concat(F.lit("C"), c, F.lit(", T"), t, F.lit(" and L"), lumbar)))
    notes = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("nid"), text.alias("t"))
    return notes.select("nid", F.explode(A.level_tokens(F.col("t"))).alias("l")).select(
        "nid", A.level_name(F.col("l")).alias("level"))


@query("category_members", """
SELECT l_orderkey * 8 + l_linenumber AS nid, family, member FROM lineitem, (VALUES
  (1, 'needle-type', 'tuohy'), (3, 'body-position', 'prone'),
  (4, 'needle-direction', 'in-plane'), (5, 'limb-position', 'abducted'))
  AS v(ln, family, member) WHERE l_linenumber = ln""")
def category_members(spark, d):
    ln = F.col("l_linenumber")
    text = (F.when(ln == 1, "A Tuohy needle is used.")
            .when(ln == 2, "A tuohy or quincke needle is used.")
            .when(ln == 3, "The patient is prone.")
            .when(ln == 4, "Inserted in-plane.")
            .when(ln == 5, "The arm abducted.")
            .otherwise("It is in-plane and prone."))
    notes = table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + ln).alias("nid"), text.alias("t"))
    return notes.select("nid", F.explode(A.category_members("t")).alias("m")).select(
        "nid", "m.family", "m.member")


@query("numericish_tokens", f"""
SELECT (doc_id % 10)::BIGINT AS bucket, count(*)::BIGINT AS n_tokens, count(*) FILTER (
  {has(ascii_words('w'), r'[0-9]|' + chr(92) + 'b[IVXLCDM]{2,}' + chr(92) + 'b')}
  OR {has('w', '^(?:' + '|'.join(V.BOX_UNITS) + ')$')})::BIGINT AS n_numeric
FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, {lit(WS + '+')}),
      lambda w: w <> '')) AS w FROM documents) GROUP BY 1""")
def numericish_tokens(spark, d):
    from corpusgate.functions.base import words_of
    words = table(spark, d, "documents").select(
        F.pmod("doc_id", F.lit(10)).alias("bucket"), F.explode(words_of(F.col("text"))).alias("w"))
    return words.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.count_if(T.numericish("w")).alias("n_numeric"))


@query("visual_tokens", """
SELECT doc_id, (ceil((n_chars % 1400 + 1) / 28.0) * ceil((n_chars + 1) / 28.0))::BIGINT AS tokens
FROM documents""")
def visual_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.visual_tokens(
        F.pmod("n_chars", F.lit(1400)) + 1, F.col("n_chars") + 1).alias("tokens"))


@query("path_parts", """
SELECT s_suppkey AS did, s_name AS leaf, (1 + s_suppkey % 3)::BIGINT AS depth FROM supplier""")
def path_parts(spark, d):
    sep = V.FIELD_SEP
    deep = F.pmod("s_suppkey", F.lit(3))
    name = F.concat(F.lit("Root" + sep), F.repeat(F.lit("Mid" + sep), deep.cast("int")), "s_name")
    decks = table(spark, d, "supplier").select(F.col("s_suppkey").alias("did"), name.alias("name"))
    return decks.select("did", T.path_leaf("name").alias("leaf"),
                        T.path_depth("name").cast("bigint").alias("depth"))


@query("snippets", """
SELECT doc_id, p - 1 AS start, CASE WHEN length(w) <= 60 THEN w ELSE left(w, 59) || '…' END AS snip
FROM (SELECT doc_id, p, substr(text, greatest(p - 1 - 28, 0)::BIGINT + 1,
             p - 1 + 3 + 52 - greatest(p - 1 - 28, 0)) AS w
      FROM (SELECT doc_id, text, position('the' IN text)::BIGINT AS p FROM documents) WHERE p > 0)""")
def snippets(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", "text", (F.instr("text", "the") - 1).cast("bigint").alias("start")
    ).where("start >= 0")
    return docs.select("doc_id", "start", T.snippet(
        "text", F.col("start"), F.lit(3), 28, 52, 60).alias("snip"))


@query("overlap_chunks", """
SELECT doc_id, o AS start, length(substr(text, o + 1, 1600))::BIGINT AS n_chars,
       md5(substr(text, o + 1, 1600)) AS digest
FROM (SELECT doc_id, text, unnest(range(0, length(text)::BIGINT, 1480)) AS o FROM documents)
WHERE o = 0 OR o + 120 < length(text)""", bench=True)
def overlap_chunks(spark, d):
    cut = table(spark, d, "documents").select("doc_id", F.explode(T.chunks("text")).alias("c"))
    return cut.select("doc_id", F.col("c.start").cast("bigint").alias("start"),
                      F.length("c.chunk").cast("bigint").alias("n_chars"),
                      F.md5("c.chunk").alias("digest"))


@query("subject_phrases", f"""
SELECT nid, phrase, count(*)::BIGINT AS n FROM (
  SELECT nid, unnest({find('v', S.PHRASE, 1)}) AS phrase FROM (
    SELECT p_partkey AS nid, 'The ' || p_name || ' nerve lies on the ' || p_type
      || ' artery near the block and ' || p_brand || ' Tubes.' AS v FROM part))
GROUP BY ALL""")
def subject_phrases(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("nid"), F.concat(
        F.lit("The "), "p_name", F.lit(" nerve lies on the "), "p_type",
        F.lit(" artery near the block and "), "p_brand", F.lit(" Tubes.")).alias("v"))
    found = parts.select("nid", F.explode(S.subject_phrases("v")).alias("phrase"))
    return found.groupBy("nid", "phrase").agg(F.count(F.lit(1)).alias("n"))


@query("unpack_fields", """
SELECT doc_id AS nid, md5(source) AS text, lang AS extra,
       CASE WHEN doc_id % 2 = 0 THEN 'x' ELSE '' END AS personal, '' AS resources FROM documents""")
def unpack_fields(spark, d):
    from corpusgate.operators.notes import unpack_fields as unpack
    sep = V.FIELD_SEP
    packed = table(spark, d, "documents").select(
        F.col("doc_id").alias("nid"),
        F.concat(F.md5("source"), F.lit(sep), "lang",
                 F.when(F.pmod("doc_id", F.lit(2)) == 0, sep + "x").otherwise("")).alias("flds"))
    return unpack(packed).select("nid", "text", "extra", "personal", "resources")


@query("write_digest_lines", _digest_sql(
    "marked", "nid", f"nid || chr(9) || {_compact_sql('text')} || CASE WHEN "
    f"{_compact_sql('extra')} = '' THEN '' ELSE chr(9) || {_compact_sql('extra')} END",
    f"WITH {MARKED} "))
def write_digest_lines(spark, d):
    from corpusgate.operators.report import digest_lines
    return _digest(digest_lines(marked_notes(spark, d)), "nid", F.col("line"))



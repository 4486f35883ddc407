"""Registry of named queries over the driver tables, each with an independent SQL form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.functions import values as V
from corpusgate.functions.base import WS, WS_CHARS
from corpusgate.functions import text as T
from corpusgate.operators.notes import notes_from_documents

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None
    bench: bool


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, bench: bool = False):
    """Register `fn(spark, sf_dir)` under a name."""
    def add(fn: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(fn, sql, bench)
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table for queries that spend their time on parsing text.

    A file of one row group is one task, whatever the number of cores. A session that reads
    such files can ask for tables to be spread over `spark.corpusgate.spread` tasks first;
    without the setting nothing is shuffled. The plan does not look at the table.
    """
    df = table(spark, sf_dir, name)
    spread = spark.conf.get("spark.corpusgate.spread", None)
    return df.repartition(int(spread)) if spread else df


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table of which queries read a few narrow columns and write texts from them.

    Only those columns are shuffled, so it is always spread: a file of one row group would be
    one task otherwise, whatever its size.
    """
    tasks = spark.conf.get("spark.corpusgate.spread", None) or spark.conf.get(
        "spark.sql.shuffle.partitions")
    return table(spark, sf_dir, name).repartition(int(tasks))


def doc_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_from_documents(wide_table(spark, sf_dir, "documents"))


def marked_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document notes with cloze and layout markup added by note number."""
    notes = doc_notes(spark, sf_dir)
    m = F.pmod("nid", F.lit(7))
    long_word, line = "([A-Za-z]{7,})", F.col("text")
    text = (F.when(m == 0, line)
            .when(m <= 3, F.regexp_replace(line, long_word, "{{c1::$1}}"))
            .when(m == 4, F.regexp_replace(line, long_word, "{{c2::$1}}"))
            .when(m == 5, F.concat(F.regexp_replace(line, long_word, "{{c1::$1::hint}}"),
                                   F.lit("; always per the module {{")))
            .otherwise(F.concat(F.regexp_replace(line, long_word, "{{c1::$1}}"),
                                F.lit(" {{c1::one two three four}} {{c3::5 mg, x.}} "
                                      "medial 7 mg ABC (ABC) DEFG"))))
    extra = (F.when(m == 0, F.lit("")).when(m == 1, F.concat(F.lit("<b>"), "extra"))
             .when(m == 2, F.concat(F.lit("<i>x</i>"), "extra")).when(m == 3, F.lit(" "))
             .when(m == 4, F.concat("extra", F.lit("<br>- a<br>- b")))
             .otherwise(F.col("extra")))
    return notes.select("nid", "deck", text.alias("text"), extra.alias("extra"))


# ---- SQL fragments -------------------------------------------------------------------------

def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """The same pattern without the flags only Java knows."""
    return (pattern.replace("(?iU)", "(?i)").replace("(?U:", "(?:").replace("(?U)", ""))


def sub(expr: str, pattern: str, replacement: str = "") -> str:
    return f"regexp_replace({expr}, {lit(re2(pattern))}, {lit(replacement)}, 'g')"


def has(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {lit(re2(pattern))})"


def find(expr: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({expr}, {lit(re2(pattern))}, {group})"


def sql_strip(expr: str) -> str:
    chars = "||".join(f"chr({ord(c)})" for c in WS_CHARS)
    return f"trim({expr}, {chars})"


def sql_plain(expr: str) -> str:
    out = sub(expr, T.CLOZE_ANSWER, r"\1")
    out = sub(out, rf"<br{WS}*/?>", " . ")
    out = sub(out, T.TAG, " ")
    for entity, char in T.ENTITIES:
        out = f"replace({out}, {lit(entity)}, {lit(char)})"
    return f"trim({sub(out, WS + '+', ' ')}, ' ')"


def sql_sort_field(expr: str) -> str:
    return sql_strip(sub(sub(expr, T.SOUND), T.TAG))


NL = "chr(10)"
NOTES = f"""notes AS (
  SELECT doc_id AS nid, source AS deck, lang,
         CASE WHEN position({NL} IN text) > 0
              THEN left(text, position({NL} IN text) - 1) ELSE text END AS text,
         CASE WHEN position({NL} IN text) > 0
              THEN substr(text, position({NL} IN text) + 1) ELSE '' END AS extra
  FROM documents)"""
LONG_WORD = "([A-Za-z]{7,})"
MARKED = NOTES + f""", marked AS (
  SELECT nid, deck,
    CASE WHEN nid % 7 = 0 THEN text
         WHEN nid % 7 <= 3 THEN {sub('text', LONG_WORD, '{{c1::' + chr(92) + '1}}')}
         WHEN nid % 7 = 4 THEN {sub('text', LONG_WORD, '{{c2::' + chr(92) + '1}}')}
         WHEN nid % 7 = 5 THEN {sub('text', LONG_WORD, '{{c1::' + chr(92) + '1::hint}}')}
              || '; always per the module {{{{'
         ELSE {sub('text', LONG_WORD, '{{c1::' + chr(92) + '1}}')}
              || ' {{{{c1::one two three four}}}} {{{{c3::5 mg, x.}}}} medial 7 mg ABC (ABC) DEFG'
    END AS text,
    CASE nid % 7 WHEN 0 THEN '' WHEN 1 THEN '<b>' || extra WHEN 2 THEN '<i>x</i>' || extra
         WHEN 3 THEN ' ' WHEN 4 THEN extra || '<br>- a<br>- b' ELSE extra END AS extra
  FROM notes)"""
# Letters of the test data that RE2 would not treat as part of a word.
ACCENTED = r"[\x{c0}-\x{24f}]"


def ascii_words(expr: str) -> str:
    """Accented letters become "_" so that an ASCII word boundary acts like a full one."""
    return sub(expr, ACCENTED, "_")


def sql_list(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def sql_stop(words=V.STOP_WORDS) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"

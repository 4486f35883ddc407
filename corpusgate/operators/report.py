"""Reports: ledgers, digests, the violations table, changelog sections and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.functions import values as V
from corpusgate.functions.base import lookup_map, text
from corpusgate.functions.text import compact
from corpusgate.operators import rules as R
from corpusgate.operators.order import capped_groups, numbered_by


# ---- digest and ledger -----------------------------------------------------------------------

def digest_lines(notes: DataFrame) -> DataFrame:
    """(nid, line): number, compact front and, when there is one, compact back."""
    both = notes.select("nid", compact("text").alias("_t"), compact("extra").alias("_e"))
    tab = F.lit("\t")
    return both.select("nid", F.concat(
        F.col("nid").cast("string"), tab, F.col("_t"),
        F.when(F.col("_e") != "", F.concat(tab, F.col("_e"))).otherwise("")).alias("line"))


def digest_ratio(notes: DataFrame) -> DataFrame:
    """One row: notes, raw and compact characters, and tokens estimated at four characters."""
    sizes = notes.select(
        (F.length(text("text")) + F.length(text("extra"))).alias("_raw"),
        (F.length(compact("text")) + F.length(compact("extra"))).alias("_compact"))
    total = sizes.agg(F.count(F.lit(1)).alias("notes"), F.sum("_raw").alias("raw_chars"),
                      F.sum("_compact").alias("compact_chars"))
    return total.select("*", F.floor(F.col("raw_chars") / 4).alias("raw_tokens"),
                        F.floor(F.col("compact_chars") / 4).alias("compact_tokens"))


def flag_histogram(ledger: DataFrame) -> DataFrame:
    return (ledger.select(F.explode("flags").alias("flag")).groupBy("flag")
            .agg(F.count(F.lit(1)).alias("n")))


def multi_cloze_rate(ledger: DataFrame) -> DataFrame:
    """One row: notes, multi-cloze notes and their share."""
    multi = F.exists("flags", lambda f: f.startswith("multi-cloze"))
    return ledger.agg(F.count(F.lit(1)).alias("notes"), F.count_if(multi).alias("multi"),
                      F.avg(multi.cast("double")).alias("rate"))


# ---- violations ---------------------------------------------------------------------------------

def violations(notes: DataFrame, brand: str | None = None) -> DataFrame:
    """(deck, nid, section, severity, rule): per-note findings of every check.

    One pass over the notes: each check yields an array, the arrays are joined and
    exploded, so no check costs an own scan or a shuffle.
    """
    def tag(section: str, severity: str, names):
        return F.transform(names, lambda n: F.struct(
            F.lit(section).alias("section"), F.lit(severity).alias("severity"),
            n.alias("rule")))

    def attributed(field: str):
        return F.transform(R.source_attribution(field, brand),
                           lambda _h: F.lit(f"source named in {field}"))

    def certain(field: str):
        return F.transform(R.certainty_on_measure(field),
                           lambda _h: F.lit(f"certainty word in {field}"))

    parts = [
        tag("B", "gate", R.house_rules(audit=True)),
        tag("B", "gate", F.concat(attributed("text"), attributed("extra"))),
        tag("I", "soft", R.flag_list((R.is_procedural(), "procedure direction"))),
        tag("I", "gate", R.flag_list((R.dose_without_drug(), "dose without drug"))),
        tag("J", "soft", F.concat(certain("text"), certain("extra"))),
    ]
    if "textbook" in notes.columns and "tags" in notes.columns:
        parts.append(tag("K", "soft", R.provenance_blank()))
    return (notes.select("deck", "nid", F.explode(F.concat(*parts)).alias("v"))
            .select("deck", "nid", "v.section", "v.severity", "v.rule"))


def violation_rollup(found: DataFrame) -> DataFrame:
    """(deck, section, n, n_gating) with subtotals; null means all."""
    return found.rollup("deck", "section").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "gate").alias("n_gating"))


# ---- changelog and gates -----------------------------------------------------------------------

def op_counts(changelog: DataFrame) -> DataFrame:
    """(kind, n, created): entries per kind, and notes that splits created."""
    made = F.coalesce(F.regexp_extract("reason", V.SPLIT_COUNT, 1).try_cast("bigint"),
                      F.lit(0))
    return changelog.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("kind") == "SPLIT", made).otherwise(0)).alias("created"))


def accounting(changelog: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: before + added + split children - split parents - demoted - deleted."""
    made = F.coalesce(F.regexp_extract("reason", V.SPLIT_COUNT, 1).try_cast("bigint"),
                      F.lit(0))
    kind = F.col("kind")
    n_before = before.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_after = after.agg(F.count(F.lit(1)).alias("n")).scalar()
    sums = changelog.agg(
        F.count_if(kind == "ADD").alias("added"),
        F.coalesce(F.sum(F.when(kind == "SPLIT", made)), F.lit(0)).alias("split_children"),
        F.count_if(kind == "SPLIT").alias("split_parents"),
        F.count_if(kind == "DEMOTE").alias("demoted"),
        F.count_if(kind == "DELETE").alias("deleted"))
    expected = (F.col("notes_before") + F.col("added") + F.col("split_children")
                - F.col("split_parents") - F.col("demoted") - F.col("deleted"))
    return (sums.withColumn("notes_before", n_before).withColumn("notes_after", n_after)
            .withColumn("expected", expected)
            .withColumn("pass", F.col("expected") == F.col("notes_after")))


def ops_applied(changelog: DataFrame, ops: DataFrame) -> DataFrame:
    """One row: intended, applied, skipped, pass."""
    intended = ops.agg(F.count(F.lit(1)).alias("n")).scalar()
    return changelog.agg(
        F.count_if(F.col("kind").isin(*V.APPLIED_KINDS)).alias("applied"),
        F.count_if(F.col("kind") == "SKIP").alias("skipped"),
    ).withColumn("intended", intended).withColumn("pass",
                                                  F.col("applied") == F.col("intended"))


def changelog_sections(changelog: DataFrame) -> DataFrame:
    """(section, kind, place, nid, reason): grouped in review order and numbered.

    Entries are numbered by range partitions over (section, seq); a section's first number,
    one row per kind, makes them places of their own.
    """
    order = lookup_map((k, i) for i, k in enumerate(V.CHANGELOG_ORDER, start=1))
    rows = changelog.where(F.col("kind").isin(*V.CHANGELOG_ORDER)).withColumn(
        "section", order[F.col("kind")])
    numbered = numbered_by(rows, ["section", "seq", "nid", "reason"], "_at")
    # As many rows as there are kinds.
    first = numbered.groupBy("section").agg(F.min("_at").alias("_first"))
    return numbered.join(F.broadcast(first), "section").select(
        "section", "kind", (F.col("_at") - F.col("_first") + 1).alias("place"), "nid", "reason")


def review_calls(changelog: DataFrame, module: str = "module", n: int = 40) -> DataFrame:
    """(module, place, call): content decisions a person must read, n per module."""
    chosen = changelog.where(F.col("kind").isin(*V.REVIEW_KINDS))
    call = F.concat(F.initcap("kind"), F.lit(" · note "), F.col("nid").cast("string"),
                    F.lit(" · "), F.coalesce("reason", F.lit("Review this content decision.")))
    return capped_groups(chosen.withColumn("call", call), module, ["seq", "nid"], n).select(
        module, "place", "call")


def judgement_lines(reports: DataFrame, n: int = 40) -> DataFrame:
    """(path, place, line): the first n lines of a report's first judgement section.

    The section may stand under a heading of level 1 to 4 and ends at the next such heading.
    Reports are (path, text) rows.
    """
    parts = F.filter(F.split("text", r"(?m)(?=^#{1,4} )"),
                     lambda s: s.rlike(r"(?i)^#{1,4} +judge?ment calls"))
    body = F.regexp_replace(F.get(parts, 0), r"^[^\n]*\n?", "")
    kept = F.slice(F.filter(F.transform(F.split(body, "\n"), F.trim), lambda s: s != ""), 1, n)
    return reports.select("path", F.posexplode(kept).alias("at", "line")).select(
        "path", (F.col("at") + 1).alias("place"), "line")


def build_report(gates: DataFrame) -> DataFrame:
    """Gates (gate, severity, value, pass) and a final "verdict" row."""
    verdict = gates.agg(
        F.lit("verdict").alias("gate"), F.lit("gate").alias("severity"),
        F.count_if(~F.col("pass")).alias("value"),
        F.coalesce(F.bool_and(F.col("pass") | (F.col("severity") != "gate")), F.lit(True))
        .alias("pass"))
    return gates.select("gate", "severity", "value", "pass").unionByName(verdict)


def section_sizes(sections: DataFrame) -> DataFrame:
    """(path, heading, n_chars, n_tokens) with a subtotal per file and a grand total."""
    return sections.rollup("path", "heading").agg(
        F.sum(F.length("body")).alias("n_chars"),
        F.floor(F.sum(F.length("body")) / 4).alias("n_tokens"))

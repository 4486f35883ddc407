"""Checks on single notes. Each one returns an array of violations, or rows of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions import values as V
from corpusgate.functions.base import (all_matches, any_of, bind, count_literal, is_blank,
                                       strip, text, whole_word, with_offsets, words_of)
from corpusgate.functions.text import (CLOZE, TAG, clozes, compact, has_semicolon, plain,
                                       question_count, shorten)

LONG_FRONT = 900
LEDGER_UNIT_IN_CLOZE = (r"(?U)\{\{c[0-9]+::[^}]*\b(?:" + any_of(V.LEDGER_CLOZE_UNITS)
                        + r")\b[^}]*\}\}")
AUDIT_UNIT = r"(?U)\b(?:" + any_of(V.AUDIT_CLOZE_UNITS) + r")\b|%"
BULLET_PAIR = r"(?U)(?:^|⏎)\s*[-•]\s[^\n]*⏎\s*[-•]\s"
SOURCE = f"(?:{any_of(V.SOURCE_NOUNS)})"
ATTRIBUTION = (
    rf"(?iU)\b(?:{any_of(V.SOURCE_LEADS)})\s+{SOURCE}\b"
    rf"|\b{SOURCE}(?:'s)?\s+(?:{any_of(V.SOURCE_VERBS)})\b"
    rf"|\b{SOURCE}(?:'s)?\s+(?:{any_of(V.SOURCE_ARTEFACTS)})\b")
WEIGHT_DOSE = (r"(?iU)\b[0-9]+(?:\.[0-9]+)?\s*(?:" + any_of(V.WEIGHT_DOSE_UNITS)
               + r")\s*/\s*kg\b")
DRUG = r"(?iU)\b(" + any_of(V.DRUG_NAMES) + r")\b"
DIRECTION = whole_word(V.DIRECTION_WORDS)
PROCEDURE_VERB = whole_word(V.PROCEDURE_VERBS)
CONTRAST = (rf"(?iU){any_of(V.CONTRAST_PHRASES)}|\b(?:{any_of(V.COMPARATIVES)})\b")
CERTAINTY = whole_word(V.CERTAINTY_WORDS)
CERTAIN_MEASURE = CERTAINTY + r"(?=(?s:.{0,59})\d)"


def flag_list(*flags: tuple[Column, Column | str]) -> Column:
    """Names of the conditions that hold, in the order given."""
    return F.array_compact(F.array(*[
        F.when(cond, F.lit(name) if isinstance(name, str) else name) for cond, name in flags]))


# ---- F1, F2, F3 ---------------------------------------------------------------------------

def house_rules(front="text", back="extra", audit: bool = False) -> Column:
    """House-rule violations of one note; the audit form also wants a back."""
    t, e = text(front), text(back)
    first = question_count(t, 1)
    rules = [(first == 0, "no cloze"),
             (first > 3, ">3 clozes"),
             (t.contains("{{c2::") | t.contains("{{c3::"), "c2/c3"),
             (has_semicolon(t), "semicolon"),
             (count_literal(t, "{{") != count_literal(t, "}}"), "unbalanced braces")]
    rules += [(count_literal(e, f"<{tag}>") != count_literal(e, f"</{tag}>"),
               f"unbalanced <{tag}>") for tag in ("b", "u", "i")]
    if audit:
        rules.append((is_blank(e), "empty Extra"))
    return flag_list(*rules)


def cloze_mechanics(notes: DataFrame, key: str = "nid", front: str = "text") -> DataFrame:
    """(key, kind, item): long answers, units or punctuation in answers, bare short forms."""
    t = text(front)
    answers = F.transform(all_matches(t, r"\{\{c1::([^\n]*?)\}\}", 1),
                          lambda a: strip(F.regexp_replace(a, TAG, "")))

    def tagged(kind: str, items: Column) -> Column:
        return F.transform(items, lambda i: F.struct(F.lit(kind).alias("kind"),
                                                     i.alias("item")))

    long_ones = F.filter(answers, lambda a: F.size(words_of(a)) > 3)
    units = F.filter(answers, lambda a: F.regexp_like(a, F.lit(AUDIT_UNIT)))
    marks = F.filter(answers, lambda a: F.regexp_like(a, F.lit(r"[,;:]|\.\s|\.$")))
    exempt = F.array(*[F.lit(a) for a in V.AUDIT_EXEMPT_ABBREVIATIONS])
    bare = F.array_except(F.filter(
        F.array_distinct(all_matches(t, r"(?U)\b([A-Z]{3,})\b", 1)),
        lambda a: ~t.contains(F.concat(F.lit("("), a, F.lit(")")))), exempt)
    hits = F.concat(tagged("long answer", long_ones), tagged("unit in answer", units),
                    tagged("punctuation in answer", marks), tagged("bare short form", bare))
    return notes.select(key, F.explode(hits).alias("h")).select(key, "h.kind", "h.item")


def structural_flags(front="text", back="extra") -> Column:
    """Reading-order flags of one note, in a fixed order."""
    t, e = text(front), text(back)
    bare = F.regexp_replace(t, CLOZE, "$2")
    marks = clozes(t)
    n_ids = F.size(F.array_distinct(F.transform(marks, lambda c: c["ord"])))
    attributions = "(?i)" + any_of(V.LEDGER_ATTRIBUTIONS)
    short_forms = F.array_except(
        all_matches(bare, r"(?U)\b[A-Z]{2,6}\b", 0),
        F.array(*[F.lit(a) for a in V.LEDGER_EXEMPT_ABBREVIATIONS]))
    return flag_list(
        (n_ids > 1, F.concat(F.lit("multi-cloze:"), n_ids.cast("string"))),
        (n_ids > 3, "over-3-clozes"),
        (F.exists(marks, lambda c: c["n_words"] > 2), "long-cloze"),
        (F.exists(marks, lambda c: F.regexp_like(c["answer"], F.lit("[.,;:]"))),
         "punctuation-in-cloze"),
        (F.regexp_like(t, F.lit(LEDGER_UNIT_IN_CLOZE)), "unit-inside-cloze"),
        (t.contains("{{c") & (F.size(marks) == 0), "malformed-cloze"),
        (F.regexp_like(F.concat(bare, e), F.lit(attributions)), "attribution"),
        (F.regexp_like(bare, F.lit(whole_word(V.LEDGER_CERTAINTY))), "certainty-word"),
        (F.regexp_like(bare, F.lit(r"(?U)\d")), "has-number"),
        (F.regexp_like(bare, F.lit(whole_word(V.LEDGER_DIRECTIONS))), "direction"),
        (F.regexp_like(bare, F.lit(whole_word(V.LEDGER_DOSE_UNITS, "(?U)"))),
         "dose-or-volume"),
        (F.length(t) > LONG_FRONT, "long-front"),
        (F.regexp_like(compact(bare), F.lit(BULLET_PAIR)), "laundry-list"),
        ((F.size(short_forms) > 0) & (e == ""), "abbrev-no-extra"),
        (is_blank(e), "empty-extra"))


def ledger(notes: DataFrame) -> DataFrame:
    """(nid, flags, n_flags, len_text, len_extra)."""
    return notes.select(
        "nid", structural_flags().alias("flags"),
        F.length(text("text")).alias("len_text"),
        F.length(text("extra")).alias("len_extra"),
    ).withColumn("n_flags", F.size("flags"))


# ---- F4 -----------------------------------------------------------------------------------

def source_attribution(c, brand: str | None = None, quiet_before=V.BRAND_QUIET_BEFORE,
                       quiet_after=V.BRAND_QUIET_AFTER) -> Column:
    """Snippets that name a source: attribution wording, then bare brand mentions.

    A brand mention next to a domain word, or inside an attribution, is left alone.
    """
    def find(t: Column) -> Column:
        spans = with_offsets(t, ATTRIBUTION)
        hits = F.transform(spans, lambda s: strip(s["m"]))
        if not brand:
            return hits
        literal = "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in brand)
        name = rf"(?iU)\b{literal}\b(?!\s+(?:{any_of(quiet_after)}))"
        domain = F.array(*[F.lit(w) for w in quiet_before])

        def loud(b: Column) -> Column:
            before = words_of(F.substr(t, F.lit(1), b["start"]))
            last = F.btrim(F.lower(F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit(""))),
                           F.lit("(\"'"))
            inside = F.exists(spans, lambda s: (s["start"] <= b["start"]) & (
                b["start"] < s["start"] + F.length(s["m"])))
            return ~F.array_contains(domain, last) & ~inside

        def quote(b: Column) -> Column:
            lo = F.greatest(b["start"] - 30, F.lit(0))
            size = b["start"] + F.length(b["m"]) + 30 - lo
            return F.concat(F.lit("..."), strip(F.substr(t, lo + 1, size)), F.lit("..."))

        return F.concat(hits, F.transform(F.filter(with_offsets(t, name), loud), quote))

    return bind(F.regexp_replace(text(c), TAG, " "), find)


def attribution_hits(notes: DataFrame, brand: str | None = None) -> DataFrame:
    """(nid, field, hit) over both fields."""
    fields = F.array(
        F.struct(F.lit("Text").alias("field"),
                 source_attribution("text", brand).alias("hits")),
        F.struct(F.lit("Extra").alias("field"),
                 source_attribution("extra", brand).alias("hits")))
    return (notes.select("nid", F.explode(fields).alias("f"))
            .select("nid", "f.field", F.explode("f.hits").alias("hit")))


# ---- F5 .. F12 ------------------------------------------------------------------------------

def is_procedural(front="text") -> Column:
    t = plain(front)
    return F.regexp_like(t, F.lit(DIRECTION)) & F.regexp_like(t, F.lit(PROCEDURE_VERB))


def dose_without_drug(front="text", back="extra") -> Column:
    both = F.concat(plain(front), F.lit(" "), plain(back))
    return bind(both, lambda b: F.regexp_like(b, F.lit(WEIGHT_DOSE))
                & ~F.regexp_like(b, F.lit(DRUG)))


def certainty_on_measure(c) -> Column:
    """Snippets in which a certainty word is followed by a digit within 60 characters."""
    def find(t: Column) -> Column:
        def quote(h: Column) -> Column:
            lo = F.greatest(h["start"] - 28, F.lit(0))
            return shorten(F.substr(t, lo + 1, h["start"] + F.length(h["m"]) + 52 - lo), 92)
        return F.transform(with_offsets(t, CERTAIN_MEASURE), quote)
    return bind(plain(c), find)


def certainty_hits(notes: DataFrame) -> DataFrame:
    """(nid, field, hit) over both fields."""
    fields = F.array(
        F.struct(F.lit("Text").alias("field"), certainty_on_measure("text").alias("hits")),
        F.struct(F.lit("Extra").alias("field"), certainty_on_measure("extra").alias("hits")))
    return (notes.select("nid", F.explode(fields).alias("f"))
            .select("nid", "f.field", F.explode("f.hits").alias("hit")))


def provenance_blank(textbook="textbook", tags="tags") -> Column:
    return flag_list((is_blank(textbook), "no textbook"), (is_blank(tags), "no tags"))


def is_cross_reference(sentence) -> Column:
    return F.regexp_like(text(sentence), F.lit(CONTRAST))


def supported_source(extension, allowed=V.SOURCE_EXTENSIONS) -> Column:
    return F.lower(text(extension)).isin(*allowed)


def supported_folders(files: DataFrame) -> DataFrame:
    """Folders that hold at least one supported file, from (folder, extension) rows."""
    return files.where(supported_source("extension")).select("folder").distinct()


def validate_registry(modules: DataFrame) -> DataFrame:
    """(problem, item): duplicate names and negative counters."""
    names = (modules.where(F.col("name").isNotNull()).groupBy("name").count()
             .where("count > 1")
             .select(F.lit("duplicate name").alias("problem"), F.col("name").alias("item")))
    bad = modules.where((F.col("cards_before") < 0) | (F.col("cards_after") < 0)).select(
        F.lit("negative count").alias("problem"), F.col("name").alias("item"))
    return names.unionByName(bad)


# Fixed: the keys of a registry file and what each must be.
STATE_LISTS = ("modules", "pending_modules", "session_log")
STATE_OBJECTS = ("paths",)
STATE_COUNTS = ("run_count",)


def validate_state(states: DataFrame) -> DataFrame:
    """(path, problem, item): registry files (path, text) whose keys have the wrong type.

    A key that is not there is right. A file that is no JSON object has that one problem.
    """
    read = states.select("path", F.try_parse_json("text").alias("v"))
    kind = F.schema_of_variant("v")

    def of(key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("v", f"$.{key}", "variant"))

    def problem(says: str, key: str, wrong: Column) -> Column:
        return F.when(wrong, F.struct(F.lit(says).alias("problem"), F.lit(key).alias("item")))

    count = F.try_variant_get("v", "$.run_count", "decimal(38,0)")
    found = F.array_compact(F.array(
        *[problem("not a list", k, ~of(k).startswith("ARRAY")) for k in STATE_LISTS],
        *[problem("not an object", k, ~of(k).startswith("OBJECT")) for k in STATE_OBJECTS],
        *[problem("not a count", k, (of(k) != "BIGINT") | (count < 0)) for k in STATE_COUNTS]))
    whole = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
    every = F.when(whole, found).otherwise(F.array(F.struct(
        F.lit("not an object").alias("problem"), F.lit("").alias("item"))))
    return read.select("path", F.inline(every))


def attribute_head(attribute="attribute") -> Column:
    return F.substring_index(attribute, "[", 1)


def is_checkable(attribute="attribute") -> Column:
    return (attribute_head(attribute).isin(*V.CHECKABLE_HEADS, *V.CHECKABLE_FAMILIES)
            | F.col(attribute).contains("dose"))


def is_measured(attribute="attribute") -> Column:
    """Measured attributes carry a family in brackets and are not counts."""
    return F.col(attribute).contains("[") & ~F.col(attribute).startswith("count")

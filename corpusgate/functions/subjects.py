"""Subject phrases: finding them, singular forms and the canonical spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgate.functions import values as V
from corpusgate.functions.base import (all_matches, any_of, bind, lookup_map, text,
                                       whole_word, with_offsets, word_list)


def phrase_pattern(heads=V.HEAD_NOUNS) -> str:
    """Up to three words and a head noun, with an optional plural ending."""
    return rf"(?iU)\b((?:[A-Za-z][A-Za-z0-9'-]*\s+){{0,3}}(?:{any_of(heads)})e?s?)\b"


PHRASE = phrase_pattern()
DEFINITION = r"(?U)\b((?:[A-Z][A-Za-z-]+\s+){1,3})\(([A-Z]{2,6})\)"
TECHNIQUE = rf"(?iU)\b(?:{any_of(V.TECHNIQUE_NOUNS)})$"
PROCEDURE = rf"(?iU)\b(?:{any_of(V.PROCEDURE_NOUNS)})$"
QUANTITY = rf"(?iU)\b(?:{any_of(V.QUANTITY_NOUNS)})$"
LEADING_VERB = rf"(?U)^(?:{any_of(V.LEADING_VERBS)})\w*$"
REGION = whole_word(V.REGIONS)
PREPOSITION_BEFORE = (rf"(?iU)\b(?:{any_of(V.PREPOSITIONS_BEFORE)})\s+"
                      r"(?:the|a|an|its|their)?\s*$")
PREPOSITION_LEADS = rf"(?iU)^\s*(?:{any_of(V.PREPOSITIONS_LEADING)})\s"


def subject_phrases(c, heads=V.HEAD_NOUNS) -> Column:
    """ARRAY<STRING> of the phrases of a text."""
    return all_matches(text(c), phrase_pattern(heads), 1)


def subject_mentions(c) -> Column:
    """ARRAY<STRUCT<start, m, g1 phrase>>."""
    return with_offsets(c, PHRASE, 1)


def singular(c) -> Column:
    """Careful singular: short words and words in -ss/-us/-is/-as/-os stay."""
    def rule(t: Column) -> Column:
        n = F.length(t)
        return (F.when((n < 5) | F.regexp_like(t, F.lit("(?:ss|us|is|as|os)$")), t)
                .when(t.endswith("ies"), F.concat(F.substr(t, F.lit(1), n - 3), F.lit("y")))
                .when(F.regexp_like(t, F.lit("[sxzhc]es$")), F.substr(t, F.lit(1), n - 2))
                .when(t.endswith("s"), F.substr(t, F.lit(1), n - 1))
                .otherwise(t))
    return bind(c, rule)


def norm_subject(c) -> Column:
    """Canonical subject of a phrase.

    Positional adjectives are dropped from techniques only; leading verbs go while
    another token remains.
    """
    roman = lookup_map(V.ROMAN)
    always = word_list(V.QUALIFIERS + V.FUNCTION_WORDS)
    technique = word_list(V.QUALIFIERS + V.FUNCTION_WORDS + V.POSITIONAL)
    cleaned = F.regexp_replace(F.lower(F.trim(text(c))), r"(?U)[^a-z0-9\s-]", " ")
    tokens = F.transform(F.filter(F.split(cleaned, r"(?U)\s+"), lambda t: t != ""),
                         lambda t: singular(F.coalesce(roman[t], t)))

    def keep(toks: Column) -> Column:
        is_technique = F.regexp_like(F.array_join(toks, " "), F.lit(TECHNIQUE))
        return F.when(is_technique, F.filter(toks, lambda t: ~F.array_contains(technique, t))
                      ).otherwise(F.filter(toks, lambda t: ~F.array_contains(always, t)))

    def drop_verbs(toks: Column) -> Column:
        flags = F.transform(toks, lambda t: F.regexp_like(t, F.lit(LEADING_VERB)))
        first = F.array_position(flags, False)
        start = F.when(first > 0, first).otherwise(F.greatest(F.size(toks), F.lit(1)))
        return F.slice(toks, start.cast("int"), F.greatest(F.size(toks), F.lit(1)))

    return F.array_join(bind(bind(tokens, keep), drop_verbs), " ")


def token_count(c) -> Column:
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))


def is_procedure(c) -> Column:
    return F.regexp_like(c, F.lit(PROCEDURE))


def is_technique(c) -> Column:
    return F.regexp_like(c, F.lit(TECHNIQUE))


def is_quantity(c) -> Column:
    return F.regexp_like(c, F.lit(QUANTITY))


def follows_preposition(sentence: Column, start: Column, phrase: Column) -> Column:
    """Whether a phrase stands behind, or begins with, a preposition."""
    lo = F.greatest(start - 14, F.lit(0))
    before = F.substr(sentence, (lo + 1).cast("int"), (start - lo).cast("int"))
    return (F.regexp_like(before, F.lit(PREPOSITION_BEFORE))
            | F.regexp_like(phrase, F.lit(PREPOSITION_LEADS)))

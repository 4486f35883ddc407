"""Numbers, units, levels, counts and category members found in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgate.functions import values as V
from corpusgate.functions.base import (WS, all_matches, any_of, bind, lookup_map, text,
                                       whole_word, with_offsets)
from corpusgate.functions.text import CLOZE_LINE, TAG

NUMBER = r"[0-9]+(?:\.[0-9]+)?"
TOPIC_NUMBER = (rf"({NUMBER}){WS}*(?:-{WS}*{NUMBER}{WS}*)?({any_of(V.TOPIC_UNITS)})")
LEVEL_TOKEN = r"\b([ctl][0-9]{1,2})\b"
LEVEL_ONLY = r"^[ctl][0-9]{1,2}$"
INVENTORY_NUMBER = rf"(?i){NUMBER}{WS}*(?:{any_of(V.INVENTORY_UNITS)})"
MEASURE = (rf"(?iU)(?<![\w.])({NUMBER}(?:\s*(?:-|–|—|to)\s*{NUMBER})?)\s*"
           rf"({any_of(V.CLAIM_UNITS)})")
LEVEL = (r"(?U)\b([TLCS][0-9]{1,2})\s*(?:-|–|—|to|through)\s*([TLCS]?[0-9]{1,2})\b"
         r"|\b([TLCS][0-9]{1,2})\b")
COUNT = (rf"(?iU)\b({any_of(V.NUMBER_WORDS)}|[0-9]{{1,2}})\s+"
         rf"({any_of(V.COUNTABLES)})\b")


def fact_text(c) -> Column:
    """Lower-cased text with cloze markup and tags removed, as facts are read from it."""
    shown = F.regexp_replace(text(c), CLOZE_LINE, "$1")
    return F.lower(F.regexp_replace(shown, TAG, " "))


def numeric_facts(c, litre_alias: bool = True) -> Column:
    """Distinct number+unit facts and level tokens of `fact_text`.

    A hyphen range contributes its low end only. `litre_alias` folds "l" into "ml".
    """
    aliases = [p for p in V.TOPIC_UNIT_ALIASES if litre_alias or p[0] != "l"]
    table = lookup_map(aliases)
    units = F.transform(all_matches(col_of(c), TOPIC_NUMBER, 2),
                        lambda u: F.coalesce(table[u], u))
    facts = F.zip_with(all_matches(col_of(c), TOPIC_NUMBER, 1), units,
                       lambda n, u: F.concat(n, u))
    levels = all_matches(col_of(c), "(?U)" + LEVEL_TOKEN, 1)
    return F.array_distinct(F.concat(facts, levels))


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def corpus_numbers(c) -> Column:
    """Distinct number+unit strings without inner white space, lower-cased."""
    return F.array_distinct(F.transform(
        all_matches(text(c), INVENTORY_NUMBER, 0),
        lambda m: F.regexp_replace(F.lower(m), WS + "+", "")))


def expand_abbreviations(c, pairs=V.ABBREVIATIONS) -> Column:
    """Append long forms of short words and short forms of long phrases, in order."""
    def widen(short: str, full: str):
        def step(t: Column) -> Column:
            whole = t.contains(short) & F.regexp_like(t, F.lit(rf"(?U)\b{short}\b"))
            long = F.concat(t, F.when(whole, F.lit(" " + full)).otherwise(""))
            # The long form is there either because it was, or because it was just added.
            both = whole | t.contains(full)
            return F.concat(long, F.when(both, F.lit(" " + short)).otherwise(""))
        return step

    def chain(t: Column) -> Column:
        for short, full in pairs:
            t = bind(t, widen(short, full))
        return t

    shorts, longs = any_of(p[0] for p in pairs), any_of(p[1] for p in pairs)
    start = col_of(c)
    return F.when(F.regexp_like(start, F.lit(rf"(?U)\b(?:{shorts})\b|{longs}")),
                  chain(start)).otherwise(start)


def format_number(c) -> Column:
    """Shortest general form with at most six significant digits."""
    def render(x: Column) -> Column:
        exponent = F.when(x == 0, 0).otherwise(F.floor(F.log10(F.abs(x)))).cast("int")
        shift = F.pow(F.lit(10.0), (F.lit(5) - exponent).cast("double"))
        scaled = F.rint(x * shift)
        carried = F.when(F.abs(scaled) >= 1e6, exponent + 1).otherwise(exponent)
        value = scaled / shift
        fixed = F.regexp_replace(F.regexp_replace(
            F.format_string("%.10f", value), "0+$", ""), r"\.$", "")
        mantissa = F.regexp_replace(F.regexp_replace(F.format_string(
            "%.5f", value / F.pow(F.lit(10.0), carried.cast("double"))), "0+$", ""), r"\.$", "")
        power = F.format_string("%02d", F.abs(carried))
        sign = F.when(carried < 0, "e-").otherwise("e+")
        return F.when((carried < -4) | (carried >= 6),
                      F.concat(mantissa, sign, power)).otherwise(fixed)
    return bind(c.cast("double"), render)


def norm_range(c) -> Column:
    """Numbers of a value in canonical form, joined by "-"; other text is trimmed."""
    numbers = F.transform(all_matches(text(c), NUMBER, 0), format_number)
    return F.when(F.size(numbers) > 0, F.array_join(numbers, "-")).otherwise(F.trim(text(c)))


def unit_family(c) -> Column:
    """Measured family of a unit; an unknown unit is its own family."""
    unit = F.lower(text(c))
    return F.coalesce(lookup_map(V.UNIT_FAMILIES)[F.rtrim(F.regexp_replace(unit, r"\.+$", ""))],
                      unit)


def span_mm(value, unit) -> Column:
    """STRUCT<lo, hi> in millimetres; null for a unit that is not a length."""
    factor = lookup_map(V.MILLIMETRES)[F.lower(text(unit))]
    numbers = F.transform(all_matches(text(value), NUMBER, 0), lambda n: n.cast("double"))
    return F.when(factor.isNotNull() & (F.size(numbers) > 0), F.struct(
        (F.array_min(numbers) * factor).alias("lo"),
        (F.array_max(numbers) * factor).alias("hi")))


def _cue(cues) -> str:
    return "(?U)" + any_of(cues)


def attribute_for(sentence, pos, rules=V.ATTRIBUTE_CUES) -> Column:
    """First rule whose cue lies near the claim, else the first one in the sentence."""
    whole = F.lower(text(sentence))
    lo = F.greatest(pos - 90, F.lit(0))
    window = F.lower(F.substr(text(sentence), (lo + 1).cast("int"),
                              (pos + 40 - lo).cast("int")))

    def first_rule(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, cues in reversed(rules):
            out = F.when(F.regexp_like(t, F.lit(_cue(cues))), F.lit(name)).otherwise(out)
        return out

    return F.coalesce(bind(window, first_rule), bind(whole, first_rule))


def measures(c) -> Column:
    """ARRAY<STRUCT<start, m, g1 value, g2 unit>>."""
    return with_offsets(c, MEASURE, 2)


def level_tokens(c) -> Column:
    """ARRAY<STRUCT<start, m, g1, g2, g3>>, empty when three or more are enumerated."""
    return bind(with_offsets(c, LEVEL, 3), lambda a: F.when(F.size(a) < 3, a).otherwise(
        F.slice(a, 1, 0)))


def level_name(token: Column) -> Column:
    return F.upper(F.when(token["g3"] != "", token["g3"]).otherwise(
        F.concat_ws("-", token["g1"], token["g2"])))


def count_claims(c) -> Column:
    """ARRAY<STRUCT<start, m, g1 number, g2 noun>>."""
    return with_offsets(c, COUNT, 2)


def count_value(number: Column) -> Column:
    table = lookup_map((w, str(i)) for i, w in enumerate(V.NUMBER_WORDS, start=1))
    return F.coalesce(table[F.lower(number)], F.lower(number))


def count_noun(noun: Column) -> Column:
    return F.regexp_replace(F.lower(noun), "s+$", "")


def category_members(sentence, families=V.FAMILIES) -> Column:
    """ARRAY<STRUCT<family, member>>: families with exactly one member in the sentence.

    A sentence that names several members describes a set and claims nothing.
    """
    s = text(sentence)
    low = F.lower(s)
    context = {
        "needle-direction": F.regexp_like(s, F.lit(whole_word(V.PROCEDURE_VERBS))),
        "needle-type": F.regexp_like(low, F.lit(V.NEEDLE_CONTEXT)),
        "body-position": F.regexp_like(low, F.lit("(?U)" + V.POSITION_CONTEXT)),
        "limb-position": F.regexp_like(low, F.lit("(?U)" + V.POSITION_CONTEXT)),
    }
    def single(family: str):
        return lambda p: F.when(
            (F.size(p) == 1) & context.get(family, F.lit(True)),
            F.struct(F.lit(family).alias("family"), p[0].alias("member")))

    out = []
    for family, members in families:
        present = F.array_compact(F.array(*[
            F.when(low.contains(m) & F.regexp_like(low, F.lit(rf"(?U)\b{m}\b")), F.lit(m))
            for m in members]))
        out.append(bind(present, single(family)))
    return F.array_compact(F.array(*out))

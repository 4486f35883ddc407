"""Small building blocks shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as white space, spelled out so that Spark and any other
# SQL engine agree on it.
WS = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
NOT_WS = WS.replace("[", "[^", 1)
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680,
                             *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BLOCK = 128  # matches whose offsets are added up together


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Missing text is blank text."""
    return F.coalesce(col(c), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column | str) -> Column:
    return strip(text(c)) == ""


def any_of(words: Iterable[str]) -> str:
    return "|".join(words)


def whole_word(words: Iterable[str], flags: str = "(?iU)") -> str:
    """A pattern for any of `words` between Unicode word boundaries."""
    return rf"{flags}\b(?:{any_of(words)})\b"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `use`, which may refer to it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def lookup_map(pairs: Iterable[tuple[str, object]]) -> Column:
    """A literal map of a small in-code table."""
    pairs = list(pairs)
    if all(isinstance(v, str) for _k, v in pairs):
        packed = "\x02".join(f"{k}\x03{v}" for k, v in pairs)
        return F.str_to_map(F.lit(packed), F.lit("\x02"), F.lit("\x03"))
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def word_list(words: Iterable[str]) -> Column:
    """A literal array of strings, folded into one constant by the optimizer."""
    return F.split(F.lit("\x02".join(words)), "\x02")


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def count_matches(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def count_literal(c: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal string."""
    removed = F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("int")


def words_of(c: Column) -> Column:
    """Tokens between white space, blanks dropped."""
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


def with_offsets(c: Column, pattern: str, groups: int = 0) -> Column:
    """Every match with its 0-based start: ARRAY<STRUCT<start, m, g1..gn>>.

    The text between matches comes from splitting on the same pattern, so the start of
    match k is the length of the first k+1 gaps plus the length of the first k matches.
    Groups are read from the match alone; patterns must not need text around it for them.

    Adding to an array copies it, so matches are placed within blocks of BLOCK and the
    blocks are placed after one another: the cost is linear in the number of matches until
    a text has some millions of them.
    """
    fields = "".join(f",g{i}:string" for i in range(1, groups + 1))
    empty = F.array().cast(f"array<struct<start:int,m:string{fields}>>")
    none_placed = F.struct(F.lit(0).alias("pos"),
                           F.array().cast("array<struct<start:int,m:string>>").alias("out"))

    def place(acc: Column, step: Column) -> Column:
        start = acc["pos"] + step["gap"]
        item = F.struct(start.alias("start"), step["m"].alias("m"))
        return F.struct((start + F.length(step["m"])).alias("pos"),
                        F.concat(acc["out"], F.array(item)).alias("out"))

    def add_base(acc: Column, block: Column) -> Column:
        return F.struct((acc["pos"] + block["pos"]).alias("pos"),
                        F.concat(acc["out"], F.array(acc["pos"])).alias("out"))

    def join_blocks(blocks: Column) -> Column:
        bases = F.aggregate(blocks, F.struct(F.lit(0).alias("pos"),
                                             F.array().cast("array<int>").alias("out")), add_base)
        return F.flatten(F.zip_with(blocks, bases["out"], lambda block, base: F.transform(
            block["out"], lambda s: F.struct(
                (s["start"] + base).alias("start"), s["m"].alias("m"), *[
                    F.regexp_extract(s["m"], pattern, g).alias(f"g{g}")
                    for g in range(1, groups + 1)]))))

    def in_blocks(steps: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1)), F.lit(BLOCK))
        return bind(F.transform(firsts, lambda i: F.aggregate(
            F.slice(steps, i, F.lit(BLOCK)), none_placed, place)), join_blocks)

    def build(t: Column) -> Column:
        def offsets(found: Column) -> Column:
            steps = F.filter(F.zip_with(F.split(t, pattern, -1), found, lambda g, m: F.struct(
                F.length(g).alias("gap"), m.alias("m"))), lambda s: s["m"].isNotNull())
            return F.when(F.size(found) > 0, bind(steps, in_blocks)).otherwise(empty)
        return bind(all_matches(t, pattern, 0), offsets)

    return bind(c, build)

"""Notes as the operators expect them: unpacking fields and mapping other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.functions import values as V
from corpusgate.functions.base import is_blank, text
from corpusgate.functions.text import first_line, rest_lines

TAIL = V.NOTE_FIELDS[2:]


def unpack_fields(notes: DataFrame, packed: str = "flds") -> DataFrame:
    """Seven named fields from the packed column; short rows are padded with blanks."""
    parts = F.split(text(packed), V.FIELD_SEP)
    fields = [F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(name)
              for i, name in enumerate(V.NOTE_FIELDS)]
    return notes.select("*", *fields).drop(packed)


def pack_fields(notes: DataFrame, packed: str = "flds") -> DataFrame:
    """Inverse of `unpack_fields`."""
    joined = F.concat_ws(V.FIELD_SEP, *[text(c) for c in V.NOTE_FIELDS])
    return notes.withColumn(packed, joined).drop(*V.NOTE_FIELDS)


def tail_populated(prefix: str = "") -> list:
    """Display names of the non-blank tail fields, as an array column."""
    return F.array_compact(F.array(*[
        F.when(~is_blank(prefix + c), F.lit(V.FIELD_NAMES[i + 2]))
        for i, c in enumerate(TAIL)]))


def tail_digest(prefix: str = ""):
    """Exact identity of the five tail fields in 32 bytes instead of their full text."""
    return F.sha2(F.concat_ws(V.FIELD_SEP, *[text(prefix + c) for c in TAIL]), 256)


def notes_from_documents(documents: DataFrame) -> DataFrame:
    """First line is the front of the note, the other lines its back."""
    return documents.select(
        F.col("doc_id").alias("nid"), F.col("source").alias("deck"), "lang",
        first_line("text").alias("text"), rest_lines("text").alias("extra"))


def notes_from_conversations(conversations: DataFrame) -> DataFrame:
    """A user turn and the assistant turn that follows it make one note."""
    turn = Window.partitionBy("conv_id").orderBy("turn")
    paired = conversations.select(
        "conv_id", "turn", "role", F.col("text").alias("text"),
        F.lead("role").over(turn).alias("next_role"),
        F.lead("turn").over(turn).alias("next_turn"),
        F.lead("text").over(turn).alias("extra"))
    return (paired
            .where((F.col("role") == "user") & (F.col("next_role") == "assistant")
                   & (F.col("next_turn") == F.col("turn") + 1))
            .select((F.col("conv_id") * 1000 + F.col("turn")).alias("nid"),
                    F.concat(F.lit("conv"), F.pmod("conv_id", F.lit(10)).cast("string"))
                    .alias("deck"), "text", "extra"))

"""Cross-deck topics by inverse document frequency, and the corpus inventory.

A topic groups every note that touches a rare term or a number with a unit, so notes
meet through an inverted index and are never compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.functions import values as V
from corpusgate.functions.base import text
from corpusgate.functions.facts import (LEVEL_ONLY, corpus_numbers, expand_abbreviations,
                                        fact_text, numeric_facts)
from corpusgate.functions.text import TAG, CLOZE_LINE, ascii_terms, content_terms
from corpusgate.operators.skew import lookup_stored
from corpusgate.session import materialize

TOP_TERMS = 6
MIN_IDF = 1.5
MIN_CARDS, MAX_CARDS, MIN_DECKS = 2, 60, 2
DEPTH, WIDTH = 4, 1 << 17     # hashes and cells of a frequency sketch


def fingerprints(notes: DataFrame, abbreviations=V.ABBREVIATIONS,
                 stop=V.STOP_WORDS, litre_alias: bool = True) -> DataFrame:
    """(deck, nid, nums, terms); notes without any term are dropped.

    Every later step reads this table, so it is written once: the text is parsed once
    and topics read only the column they need.
    """
    joined = notes.select("deck", "nid", fact_text(
        F.concat_ws(" ", text("text"), text("extra"))).alias("_t"))
    wide = joined.withColumn("_w", expand_abbreviations("_t", abbreviations))
    prints = wide.select("deck", "nid", numeric_facts("_t", litre_alias).alias("nums"),
                         content_terms("_w", 3, stop).alias("terms"))
    # Filtering before the write would evaluate the terms twice.
    return materialize(prints, "fingerprints").where(F.size("terms") > 0)


def term_prints(notes: DataFrame, abbreviations=V.ABBREVIATIONS, stop=V.STOP_WORDS) -> DataFrame:
    """`fingerprints` without the numbers, for steps that only count terms."""
    wide = notes.select("deck", "nid", expand_abbreviations(
        fact_text(F.concat_ws(" ", text("text"), text("extra"))), abbreviations).alias("_w"))
    prints = wide.select("deck", "nid", content_terms("_w", 3, stop).alias("terms"))
    return materialize(prints, "terms").where(F.size("terms") > 0)


def term_rows(prints: DataFrame) -> DataFrame:
    return prints.select("deck", "nid", F.explode("terms").alias("term"))


def document_frequency(terms: DataFrame) -> DataFrame:
    """(term, df) from one row per note and term."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def with_idf(frequency: DataFrame, prints: DataFrame) -> DataFrame:
    """Adds idf = ln(N / (1 + df)), N the number of fingerprinted notes."""
    total = prints.agg(F.count(F.lit(1)).alias("n")).scalar()
    return frequency.withColumn("idf", F.log(total / (1 + F.col("df"))))


# ---- sketches -----------------------------------------------------------------------------------

def frequency_sketch(rows: DataFrame, column: str = "term", depth: int = DEPTH,
                     width: int = WIDTH) -> DataFrame:
    """(deck, line, cell, n): a Count-Min sketch of a column per deck, as a table.

    Each of `depth` hashes counts a row in one of `width` cells, so a deck has at most
    depth * width rows, whatever the number of terms, and tasks send no more than that.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("line"), _cell(column, i, width).alias("cell"))
                      for i in range(depth)])
    return rows.select("deck", F.explode(cells).alias("c")).groupBy("deck", "c.line", "c.cell").agg(
        F.count(F.lit(1)).alias("n"))


def _cell(column: str, line: int, width: int):
    return F.pmod(F.xxhash64(F.lit(line), F.col(column)), F.lit(width)).cast("int")


def merge_sketches(*sketches: DataFrame) -> DataFrame:
    """The sketch of all rows that several sketches have counted, of snapshots for instance."""
    rows = sketches[0]
    for other in sketches[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("deck", "line", "cell").agg(F.sum("n").alias("n"))


def with_estimates(rows: DataFrame, sketch: DataFrame, column: str, n_rows: str,
                   n_decks: str | None = None, depth: int = DEPTH,
                   width: int = WIDTH) -> DataFrame:
    """`rows` with the estimated number of rows, and of decks, that hold their value.

    An estimate is never below the truth; with probability 1 - exp(-depth) it is above it by
    at most e / width of all rows counted. Looking up takes no shuffle: the cells are `depth`
    dense arrays of `width` numbers, 8 MB at most with the defaults.
    """
    whole = sketch.groupBy("line", "cell").agg(F.sum("n").alias("n"),
                                               F.countDistinct("deck").alias("decks"))
    places = rows.sparkSession.range(width).select(F.col("id").cast("int").alias("cell"))
    every = places.withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    filled = every.join(whole, ["line", "cell"], "left").groupBy("line").agg(
        F.sort_array(F.collect_list(F.struct("cell", F.coalesce("n", F.lit(0)).alias("n"),
                                             F.coalesce("decks", F.lit(0)).alias("decks")))).alias("x"))
    dense = materialize(filled.select(
        "line", F.transform("x", lambda c: c["n"]).alias("n"),
        F.transform("x", lambda c: c["decks"]).alias("decks")), "sketch")

    def least(value: str):
        return F.least(*[F.get(dense.where(F.col("line") == i).select(value).scalar(),
                               _cell(column, i, width)) for i in range(depth)])

    out = rows.withColumn(n_rows, least("n"))
    return out.withColumn(n_decks, least("decks")) if n_decks else out


def rarest_terms(prints: DataFrame, k: int = TOP_TERMS, min_idf: float = MIN_IDF,
                 approx: bool = False) -> DataFrame:
    """(deck, nid, term, df, idf): the k rarest terms of each note with idf > min_idf.

    Terms at or below `min_idf` always rank behind every term that is kept, so leaving
    them out before ranking changes nothing. Rare ones stay: they fill the k places.
    With `approx`, frequencies are those of a sketch and no term is shuffled.
    """
    rows = term_rows(prints)
    if approx:
        scored = with_idf(with_estimates(rows, frequency_sketch(rows), "term", "df"), prints)
        scored = scored.where(F.col("idf") > min_idf)
    else:
        # Frequent terms, those of too small an idf too, are told in place and never move.
        known = materialize(with_idf(document_frequency(rows), prints), "frequencies")
        scored = lookup_stored(rows, known, "term", "df").where(F.col("idf") > min_idf)
    rank = Window.partitionBy("nid").orderBy(F.col("df"), F.col("term"))
    return scored.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= k).drop("_r")


def topic_rows(prints: DataFrame, k: int = TOP_TERMS, min_idf: float = MIN_IDF,
               approx: bool = False) -> DataFrame:
    """(topic, deck, nid): rare terms, and numbers bound to a unit as "#number"."""
    words = rarest_terms(prints, k, min_idf, approx).select(F.col("term").alias("topic"), "deck", "nid")
    numbers = (prints.select("deck", "nid", F.explode("nums").alias("n"))
               .where(~F.col("n").rlike(LEVEL_ONLY))
               .select(F.concat(F.lit("#"), "n").alias("topic"), "deck", "nid"))
    return words.unionByName(numbers)


def topic_sizes(rows: DataFrame, min_decks: int = MIN_DECKS, min_cards: int = MIN_CARDS,
                max_cards: int = MAX_CARDS) -> DataFrame:
    """(topic, n_cards, n_decks) of the topics worth reading.

    Counting per (topic, deck) first keeps a hot topic spread over its decks.
    """
    per_deck = rows.groupBy("topic", "deck").agg(F.count(F.lit(1)).alias("n"))
    return (per_deck.groupBy("topic")
            .agg(F.sum("n").alias("n_cards"), F.count(F.lit(1)).alias("n_decks"))
            .where((F.col("n_decks") >= min_decks)
                   & F.col("n_cards").between(min_cards, max_cards)))


def sized_members(rows: DataFrame, min_decks: int = MIN_DECKS, min_cards: int = MIN_CARDS,
                  max_cards: int = MAX_CARDS, approx: bool = False) -> DataFrame:
    """(topic, deck, nid, n_cards, n_decks): the rows of topics worth reading.

    With `approx`, sizes are those of a sketch: rows decide where they are, and hot topics
    are dropped before anything is shuffled.
    """
    limits = {"min_decks": min_decks, "min_cards": min_cards, "max_cards": max_cards}
    if not approx:
        return rows.join(topic_sizes(rows, **limits), "topic")
    sized = with_estimates(rows, frequency_sketch(rows, "topic"), "topic", "n_cards", "n_decks")
    return sized.where((F.col("n_decks") >= min_decks)
                       & F.col("n_cards").between(min_cards, max_cards))


def topics(notes: DataFrame, prints: DataFrame | None = None, approx: bool = False,
           **limits) -> DataFrame:
    """(topic, n_cards, n_decks, decks, cards): full worklist, at most 60 cards a topic.

    The text is taken of notes that are members only. With `approx`, frequencies and sizes
    are estimates from above (see `with_estimates`); the exact form is the default.
    """
    prints = fingerprints(notes) if prints is None else prints
    rows = materialize(topic_rows(prints, approx=approx), "topic-rows")
    members = materialize(sized_members(rows, approx=approx, **limits), "members")
    texts = notes.select("nid", "text").join(members.select("nid").distinct(), "nid", "left_semi")
    cards = members.join(texts, "nid")
    entry = F.struct("deck", "nid", "text")
    return (cards.groupBy("topic", "n_cards", "n_decks")
            .agg(F.sort_array(F.collect_set("deck")).alias("decks"),
                 F.sort_array(F.collect_list(entry)).alias("cards")))


def topic_order(worklist: DataFrame, limit: int | None = None) -> DataFrame:
    """Most decks first, then most cards, then the topic itself."""
    ordered = worklist.orderBy(F.desc("n_decks"), F.desc("n_cards"), "topic")
    return ordered.limit(limit) if limit else ordered


def topic_members(notes: DataFrame, **limits) -> DataFrame:
    """(topic, deck, nid): the notes behind each topic of the worklist."""
    rows = materialize(topic_rows(fingerprints(notes)), "topic-rows")
    return rows.join(topic_sizes(rows, **limits).select("topic"), "topic")


# ---- corpus inventory -------------------------------------------------------------------------

def _held_items(notes: DataFrame, stop, *more: str) -> DataFrame:
    """(kind, item, more...): a row per note and distinct term or number."""
    shown = F.regexp_replace(F.concat_ws(" ", text("text"), text("extra")), CLOZE_LINE, "$1")
    body = notes.select(*more, F.regexp_replace(shown, TAG, " ").alias("_b"))
    return body.select(*more, F.explode(F.concat(
        F.transform(ascii_terms("_b", 5, stop),
                    lambda t: F.struct(F.lit("term").alias("kind"), t.alias("item"))),
        F.transform(corpus_numbers("_b"),
                    lambda n: F.struct(F.lit("number").alias("kind"), n.alias("item")))
    )).alias("i")).select("i.kind", "i.item", *more)


def inventory_items(notes: DataFrame, stop=V.STOP_WORDS_INVENTORY) -> DataFrame:
    """(kind, item, deck, n): notes of each deck that hold each term and number."""
    return _held_items(notes, stop, "deck").groupBy("kind", "item", "deck").agg(
        F.count(F.lit(1)).alias("n"))


def lost_without(notes: DataFrame, kept: str, stop=V.STOP_WORDS_INVENTORY) -> DataFrame:
    """(kind, item) that no note with the boolean `kept` holds: `lost_items` where what stays is
    known by note, so that every text is read once."""
    held = _held_items(notes, stop, kept).groupBy("kind", "item").agg(F.bool_or(kept).alias("_kept"))
    return held.where(~F.coalesce("_kept", F.lit(False))).select("kind", "item")


def deck_counts(notes: DataFrame) -> DataFrame:
    return notes.groupBy("deck").agg(F.count(F.lit(1)).alias("n"))


def deck_items(notes: DataFrame) -> DataFrame:
    """The ("deck", deck) rows of a snapshot; no text is read for them."""
    return deck_counts(notes).select(
        F.lit("deck").alias("kind"), F.col("deck").alias("item"), "deck", "n")


def corpus_inventory(notes: DataFrame) -> DataFrame:
    """Snapshot in long form: terms and numbers, plus one ("deck", deck) row per deck."""
    return inventory_items(notes).unionByName(deck_items(notes))


def lost_items(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, item) present before and nowhere after; both must be empty to pass."""
    def pick(snap):
        return snap.where(F.col("kind") != "deck").select("kind", "item")
    return pick(before).subtract(pick(after))


def deck_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(deck, before, after, shrank) side by side."""
    b = before.where("kind = 'deck'").select("deck", F.col("n").alias("before"))
    a = after.where("kind = 'deck'").select("deck", F.col("n").alias("after"))
    both = b.join(a, "deck", "full")
    return both.select("deck", F.coalesce("before", F.lit(0)).alias("before"),
                       F.coalesce("after", F.lit(0)).alias("after")).withColumn(
        "shrank", F.col("after") < F.col("before"))


def no_loss_gate(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: terms_lost, numbers_lost, pass."""
    return loss_gate(lost_items(before, after))


def loss_gate(lost: DataFrame) -> DataFrame:
    """One row: terms_lost, numbers_lost, pass, of (kind, item) rows."""
    return lost.agg(
        F.count_if(F.col("kind") == "term").alias("terms_lost"),
        F.count_if(F.col("kind") == "number").alias("numbers_lost"),
    ).withColumn("pass", (F.col("terms_lost") == 0) & (F.col("numbers_lost") == 0))


def deck_term_loss(original: DataFrame, final: DataFrame) -> DataFrame:
    """(term) hyphenated terms of the original that the final deck no longer has."""
    def terms(notes):
        shown = F.regexp_replace(F.concat_ws(" ", text("text"), text("extra")), TAG, "")
        return notes.select(F.explode(content_terms(shown, 5, (), hyphens=True))
                            .alias("term")).distinct()
    return terms(original).join(terms(final), "term", "left_anti")

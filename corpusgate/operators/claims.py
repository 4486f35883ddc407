"""The claim index: extraction, subject resolution, collisions and consistency checks.

Extraction is relational. Phrases, measures, levels, counts and categories are arrays
computed per sentence by native expressions; only resolving a phrase to its canonical
subject needs the corpus, and that is a join on the phrase.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgate.functions import facts as A
from corpusgate.functions import subjects as S
from corpusgate.functions import values as V
from corpusgate.functions.base import bind, with_offsets
from corpusgate.functions.text import plain, sentences
from corpusgate.operators import rules as R
from corpusgate.operators.skew import lookup_by_key, lookup_stored
from corpusgate.session import materialize

FIELDS = (("Text", "text"), ("Extra", "extra"))
CLAIM_COLUMNS = ("deck", "nid", "field", "subject", "attribute", "value", "unit", "span",
                 "kind", "xref", "sent")


@dataclass
class Lexicon:
    """What the corpus teaches about subjects.

    subjects: (phrase, subject, n)  lower-cased phrase -> canonical subject, with its count
    abbreviations: (short, full_form)
    """
    subjects: DataFrame
    abbreviations: DataFrame


# ---- A6, P17: the lexicon -------------------------------------------------------------------

def _note_text() -> Column:
    """Front and back as one readable text."""
    return F.concat_ws(" ", plain("text"), plain("extra"))


def mined_abbreviations(notes: DataFrame) -> DataFrame:
    """(short, full_form): definitions "Long Form (LF)"; the last note and place win."""
    body = notes.select("nid", with_offsets(_note_text(), S.DEFINITION, 2).alias("d"))
    found = body.where(F.size("d") > 0).select("nid", F.explode("d").alias("d")).select(
        F.lower("d.g2").alias("short"), S.norm_subject(F.col("d.g1")).alias("full_form"),
        "nid", F.col("d.start").alias("at")).where(F.col("full_form") != "")
    return found.groupBy("short").agg(
        F.max_by("full_form", F.struct("nid", "at")).alias("full_form"))


def _expand(phrases: DataFrame, abbreviations: DataFrame, raw: str) -> DataFrame:
    """(raw, expanded): every token that is a known short form replaced by its long form.

    Works on distinct phrases, and only those that hold a known short form are split into
    tokens and put together again.
    """
    tokens = phrases.select(raw, F.posexplode(F.split(raw, " ")).alias("i", "token"))
    known = abbreviations.select(F.col("short").alias("token"), "full_form")
    hit = tokens.join(known.select("token"), "token", "left_semi").select(raw).distinct()
    rebuilt = (tokens.join(hit, raw, "left_semi").join(known, "token", "left")
               .groupBy(raw).agg(F.sort_array(F.collect_list(F.struct(
                   "i", F.coalesce("full_form", "token").alias("t")))).alias("p"))
               .select(raw, F.array_join(F.transform("p", lambda x: x["t"]), " ")
                       .alias("expanded")))
    return (phrases.join(rebuilt, raw, "left")
            .withColumn("expanded", F.coalesce("expanded", raw)))


def _lexicon_phrases(notes: DataFrame) -> DataFrame:
    """(phrase, attested, n): phrases of each note read as one text, in lower case.

    Where the front ends without a full stop a phrase may run on into the back; the two
    fields are then also read alone, as sentences will be, without counting as attested.
    """
    def tagged(phrases: Column, weight: int) -> Column:
        return F.transform(phrases, lambda p: F.struct(
            F.lower(p).alias("phrase"), F.lit(weight).alias("attested")))

    def read(front: Column, back: Column) -> Column:
        whole = tagged(S.subject_phrases(F.concat_ws(" ", front, back)), 1)
        apart = F.concat(S.subject_phrases(front), S.subject_phrases(back))
        return F.when(F.regexp_like(front, F.lit("[.!?]$")), whole).otherwise(
            F.concat(whole, tagged(apart, 0)))

    plain_notes = notes.select(plain("text").alias("_f"), plain("extra").alias("_b"), "n")
    found = plain_notes.select(F.explode(read(F.col("_f"), F.col("_b"))).alias("p"), "n")
    return found.select("p.phrase", "p.attested", "n")


def build_lexicon(notes: DataFrame) -> Lexicon:
    """Attested subjects of two to five tokens, each mapped to its shortest attested suffix.

    The suffix keeps at least two tokens, so a subject never shrinks to a bare noun.
    Parsing works on distinct notes, normalising on distinct phrases, not on every mention. Of
    notes with equal fields the last one decides, as all of them define the same.
    """
    notes = materialize(notes.groupBy("text", "extra").agg(
        F.max("nid").alias("nid"), F.count(F.lit(1)).alias("n")), "distinct-notes")
    abbreviations = materialize(mined_abbreviations(notes), "abbreviations")
    counts = (_lexicon_phrases(notes).groupBy("phrase")
              .agg(F.sum(F.col("attested") * F.col("n")).alias("attested"), F.sum("n").alias("n")))
    spelled = materialize(counts.withColumn("raw", S.norm_subject(F.col("phrase"))), "phrases")
    raws = spelled.groupBy("raw").agg(F.sum("attested").alias("attested"))
    phrases = materialize(_expand(raws, abbreviations, "raw"), "expanded")
    attested = (phrases.where((F.col("attested") > 0)
                              & S.token_count(F.col("expanded")).between(2, 5))
                .select("expanded").distinct())
    tokens = attested.select("expanded", F.split("expanded", " ").alias("t"))
    suffixes = tokens.where(F.size("t") > 2).select(
        "expanded", F.explode(F.sequence(F.lit(2), F.size("t") - 1)).alias("size"), "t").select(
        "expanded", "size", F.array_join(F.slice("t", -F.col("size"), F.col("size")), " ")
        .alias("suffix"))
    shortest = (suffixes.join(attested.select(F.col("expanded").alias("suffix")), "suffix",
                              "left_semi")
                .groupBy("expanded").agg(F.min("size").alias("size")))
    canon = shortest.join(tokens, "expanded").select("expanded", F.array_join(
        F.slice("t", -F.col("size"), F.col("size")), " ").alias("canon"))
    named = phrases.join(canon, "expanded", "left").select(
        "raw", F.coalesce("canon", "expanded").alias("subject"))
    subjects = spelled.join(named, "raw").select("phrase", "subject", "n")
    return Lexicon(materialize(subjects, "subjects"), abbreviations)


# ---- K1..K4: extraction -----------------------------------------------------------------------

def note_sentences(notes: DataFrame) -> DataFrame:
    """(deck, nid, field, sid, sent)."""
    both = F.array(*[F.struct(F.lit(name).alias("field"), sentences(plain(c)).alias("s"))
                     for name, c in FIELDS])
    return (notes.select("deck", "nid", F.explode(both).alias("f"))
            .select("deck", "nid", "f.field", F.posexplode("f.s").alias("sid", "sent")))


CANDS = "array<struct<start:int,subject:string,rank:int>>"


def distinct_sentences(sents: DataFrame) -> DataFrame:
    """(sent, n): each sentence once. What a sentence says does not depend on where it stands."""
    return materialize(sents.groupBy("sent").agg(F.count(F.lit(1)).alias("n")), "distinct-sentences")


def known_subjects(distinct: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(sent, n, cands): subjects of each distinct sentence in order, with their rank.

    0 is a strong subject, 1 one behind a preposition, 2 a bare quantity. Only what later
    steps need travels: the phrase, its place and whether it follows a preposition.
    """
    flat = (distinct.withColumn("m", F.explode(S.subject_mentions(F.col("sent"))))
            .select("sent", F.col("n").alias("copies"), F.col("m.start").alias("start"),
                    S.follows_preposition(F.col("sent"), F.col("m.start"), F.col("m.g1"))
                    .alias("weak"), F.lower("m.g1").alias("phrase")))
    named = lookup_by_key(flat, lexicon.subjects, "phrase", "n", F.col("sent"), how="left")
    # A lexicon built from other notes may lack a phrase; it is then taken as it stands.
    subject = F.coalesce("subject", S.norm_subject(F.col("phrase")))
    rank = F.when(S.is_quantity(subject), 2).when(F.col("weak"), 1).otherwise(0)
    item = F.struct("start", subject.alias("subject"), rank.alias("rank"))
    return (named.where(S.token_count(subject) >= 2)
            .groupBy("sent", F.col("copies").alias("n"))
            .agg(F.sort_array(F.collect_list(item)).alias("cands")))


def sentence_subjects(sents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(nid, field, sid, cands): `known_subjects` of every sentence."""
    sents = materialize(sents.select("nid", "field", "sid", "sent"), "sentences")
    known = materialize(known_subjects(distinct_sentences(sents), lexicon), "subjects")
    return lookup_stored(sents, known, "sent", "n").select("nid", "field", "sid", "cands")


def note_topics(cands: DataFrame) -> DataFrame:
    """(nid, topic): the first procedure of the front, else its first subject."""
    procedure = F.try_element_at(
        F.filter("cands", lambda c: S.is_procedure(c["subject"])), F.lit(1))["subject"]
    per_sentence = cands.where(F.col("field") == "Text").select(
        "nid", "sid", procedure.alias("procedure"),
        F.element_at("cands", 1)["subject"].alias("first"))
    return per_sentence.groupBy("nid").agg(
        F.min_by("procedure", F.when(F.col("procedure").isNotNull(), F.col("sid"))).alias("_p"),
        F.min_by("first", "sid").alias("_f")).select(
        "nid", F.coalesce("_p", "_f").alias("topic"))


def subject_at(sent: Column, cands: Column, pos: Column) -> Column:
    """The strongest, then nearest subject of a claim at `pos` (null: anywhere).

    Those at or before the claim are preferred; a region named in the sentence is put in
    front of an anatomical subject.
    """
    def choose(cs: Column) -> Column:
        forward = F.array_min(F.transform(cs, lambda c: F.struct(
            c["rank"].alias("rank"), c["start"].alias("start"),
            c["subject"].alias("subject"))))["subject"]
        earlier = F.transform(F.filter(cs, lambda c: c["start"] <= pos), lambda c: F.struct(
            c["rank"].alias("rank"), (-c["start"]).alias("back"),
            c["subject"].alias("subject")))
        return F.coalesce(F.array_min(earlier)["subject"], forward)

    def add_region(best: Column) -> Column:
        at = F.coalesce(pos, F.lit(0))

        def nearest(regions: Column) -> Column:
            named = F.exists(regions, lambda r: best.contains(F.lower(r["m"])))
            order = F.transform(regions, lambda r: F.struct(
                F.abs(r["start"] - at).alias("d"), r["start"].alias("s"),
                F.lower(r["m"]).alias("m")))
            return F.when((F.size(regions) > 0) & ~named & ~S.is_technique(best),
                          F.concat(F.array_min(order)["m"], F.lit(" "), best)).otherwise(best)

        return F.when(best.isNotNull(), bind(with_offsets(sent, S.REGION), nearest))

    return bind(choose(cands), add_region)


def nearest_drug(sent: Column, pos: Column) -> Column:
    """The drug named closest to a claim, null when the sentence names none."""
    order = F.transform(with_offsets(sent, R.DRUG), lambda g: F.struct(
        F.abs(g["start"] - pos).alias("d"), g["start"].alias("s"), F.lower(g["m"]).alias("m")))
    return F.array_min(order)["m"]


def sentence_claims(sent: Column) -> Column:
    """Every assertion of one sentence in the order the rules emit them, subjects apart.

    ARRAY<STRUCT<seq, at, attribute, value, unit, span, kind>>; `at` is null where the
    whole sentence is the place of the claim.
    """
    no_span = F.lit(None).cast("struct<lo:double,hi:double>")

    def claim(seq, at, attribute, value, unit=F.lit(""), span=no_span, kind="numeric"):
        return F.struct(seq.cast("bigint").alias("seq"), at.cast("int").alias("at"),
                        attribute.alias("attribute"), value.alias("value"), unit.alias("unit"),
                        F.coalesce(span, no_span).alias("span"), F.lit(kind).alias("kind"))

    def measure(m: Column, i: Column) -> Column:
        family = A.unit_family(m["g2"])
        head = F.coalesce(A.attribute_for(sent, m["start"]), family)
        return claim(i, m["start"], F.concat(head, F.lit("["), family, F.lit("]")),
                     A.norm_range(m["g1"]), m["g2"], A.span_mm(m["g1"], m["g2"]))

    rules = (
        (A.measures(sent), measure),
        (A.level_tokens(sent), lambda m, i: claim(
            i, m["start"], F.lit("spinal-level"), A.level_name(m))),
        (A.count_claims(sent), lambda m, i: claim(
            i, m["start"], F.concat(F.lit("count["), A.count_noun(m["g2"]), F.lit("]")),
            A.count_value(m["g1"]))),
        (A.category_members(sent), lambda m, i: claim(
            i, F.lit(None), m["family"], m["member"], kind="categorical")),
    )
    # A rule's claims follow those of the rules before it.
    out = F.concat(*[F.transform(found, build) for found, build in rules])
    return F.transform(out, lambda c, i: c.withField("seq", i.cast("bigint")))


TRIGGER = (rf"{A.MEASURE}|{A.LEVEL}|{A.COUNT}|(?i:"
           + "|".join(m for _f, members in V.FAMILIES for m in members) + ")")


def extract_claims(notes: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """The claim table (D7 columns) of a notes table.

    A sentence yields one claim per attribute and subject, the first one emitted: a
    compound sentence states a set and does not contradict itself.
    """
    lexicon = build_lexicon(notes) if lexicon is None else lexicon
    # Parsing costs far more than writing, and sentences repeat: each is parsed once.
    sents = materialize(note_sentences(notes), "sentences")
    distinct = distinct_sentences(sents)
    known = materialize(known_subjects(distinct, lexicon), "subjects")
    said = materialize(distinct_claims(distinct, known), "said")
    front = lookup_stored(sents.where("field = 'Text'"), known, "sent", "n")
    claimed = lookup_stored(sents, said, "sent", "n")
    return resolve_claims(claimed, note_topics(front))


def distinct_claims(distinct: DataFrame, known: DataFrame) -> DataFrame:
    """(sent, n, xref, own, claims): what each distinct sentence claims, all but the note's topic.

    A claim has its place `seq`, the subject `base` near it, the drug of a dose and whether its
    level only `names` a landmark.
    """
    sent = F.col("sent")
    flagged = distinct.where(F.regexp_like("sent", F.lit(TRIGGER)))
    rows = (flagged.join(known.drop("n"), "sent", "left")
            .withColumn("cands", F.coalesce("cands", F.array().cast(CANDS)))
            .select("sent", "n", "cands", F.explode(sentence_claims(sent)).alias("c"))
            .select("sent", "n", "cands", "c.*")
            .withColumn("base", subject_at(sent, F.col("cands"), F.col("at"))))
    own = F.try_element_at(F.filter("cands", lambda c: S.is_procedure(c["subject"])),
                           F.lit(1))["subject"]
    # "the L4 transverse process" names the landmark; it does not claim a level for it.
    level, noun = F.substring_index("value", "-", 1), F.element_at(F.split("base", " "), -1)
    identity = (F.col("attribute") == "spinal-level") & F.coalesce(F.regexp_like(
        sent, F.concat(F.lit("(?iU)"), level, F.lit(r"[\s-]+\w*\s*\Q"), noun, F.lit(r"\E"))),
        F.lit(False))
    dosed = F.col("attribute").contains("dose") | (R.attribute_head() == "mass")
    told = (rows.withColumn("own", own)
            .withColumn("drug", F.when(dosed, nearest_drug(sent, F.col("at"))))
            .withColumn("names", identity))
    claim = F.struct("seq", "attribute", "value", "unit", "span", "kind", "base", "drug", "names")
    return told.groupBy("sent", "n", "own").agg(
        F.sort_array(F.collect_list(claim)).alias("claims")).withColumn(
        "xref", R.is_cross_reference("sent"))


def resolve_claims(claimed: DataFrame, topics: DataFrame) -> DataFrame:
    """Claims of sentences with their `distinct_claims`, given the topic of each note."""
    sentence = ["nid", "field", "sid"]
    rows = claimed.select("deck", *sentence, "sent", "xref", "own",
                          F.explode("claims").alias("c")).select(
        "deck", *sentence, "sent", "xref", "own", "c.*")
    head = R.attribute_head()
    named = F.when(F.col("names"), F.concat(F.lower("value"), F.lit(" "), "base")).otherwise(
        F.col("base"))
    subject = (F.when(F.col("drug").isNotNull(), F.col("drug"))
               .when(head.isin(*V.INSTRUMENT_HEADS), F.coalesce("own", "topic", "base"))
               .otherwise(F.coalesce(named, F.col("topic"))))
    resolved = (rows.join(topics, "nid", "left")
                .withColumn("subject", subject).where(F.col("subject").isNotNull())
                .withColumn("attribute", F.when(F.col("names"), F.lit("identity"))
                            .otherwise(F.col("attribute"))))
    # Naming a landmark frees its level, so that a later level in the sentence counts again.
    before = (Window.partitionBy(*sentence).orderBy("seq")
              .rowsBetween(Window.unboundedPreceding, -1))
    freed = F.collect_list(F.when(F.col("names"), F.col("base"))).over(before)
    times = F.when(F.col("attribute") == "spinal-level", F.size(
        F.filter(freed, lambda r: r == F.col("subject")))).otherwise(0)
    first = Window.partitionBy(*sentence, "attribute", "subject", "_freed").orderBy("seq")
    kept = (resolved.withColumn("_freed", times)
            .withColumn("_place", F.row_number().over(first)).where("_place = 1"))
    return kept.select("deck", "nid", "field", "subject", "attribute", "value", "unit", "span",
                       "kind", "xref", "sent")


# ---- A7, A8, K5: collisions ----------------------------------------------------------------------

def collisions(claims: DataFrame, kind: str | None = None, cross_deck: bool = False) -> DataFrame:
    """(subject, attribute, kind, n_claims, n_values, n_decks, disjoint).

    Groups holding at least two distinct values from at least two (note, field) holders;
    with `cross_deck`, from at least two decks. The first aggregation is per value and
    deck, so a hot subject is spread; the second sees one row per value and deck. Spans
    that miss each other are found from their extremes, without pairing claims.
    """
    rows = claims if kind is None else claims.where(F.col("kind") == kind)
    side = (F.col("field") == "Extra").cast("int")
    per_value = rows.groupBy("kind", "subject", "attribute", "value", "deck").agg(
        F.count(F.lit(1)).alias("_n"), F.min("nid").alias("_n0"), F.max("nid").alias("_n1"),
        F.min(side).alias("_f0"), F.max(side).alias("_f1"),
        F.max("span.lo").alias("_lo"), F.min("span.hi").alias("_hi"))
    groups = per_value.groupBy("kind", "subject", "attribute").agg(
        F.sum("_n").alias("n_claims"), F.count_distinct("value").alias("n_values"),
        F.count_distinct("deck").alias("n_decks"),
        (F.min("_n0") != F.max("_n1")).alias("_many_notes"),
        (F.min("_f0") != F.max("_f1")).alias("_both_fields"),
        F.coalesce(F.max("_lo") > F.min("_hi"), F.lit(False)).alias("disjoint"))
    holders = F.col("_many_notes") | F.col("_both_fields")
    found = groups.where((F.col("n_values") >= 2) & holders)
    if cross_deck:
        found = found.where(F.col("n_decks") >= 2)
    return found.select("subject", "attribute", "kind", "n_claims", "n_values", "n_decks",
                        "disjoint")


def collision_members(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct (subject, attribute, value, unit, nid, field) of the colliding groups."""
    keys = found.select("subject", "attribute")
    return (claims.join(keys, ["subject", "attribute"], "left_semi")
            .select("subject", "attribute", "value", "unit", "nid", "field").distinct())


def measured_vs_soft(found: DataFrame) -> DataFrame:
    """Adds severity: measured quantities gate, levels, counts and categories do not."""
    measured = R.is_measured() & (F.col("kind") == "numeric")
    return found.withColumn("severity", F.when(measured, "gate").otherwise("soft"))


def front_back_conflict(claims: DataFrame) -> DataFrame:
    """(nid, subject, attribute, text_values, extra_values, measured): a note whose back
    states other values than its front. Cross-references do not count."""
    own = claims.where((F.col("kind") == "numeric") & ~F.col("xref"))
    per_value = own.groupBy("nid", "subject", "attribute", "value").agg(
        F.bool_or(F.col("field") == "Text").alias("_t"),
        F.bool_or(F.col("field") == "Extra").alias("_e"))
    sides = per_value.groupBy("nid", "subject", "attribute").agg(
        F.sort_array(F.collect_list(F.when(F.col("_t"), F.col("value")))).alias("text_values"),
        F.sort_array(F.collect_list(F.when(F.col("_e"), F.col("value")))).alias("extra_values"))
    clash = ((F.size("text_values") > 0) & (F.size("extra_values") > 0)
             & ~F.arrays_overlap("text_values", "extra_values"))
    return sides.where(clash).withColumn("measured", R.is_measured())


def shared_values(left: Column, right: Column) -> Column:
    """Values of both fields."""
    return F.sort_array(F.array_intersect(left, right))


def verification_buckets(claims: DataFrame) -> DataFrame:
    """(head, n): distinct checkable (subject, value, note) facts, largest bucket first."""
    shown = F.concat("value", F.when(F.col("unit") != "", F.concat(F.lit(" "), "unit"))
                     .otherwise(""))
    facts = (claims.where(R.is_checkable()).select(
        R.attribute_head().alias("head"), "subject", shown.alias("shown"), "nid").distinct())
    return facts.groupBy("head").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "head")


def value_spans_conflict(rows: DataFrame, by: list[str], lo: str, hi: str) -> DataFrame:
    """(by..., conflict): whether any two intervals of a group miss each other."""
    return rows.groupBy(*by).agg(
        F.coalesce(F.max(lo) > F.min(hi), F.lit(False)).alias("conflict"))


# ---- K6 ---------------------------------------------------------------------------------------------

def consistency_report(notes: DataFrame, claims: DataFrame,
                       baseline: DataFrame | None = None) -> DataFrame:
    """(section, severity, deck, nid, item): findings of sections G1a to K in one table."""
    numeric = measured_vs_soft(collisions(claims, "numeric"))
    if baseline is not None:
        # A known collision no longer gates; soft ones are listed either way.
        known = baseline.select("subject", "attribute").distinct().withColumn("_k", F.lit(True))
        numeric = (numeric.join(known, ["subject", "attribute"], "left")
                   .where(F.col("_k").isNull() | (F.col("severity") == "soft")))
    item = F.concat_ws(" · ", "subject", "attribute")
    none_s, none_n = F.lit(None).cast("string"), F.lit(None).cast("bigint")

    def row(section, severity, deck, nid, what):
        return [section.alias("section"), severity.alias("severity"), deck.alias("deck"),
                nid.alias("nid"), what.alias("item")]

    section = F.when(F.col("severity") == "gate", "G1a").otherwise("G1b")
    parts = [
        numeric.select(*row(section, F.col("severity"), none_s, none_n, item)),
        front_back_conflict(claims).select(*row(
            F.lit("G2"), F.when(F.col("measured"), "gate").otherwise("soft"), none_s,
            F.col("nid"), item)),
        collisions(claims, "categorical").select(*row(F.lit("G3"), F.lit("soft"), none_s,
                                                      none_n, item)),
        claims.where(R.is_checkable()).select(
            "deck", "nid", "subject", "attribute", "value").distinct().select(*row(
                F.lit("H"), F.lit("soft"), F.col("deck"), F.col("nid"), item)),
    ]
    flags = F.concat(
        R.flag_list((R.is_procedural(), "I:soft:procedure direction"),
                    (R.dose_without_drug(), "I:gate:dose without drug")),
        F.transform(R.certainty_on_measure("text"), lambda h: F.concat(F.lit("J:soft:"), h)),
        F.transform(R.certainty_on_measure("extra"), lambda h: F.concat(F.lit("J:soft:"), h)))
    if "textbook" in notes.columns and "tags" in notes.columns:
        flags = F.concat(flags, F.transform(R.provenance_blank(),
                                            lambda h: F.concat(F.lit("K:soft:"), h)))
    single = notes.select("deck", "nid", F.explode(flags).alias("f"))
    parts.append(single.select(*row(
        F.substring_index("f", ":", 1), F.split_part("f", F.lit(":"), F.lit(2)),
        F.col("deck"), F.col("nid"), F.regexp_replace("f", "^[A-Z]:[a-z]+:", ""))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def consistency_verdict(report: DataFrame) -> DataFrame:
    """One row: number of failing categories (G1a, G2, I) and the verdict."""
    failing = F.count_distinct(F.when(F.col("severity") == "gate", F.col("section")))
    return report.agg(failing.alias("failing")).withColumn("pass", F.col("failing") == 0)

from pyspark.sql import functions as F

from corpusgate.functions import facts as A
from corpusgate.functions import subjects as S
from corpusgate.functions import text as T
from corpusgate.functions.base import with_offsets
from corpusgate.operators import rules as R


def run(spark, column, *values):
    """Values of a column over rows (text, extra)."""
    df = spark.createDataFrame([(i, v, "") for i, v in enumerate(values)],
                               "i int, text string, extra string")
    return [r["o"] for r in df.select("i", column.alias("o")).orderBy("i").collect()]


def test_offsets_of_many_matches(spark):
    """Matches are placed block by block; every count around the block size, and a long text."""
    import re

    pattern = r"([0-9]+) (mg)"
    texts = ["", "x", *[" ".join(f"w{i % 7} {i} mg" for i in range(n)) + " y"
                        for n in (1, 127, 128, 129, 300, 100_000)]]
    for t, got in zip(texts, run(spark, with_offsets(F.col("text"), pattern, 2), *texts)):
        assert [tuple(g) for g in got] == [
            (m.start(), m[0], m[1], m[2]) for m in re.finditer(pattern, t)]


def test_markup(spark):
    assert run(spark, T.plain("text"), "{{c1::ab::hint}} x", "a<br>b", "a&nbsp;b", "&amp;lt;") == [
        "ab x", "a . b", "a b", "<"]
    assert run(spark, T.compact("text"), "<b>x</b><br>y<li>z") == ["x⏎y⏎- z"]
    assert run(spark, T.has_semicolon("text"), "a&nbsp;b", "a; b") == [False, True]
    assert run(spark, T.media_refs("text"), '<img src="a.png">[sound:b.mp3]<img src=\'a.png\'>') == [
        ["a.png", "b.mp3"]]
    assert run(spark, T.normalize_extra("text"), "  x", " ", "") == [" x", " ", ""]
    assert run(spark, T.sort_field("text"), " <b>a</b>[sound:x.mp3] ") == ["a"]


def test_keys(spark):
    names = ["p9", "p1", "p12", "p3"]
    keys = run(spark, T.natural_key("text"), *names)
    assert [n for _k, n in sorted(zip(keys, names))] == ["p1", "p3", "p9", "p12"]
    assert run(spark, T.match_key("text"), "Area_-_Topic.apkg", "x/Area - Topic.pdf", "My Deck.pdf") == [
        "area topic", "area topic", "my"]


def test_numbers(spark):
    assert run(spark, A.norm_range("text"), "3 to 6", "2.50", "1000000", "x ") == [
        "3-6", "2.5", "1e+06", "x"]
    spelled = ["Page 4 0f 39", "Page 8 of 39", "Page 12 Of 107", "Paqe 3 0t 39", "Page 22 01 39"]
    pages = run(spark, T.page_footers("text"), *spelled, "see page 4 of the module text")
    assert [tuple(p[0]) for p in pages[:5]] == [(4, 39), (8, 39), (12, 107), (3, 39), (22, 39)]
    assert pages[5] == []
    yes = ["3-6", "T11", "0.25%", "50,000", "12", "mmHg", "VIII", "1.5"]
    no = ["liver", "the", "cross-section", "Coronary", "a", "In-Depth"]
    assert run(spark, T.numericish("text"), *yes) == [True] * len(yes)
    assert run(spark, T.numericish("text"), *no) == [False] * len(no)
    for size, tokens in (((1275, 1651), 2714), ((28, 28), 1), ((29, 29), 4)):
        assert run(spark, T.visual_tokens(F.lit(size[0]), F.lit(size[1])), "") == [tokens]
    facts = run(spark, A.numeric_facts(A.fact_text("text")), "{{c1::7}} mg/kg, 3-5 cm, T10, 2 L")
    assert facts == [["7mg/kg", "3cm", "2ml", "t10"]]


def test_chunks_cover_the_text(spark):
    body = "".join(chr(97 + i % 26) for i in range(3300))
    pieces = run(spark, T.chunks("text"), body, "abc", "")
    assert [p["start"] for p in pieces[0]] == [0, 1480, 2960]
    assert pieces[0][-1]["chunk"] == body[2960:]
    assert pieces[1][0]["chunk"] == "abc" and pieces[2] == []


def test_subjects(spark):
    assert run(spark, S.singular(F.col("text")), "process", "serratus", "nerves", "arteries") == [
        "process", "serratus", "nerve", "artery"]
    assert run(spark, S.norm_subject("text"), "contact the transverse process",
               "landmark thoracic paravertebral block", "lateral pectoral nerve", "insert", "") == [
        "transverse process", "paravertebral block", "lateral pectoral nerve", "insert", ""]


def test_attribution(spark):
    hits = run(spark, R.source_attribution("text", "Crest"),
               "According to Crest, the fascia has three layers.",
               " <b>Crest</b> emphasizes that it is a prerequisite.",
               "The module states that the nerve runs deep.",
               "The iliac crest lies at the level of L4.",
               "The crest of the ilium is the landmark.", "The fascia has three layers.")
    assert [bool(h) for h in hits] == [True, True, True, False, False, False]


def test_rules(spark):
    assert run(spark, R.house_rules(audit=True), "{{c1::a}}; b", "x", "{{c1::a}}{{c2::b}} {{") == [
        ["semicolon", "empty Extra"], ["no cloze", "empty Extra"],
        ["c2/c3", "unbalanced braces", "empty Extra"]]
    assert run(spark, R.dose_without_drug(), "about 0.4 mg/kg", "0.4 mL/kg of 0.25% bupivacaine") == [
        True, False]
    assert run(spark, R.certainty_on_measure("text"), "exactly 5 cm", "always so") == [
        ["exactly 5 cm"], []]

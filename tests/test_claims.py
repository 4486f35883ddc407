import pytest

from corpusgate.operators import claims as C

DEPTH = "During a landmark paravertebral block the transverse process is contacted at a depth of "
CASES = [
    ("true contradiction", [
        ("The transverse process is contacted at a depth of {{c1::2 to 4}} cm during a thoracic "
         "paravertebral block.", " "),
        ("During a thoracic paravertebral block the provider should expect to contact the transverse "
         "process at a depth of {{c1::3 to 6}} cm.", " ")],
     {("thoracic transverse process", "depth-to-landmark[length]", False)}),
    ("contrast pair", [(DEPTH + "{{c1::2 to 4}} cm in the thoracic region.", " "),
                       (DEPTH + "{{c1::5 to 8}} cm in the lumbar region.", " ")], set()),
    ("laterality", [
        ("The lateral pectoral nerve arises from the brachial plexus at roots {{c1::C5 to C7}}.", " "),
        ("The medial pectoral nerve arises from the brachial plexus at roots {{c1::C8 to T1}}.", " ")],
     set()),
    ("inherited procedure", [
        ("For a paravertebral block the preferred needle is an 8-10 cm {{c1::Tuohy}} needle.", " "),
        ("When a nerve stimulator is used for a paravertebral block the initial current is "
         "{{c1::2.5 to 5.0}} mA.", " A 5 cm 22-gauge B-bevel needle is used.")],
     {("paravertebral block", "needle-length[length]", True)}),
    ("enumeration", [("The vagus nerve sees C5, C6 and C7.", " "), ("The vagus nerve sees C2.", " ")],
     set()),
]


@pytest.mark.parametrize("name,pairs,expected", CASES, ids=[c[0] for c in CASES])
def test_numeric_collisions(spark, name, pairs, expected):
    notes = spark.createDataFrame(
        [("d", 1000 + i, t, e) for i, (t, e) in enumerate(pairs)],
        "deck string, nid bigint, text string, extra string")
    found = C.collisions(C.extract_claims(notes), "numeric").collect()
    assert {(r.subject, r.attribute, r.disjoint) for r in found} == expected


def test_front_back(spark):
    rows = [("d", 1, f, "x process", "depth[length]", v, "cm", (1.0, 2.0), "numeric", x, "s")
            for f, v, x in (("Text", "3-6", False), ("Extra", "5-7", False))]
    from corpusgate.schemas import CLAIM
    claims = spark.createDataFrame(rows, CLAIM)
    assert C.front_back_conflict(claims).count() == 1
    from pyspark.sql import functions as F
    assert C.front_back_conflict(claims.withColumn("xref", F.lit(True))).count() == 0


LANDMARKS = [
    ("The needle contacts the L4 transverse process.", {("l4 transverse process", "identity", "L4")}),
    # Naming a landmark frees its level: the later one is a claim.
    ("The needle contacts the L4 transverse process and then the L2 level of the transverse process.",
     {("l4 transverse process", "identity", "L4"), ("transverse process", "spinal-level", "L2")}),
    # The nearer of two regions is put in front of the subject.
    ("The depth of 3 cm is measured from the transverse process in the lumbar region, not the thoracic region.",
     {("lumbar transverse process", "depth-to-landmark[length]", "3")}),
    # A compound sentence states a set: its first value counts.
    ("The transverse process is at a depth of 2 cm and the transverse process is at a depth of 4 cm.",
     {("transverse process", "depth-to-landmark[length]", "2")}),
    # The head of a quantity is no subject while a better one is there.
    ("A volume of 20 mL of local anesthetic is injected for the femoral nerve block.",
     {("femoral nerve", "volume[volume]", "20")}),
]


def test_landmarks_regions_and_repeats(spark):
    notes = spark.createDataFrame([("d", i, sentence, "") for i, (sentence, _) in enumerate(LANDMARKS)],
                                  "deck string, nid bigint, text string, extra string")
    found = C.extract_claims(notes).collect()
    for i, (_, expected) in enumerate(LANDMARKS):
        assert {(r.subject, r.attribute, r.value) for r in found if r.nid == i} == expected

"""The pipeline's stages against brute force, each on its own input."""

import collections
import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def docs_dir(spark, tmp_path_factory):
    rng = random.Random(6)
    words = {"en": "the and of this with have from they house water".split(),
             "fr": "le et de cette avec avoir vers elles maison eau".split()}
    rows = []
    for i in range(160):
        lang = ("en", "fr")[i % 2]
        text = " ".join(rng.choices(words[lang], k=rng.randint(8, 80)))
        rows.append((i, text, lang, f"s{i % 4}"))
    for i in range(160, 200):  # copies, and copies with one more word at the end
        own = rows[rng.randrange(100)]
        text = own[1] + (" more" if i % 2 else "")
        rows.append((i, text, own[2], "s9"))
    rows += [(300, None, None, None), (301, "12 34", "en", "s1"), (302, "", "fr", "s1")]
    path = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    docs.selectExpr("*", "cast(length(text) as bigint) as n_chars").write.parquet(
        f"{path}/documents.parquet")
    return path


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


def test_stages(spark, docs_dir):
    docs = spark.read.parquet(f"{docs_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [r.asDict() for r in docs.collect()]
        docs = stage(spark, docs, docs_dir)
        after = [r.asDict() for r in docs.collect()]
        seen[name] = (before, after)
        if name != "byte_pairs":
            assert docs.columns == columns
    before, after = seen["language_id"]
    assert {300, 301, 302}.isdisjoint(r["doc_id"] for r in after)
    assert len(after) >= 0.97 * (len(before) - 3)
    before, after = seen["exact_dedup"]
    top = {}
    for r in before:
        top[r["text"]] = max(top.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in after} == set(top.values())
    before, after = seen["near_dedup"]
    kept = {r["doc_id"]: shingles(r["text"]) for r in after}
    for r in before:
        s = shingles(r["text"])
        alike = [k for k, t in kept.items() if 100 * len(s & t) >= 80 * len(s | t)]
        assert alike if r["doc_id"] not in kept else alike == [r["doc_id"]]
    before, after = seen["source_mix"]
    copies = collections.Counter(r["doc_id"] for r in after)
    assert set(copies) <= {r["doc_id"] for r in before} and max(copies.values()) <= 2
    words = {r["doc_id"]: len(r["text"].split()) for r in before}
    share = sum(words[i] * n for i, n in copies.items()) / sum(words.values())
    assert 1.3 < share < 1.7
    before, after = seen["byte_pairs"]
    assert len(before) == len(after) and all(r["n_tokens"] > 0 for r in after)


def test_run_reads_documents(spark, docs_dir):
    out = corpus_pipeline.run(spark, docs_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert out.count() > 100

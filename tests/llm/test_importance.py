"""Importance resampling against a plain Python form."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from corpusgate.llm import importance

DDL = "doc_id BIGINT, text STRING, weight STRING, score INT, rank INT, n_words INT, place INT, total INT"
TEXTS = [None, "", " \n\t ", "a", "A!b", "the cat sat on the mat", "é ü Ünder_score 日本", "x" * 5000,
         "word and " * 20000, "one,two;three 12'34", "\x00a\x7fb"]


def words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text, lengths):
    w = words(text)
    return [" ".join(w[i:i + n]).encode() for n in range(lengths[0], lengths[1] + 1)
            for i in range(len(w) - n + 1)]


def by_hand(docs, target, lengths, buckets, min_words, percent):
    place = lambda f: zlib.crc32(f) % buckets
    s = collections.Counter(place(f) for _, t in docs for f in features(t, lengths))
    t = collections.Counter(place(f) for x in target for f in features(x, lengths))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
            for b in range(buckets)]
    rows, order = [], []
    for i, text in docs:
        own = [gain[place(f)] for f in features(text, lengths)]
        weight = sum(own) // len(own) if own else 0
        name = "" if i is None else i
        h = int(hashlib.sha256(f"2024:{name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        if len(words(text)) >= min_words:
            order.append((-score, i is not None, i or 0, weight, len(own)))
        rows.append([i, len(own), weight, score])
    order.sort()
    drawn = {}
    for rank, key in enumerate(order[:percent * len(order) // 100], 1):
        drawn.setdefault(key, []).append(rank)
    out = []
    for i, n, weight, score in rows:
        key = (-score, i is not None, i or 0, weight, n)
        out.append((i, n, weight, score, drawn[key].pop(0) if drawn.get(key) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("lengths,buckets,limit", [((1, 1), 10000, 1 << 22), ((1, 3), 50, 300)])
def test_equals_plain_form(spark, lengths, buckets, limit):
    rng = random.Random(3)
    vocabulary = ["the", "Cat", "mat", "日本", "é", "12", "longer-than-eight", "longerthanN"]
    texts = TEXTS + [" ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(150)]
    docs = list(enumerate(texts)) + [(5, texts[5]), (None, "the cat the mat"), (None, None), (7, "dup")]
    target = ["the cat", None, "mat " * 30, "12 日本"]
    frame = spark.createDataFrame([(i, t, *[None] * 6) for i, t in docs], DDL).repartition(3)
    own = importance.resample(frame, spark.createDataFrame([(t,) for t in target], "text STRING"),
                              lengths=lengths, buckets=buckets, min_words=4, percent=30, limit=limit)
    got = sorted((tuple(r) for r in own.collect()), key=str)
    assert got == by_hand(docs, target, lengths, buckets, 4, 30)


def test_equal_keys_are_told_apart_by_bytes():
    texts = [importance.compact(t) for t in TEXTS] + [b"abcdefgh abcdefghi abcdefgX abcdefghi abcdefgh"]
    f = importance.Features(texts, (1, 2))
    grams = [f.data[a:a + n] for a, n in zip(f.start.tolist(), f.size.tolist())]
    for keys in (f.keys(), np.full(len(grams), 7, np.uint64), f.keys() % np.uint64(3)):
        if len(np.unique(keys)) < 4:  # probing by hand is slow with few keys
            f.start, f.size, f.text = f.start[-400:], f.size[-400:], f.text[-400:]
            grams, keys = grams[-400:], keys[-400:]
        table = importance.Interned(f, keys, 97)
        assert len(table.used) == len(set(grams))
        want = collections.Counter(grams)
        assert [int(table.count[s]) for s in table.slot] == [want[g] for g in grams]
        assert [int(table.bucket[s]) for s in table.slot] == [zlib.crc32(g) % 97 for g in grams]


def test_empty_tables_and_drawn_rows(spark):
    rows = [(i, f"w{i} " * 25, "w", 1, 2, 3, 4, 5) for i in range(40)]
    docs = spark.createDataFrame(rows, DDL)
    target = docs.limit(1).select("text")
    assert importance.resample(docs.where("false"), target).count() == 0
    assert importance.resample(docs, target.where("false")).where("rank is not null").count() == 4
    drawn = importance.draw(docs, target)
    assert drawn.columns == docs.columns and drawn.count() == 4
    again = importance.draw(docs, target)
    assert sorted(r["doc_id"] for r in drawn.collect()) == sorted(r["doc_id"] for r in again.collect())

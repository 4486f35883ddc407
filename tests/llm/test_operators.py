"""Every operator against a brute-force form, and on tables of odd rows."""

import collections
import hashlib
import math
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusgate.llm import (byte_pairs, exact, language, lines, lm, main_text, mixing, near,
                            token_counts, topk)

LONG = "word and " * 30000
TEXTS = [None, "", " \n\t ", "a", "A", "the cat sat on the mat", "The cat sat on the mat",
         "the cat sat on the mat", "1 2 3 !?", "é ü <|endoftext|> x", "x" * 5000, LONG, LONG,
         "le chat est sur le tapis\nfin", "line one\nshared line here\n\nend"]
DDL = ("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, id BIGINT, "
       "size BIGINT, key STRING, place INT, keep_id STRING, group_size INT, n_lines INT, "
       "text_sha256 STRING, kept BOOLEAN")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None][i % 3], None, -i, None, "k", 1,
             "x", 2, None, "no", None) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "the cat sat on the mat", None, None, *[None] * 10),
             (None, None, None, "s1", *[None] * 10)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


# ---- tokens -------------------------------------------------------------------------------------

def _texts(n=400):
    rng = random.Random(5)
    alphabet = "aab  \n\t.,'s1é日<|>endoftx=-_ABth"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return out + [c * n for c in ("a", "ab", "abc", " ", "=", "日") for n in (17, 1000, 20001)]


def test_byte_pairs_equal_the_library_and_round_trip():
    import public_tokenizers as P
    import tiktoken

    with open(P.path(byte_pairs.VOCABULARY), "rb") as f:
        ranks = byte_pairs.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_pairs.TextCodec(ranks, P.PATTERN)
    for text in [*_texts(), *(t or "" for t in TEXTS)]:
        want = library.encode_ordinary(text)
        got = codec.encode(text)
        assert got == struct.pack(f"<{len(want)}I", *want)
        assert codec.decode(got) == text.encode()


def test_join_is_associative_and_equals_merging():
    import public_tokenizers as P

    with open(P.path(byte_pairs.VOCABULARY), "rb") as f:
        tree = byte_pairs.TreeEncoder(byte_pairs.read_ranks(f.read()))
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choice(b"abcth e") for _ in range(rng.randint(0, 50)))
        i, j = sorted((rng.randint(0, len(data)), rng.randint(0, len(data))))
        a, b, c = tree.merge(data[:i]), tree.merge(data[i:j]), tree.merge(data[j:])
        assert tree.join(tree.join(a, b), c) == tree.join(a, tree.join(b, c)) == tree.merge(data)


def test_token_counts_equal_the_library():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path(token_counts.VOCABULARY))
    with open(P.path(token_counts.VOCABULARY), "rb") as f:
        counter = token_counts.Counter(f.read(), P.PATTERN)
    for text in [*_texts(), *(t or "" for t in TEXTS)]:
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_remembered_pieces_and_units_are_bounded(monkeypatch):
    import public_tokenizers as P

    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    with open(P.path(token_counts.VOCABULARY), "rb") as f:
        counter = token_counts.Counter(f.read(), P.PATTERN)
    for i in range(20):  # one unit without white space, many pieces
        counter.count("".join(f"a{i}{j}," for j in range(300)))
        counter.count(" ".join(f"b{i}{j}" for j in range(30)))
        assert len(counter.pieces) <= 50 and len(counter.known) <= 50 + 30


def test_tokens_of_odd_rows(odd, none):
    rows = byte_pairs.round_trip(odd, keep_ids=True).collect()
    counts = token_counts.count_tokens(odd).collect()
    assert len(rows) == len(counts) == odd.count()
    for r, c in zip(rows, counts):
        if r["doc_id"] is not None:
            text = (TEXTS[r["doc_id"]] or "").encode()
            assert r["decoded_sha256"] == hashlib.sha256(text).hexdigest()
            assert r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest()
            assert c["n_bytes"] == len(text) and c["over_limit"] == (c["n_tokens"] > 1024)
    decoded = byte_pairs.decode(byte_pairs.encode(odd)).collect()
    assert sorted(bytes(r["data"]) for r in decoded if r["doc_id"] is not None) == sorted(
        (t or "").encode() for t in [*TEXTS, TEXTS[5]])
    assert byte_pairs.round_trip(none).count() == token_counts.count_tokens(none).count() == 0


# ---- language -----------------------------------------------------------------------------------

def test_the_language_sample_is_not_held_by_the_driver(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(i, t, lang) for i in range(60) for t, lang in (
        (f"the cat and {i}", "en"), (f"le chat et {i}", "fr"))], "doc_id BIGINT, text STRING, lang STRING")
    plain, log = language.train, str(tmp_path / "log")

    def watched(rows, labels):
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()} {len(rows)}\n")
        return plain(rows, labels)

    monkeypatch.setattr(language, "train", watched)
    assert language.fit(docs).labels == ["en", "fr"]
    with open(log) as f:
        (pid, n), = map(str.split, f)
    assert int(n) == 120 and int(pid) != os.getpid()


def test_language_is_learned_held_out_and_unknown_without_letters(spark, odd, none):
    rng = random.Random(3)
    words = {"en": "the and of this with have from they house water".split(),
             "fr": "le et de cette avec avoir vers elles maison eau".split(),
             "de": "der und von diese mit haben aus sie haus wasser".split()}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randint(3, 40))), k)
            for i, k in enumerate(sorted(words) * 60)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    model = language.fit(docs.where(language.learnable(docs)))
    held = [r for r in language.predict(docs, model).join(docs, "doc_id").collect()
            if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)
    found = language.predict(odd, model).collect()
    assert len(found) == odd.count()
    for r in found:
        text = None if r["doc_id"] is None else TEXTS[r["doc_id"]]
        if r["doc_id"] is not None and not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
    kept = language.keep_identified(odd, model)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()
    empty = language.fit(none)
    assert empty.labels == []
    assert {r["lang_pred"] for r in language.predict(odd, empty).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'fr'"))
    assert [r["score"] for r in language.predict(docs.limit(1), one).collect()] == [1.0]


def test_every_label_is_learned(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} text", f"l{i % 90:03d}")
            for i in range(360)]
    rows += [(1000, "qqq zzz", "rare"), (1001, "123", "l000"), (1002, "77", "none"),
             (1003, "ok", None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    for size in (4000, 20):
        model = language.fit(docs, size=size)
        assert model.labels == [f"l{i:03d}" for i in range(90)] + ["rare"]
    drawn = language.draw(docs, "text", "lang", "doc_id", 20).collect()
    assert {"rare", *(f"l{i:03d}" for i in range(90))} <= {r["label"] for r in drawn}
    assert len(drawn) < 200


def test_a_label_that_only_calibration_has_drawn_is_trained():
    share = np.full(5, 0.2, np.float32).tobytes()
    rows = [{"label": "a" if i else "z", "share": share,
             "bucket": np.arange(0 if i else 200, 5 if i else 205, dtype=np.int32).tobytes()}
            for i in range(60)]
    other = [{**r, "label": "a"} for r in rows[:1]] + rows[1:]
    at = slice(200, 205)
    with_z, without = (language.train(r, ["a", "z"]).table[at] for r in (rows, other))
    assert (with_z[:, 1] - with_z[:, 0]).mean() > (without[:, 1] - without[:, 0]).mean()


# ---- exact dedup --------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 30000])
def test_filter_has_every_key_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    built = exact.build_filter(np.concatenate([keys, keys[:5]]))
    assert exact.in_filter(keys, *built).all()
    assert exact.in_filter(rng.integers(0, 1 << 63, 50000).astype(np.uint64), *built).mean() < 0.01


def _exact_by_hand(rows):
    group = collections.defaultdict(list)
    for i, t in rows:
        group[t or ""].append(i)
    top = {t: max((i for i in ids if i is not None), default=None) for t, ids in group.items()}
    return sorted(((i, top[t or ""], len(group[t or ""]), i == top[t or ""],
                    hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("digest", [exact.sha256, lambda t: F.substring(exact.sha256(t), 1, 1)])
def test_exact_dedup_equals_grouping_even_if_digests_collide(odd, none, digest):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = exact.dedup(*exact.split(odd), digest=digest).collect()
    short = [(*tuple(r)[:4], r["text_sha256"][:1]) for r in got]
    want = [(*w[:4], w[4][:1]) for w in _exact_by_hand(rows)]
    assert sorted(short, key=str) == sorted(want, key=str)
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns
    assert {r["text"] or "" for r in kept.collect()} == {t or "" for _, t in rows}
    assert exact.dedup(*exact.split(none)).count() == 0


@pytest.mark.parametrize("shard,keys", [(3, 1 << 24), (3, 8), (1 << 18, 2)])
def test_exact_dedup_with_many_shards_and_small_filters(spark, monkeypatch, shard, keys):
    monkeypatch.setattr(exact, "SHARD_KEYS", shard)
    monkeypatch.setattr(exact, "FILTER_KEYS", keys)
    rng = random.Random(shard + keys)
    rows = [(i, None if n == 1 else f"text {n}") for i, n in enumerate(
        rng.choice([rng.randint(0, 60), 7, 1000 + i]) for i in range(400))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3)
    got = exact.dedup(*exact.split(docs)).collect()
    assert sorted((tuple(r) for r in got), key=str) == _exact_by_hand(rows)
    kept = sorted(r["doc_id"] for r in exact.drop_copies(docs).collect())
    assert kept == sorted(w[0] for w in _exact_by_hand(rows) if w[3])


# ---- near dedup ---------------------------------------------------------------------------------

def _near_by_hand(rows, width):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_groups_equal_all_pairs(spark, odd, none):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 12, 60, 200]))
        for _ in range(8):  # a chain of edits, each near the last but not near all
            base = list(base)
            for _ in range(max(1, len(base) // 30)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(base)))
    for width in (2, 5):
        docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
               for r in near.near_groups(docs, width=width).collect()}
        assert got == _near_by_hand(rows, width)
    plain = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = near.near_groups(odd, width=2).collect()
    want = _near_by_hand(plain, 2)
    assert len(got) == len(plain)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got
            if r["doc_id"] is not None} == want
    assert all(r["kept"] for r in got if r["doc_id"] is None)
    assert near.drop_near(odd).columns == odd.columns
    assert near.near_groups(none).count() == 0


# ---- mixing -------------------------------------------------------------------------------------

def test_mix_meets_targets_and_repeats(spark, odd, none):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 60), f"s{i % 7}" if i % 7 else None) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    got = mixing.mix(docs).collect()
    assert sorted(got) == sorted(mixing.mix(docs.repartition(5)).collect())
    size = collections.Counter()
    for i, t, s in rows:
        size[s] += len(t.split())
    names = sorted((s for s in size if s), key=str.encode) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    budget, capped = 1.5 * sum(size.values()), set()
    while True:
        rest = budget - sum(2 * size[s] for s in capped)
        level = rest / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and weight[s] * level > 2 * size[s]}
        if not more:
            break
        capped |= more
    source = {i: s for i, _, s in rows}
    taken = collections.Counter()
    for r in got:
        s = source[r["doc_id"]]
        want = 2 * size[s] if s in capped else weight[s] * level
        assert math.isclose(r["target"], want) and r["source_size"] == size[s]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in names:
        want = 2 * size[s] if s in capped else weight[s] * level
        assert abs(taken[s] - want) <= 30
    assert len(mixing.mix(odd).collect()) == odd.count()
    drawn = mixing.draw_mix(docs)
    assert drawn.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in drawn.collect()) == {
        r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]}
    assert mixing.draw_mix(odd).columns == odd.columns
    assert mixing.mix(none).count() == 0


def test_flow_routes_overlaps_to_the_source_that_needs_them():
    # 10 words of a only, 10 of both, quotas 10 and 15: b gets the overlap, then repeats it.
    flow = mixing.min_cost_flow([10, 10], [[0], [0, 1]], [10.0, 15.0], 2)
    assert [round(sum(f), 6) for f in flow] == [10, 15]
    assert round(flow[1][1], 6) == 15
    assert mixing.min_cost_flow([4], [[0]], [100.0], 2) == [[8.0]]


def test_texts_without_words_are_not_drawn(spark):
    rows = [(i, None if i < 400 else "one two three", "a" if i % 2 else "b") for i in range(420)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    drawn = [r["doc_id"] for r in mixing.draw_mix(docs).collect()]
    assert min(drawn) >= 400 and max(collections.Counter(drawn).values()) <= 2


def test_mix_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, [["a"], ["b"], ["a", "b"], ["c"], None, []][i % 6]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, sources ARRAY<STRING>")
    chosen, targets = mixing.plan(docs, mixing.overlapping("sources"))
    copies = {r["id"]: r["copies"] for r in chosen.collect()}
    assert len(copies) == 120 and all(0 <= n <= 2 for n in copies.values())
    assert targets.count() == 4


# ---- top-k --------------------------------------------------------------------------------------

def _top_by_hand(rows, k=10):
    out = []
    good = [(i, [math.floor(1024 * v) for v in x]) for i, x in rows if i is not None
            and x is not None and all(v is not None and math.isfinite(v) for v in x)]
    for q, x in good:
        if q % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in good
                            if i != q and len(y) == len(x))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_top_k_equals_all_pairs(spark, spread):
    rng = np.random.default_rng(1)
    centre = rng.normal(0, 3, (9, 6))
    rows = [(i, [float(np.float32(v)) for v in centre[i % 9] + rng.normal(0, spread, 6)])
            for i in range(1500)]
    rows += [(1500 + i, rows[100][1]) for i in range(200)]  # one vector many times: ties
    rows += [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, rows[1][1]),
             (2100, [float("nan")] * 6), (2200, [1.0, 2.0]), (2201, [3.0, 4.0]), (2300, [1e30] * 6),
             (2400, [float("inf")] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    f32 = [(i, None if x is None else [None if v is None else float(np.float32(v)) for v in x])
           for i, x in rows if i != 2300]
    got = topk.search(vectors.where("vec_id <> 2300 or vec_id is null"),
                      lambda c: c % 100 == 0, block=200, group=8).collect()
    assert sorted(map(tuple, got)) == _top_by_hand(f32)
    assert topk.search(vectors, lambda c: c % 100 == 0, block=200, group=8).count() > len(got)
    assert topk.search(vectors.limit(0), lambda c: c % 100 == 0).count() == 0


def test_cover_trees_have_nodes_and_prune_in_64_dimensions():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (40, 64))
    data = np.floor(1024 * (centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.05, (4000, 64))))
    ask = data[::100]
    scored = 0
    plain = topk._compare

    def counted(q, a, p, rows, best):
        nonlocal scored
        scored += (q.hi[a] - q.lo[a]) * len(rows)
        return plain(q, a, p, rows, best)

    q, p = topk.Tree(ask, np.arange(0, 4000, 100), topk.ASKING), topk.Tree(data, np.arange(4000))
    best = topk.Best(len(q.ids), 10, None)
    topk._compare = counted
    try:
        topk.dual_search(q, p, best)
    finally:
        topk._compare = plain
    assert len(p.children) > 50
    assert max(h - lo for lo, h, below in zip(p.lo, p.hi, p.children) if not below) <= topk.LEAF
    assert scored < 0.5 * len(ask) * len(data)
    for i, own in enumerate(q.ids.tolist()):
        s = data @ q.x[i]
        s[own] = -np.inf
        order = np.lexsort((np.arange(4000), -s))[:10]
        assert best.ids[i] == order.tolist()


def test_top_k_with_levels_of_nodes_clashing_columns_and_repeated_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "FANOUT", 3)
    rng = np.random.default_rng(7)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(0, 1, 5)], "g", i, 0.5, i) for i in range(900)]
    ddl = "vec_id BIGINT, embedding ARRAY<FLOAT>, grp STRING, part INT, score DOUBLE, node INT"
    got = topk.search(spark.createDataFrame(rows, ddl), lambda c: c % 100 == 0, block=40, group=3)
    assert sorted(map(tuple, got.collect())) == _top_by_hand([r[:2] for r in rows])
    # Rows that repeat a query's id are its own, whichever of them asks.
    twice = rows + [(100, rows[100][1], "h", None, None, None)]
    again = topk.search(spark.createDataFrame(twice, ddl), lambda c: c % 100 == 0, block=40, group=3)
    assert sorted(map(tuple, again.where("query_id = 100").collect())) == [
        t for t in _top_by_hand([r[:2] for r in rows]) if t[0] == 100]


# ---- lines --------------------------------------------------------------------------------------

def test_many_lines_go_from_one_text(spark):
    lines_ = [f"line {i}" for i in range(200_000)]
    rows = [(0, "\n".join(["own", *lines_]), "s0"), (1, "\n".join(lines_), "s1")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    got = {r["doc_id"]: r for r in lines.clean_lines(docs, min_sites=2).collect()}
    assert (got[0]["text"], got[0]["n_removed"]) == ("own", 200_000)
    assert (got[1]["text"], got[1]["n_removed"]) == ("", 200_000)


def test_lines_on_many_sites_go(spark, odd, none):
    rows = [(i, f"own {i}\nshared by all\n \nby few {i % 20 // 5}", f"site{i % 20}")
            for i in range(60)] + [(100, None, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    got = {r["doc_id"]: r for r in lines.clean_lines(docs, min_sites=5).collect()}
    assert got[3]["text"] == "own 3\n " and got[3]["n_removed"] == 2 and got[3]["n_lines"] == 4
    assert got[100]["text"] == "" and got[100]["n_removed"] == 0
    keep = {r["doc_id"]: r for r in lines.clean_lines(docs, min_sites=6).collect()}
    assert keep[3]["text"] == "own 3\n \nby few 0"
    out = lines.clean_lines(odd)
    assert out.count() == odd.count() and out.columns[:len(odd.columns)] == odd.columns
    assert lines.clean_lines(none).count() == 0


# ---- pages --------------------------------------------------------------------------------------

def test_main_text_of_a_page(spark):
    body = "".join(f"<p>Sentence number {i} of &amp; the <b>story</b>\n goes.<br>On.</p>"
                   for i in range(5))
    page = ("<html><head><title>T</title><style>p{}</style></head><body><header>Site name</header>"
            "<nav><ul><li><a href=x>Home page link</a></li></ul></nav>"
            "<div class='cookie notice'>We use cookies a lot here</div><article><h1>The title</h1>"
            f"{body}<div class=\"ad\">Buy this thing now</div><form>Your mail<input></form>"
            "<script>if (a < b) { x('</p>') }</script><p>The end</article>"
            "<section class='comments'><p>I liked it very much indeed, thanks</p></section>"
            "<footer>Imprint</footer></body></html>")
    weights = main_text.Weights()
    want = ["The title", *(f"Sentence number {i} of & the story goes. On." for i in range(5)),
            "The end"]
    assert main_text.extract(page, weights) == "\n\n".join(want)
    assert main_text.extract(page[:page.index("The end") + 3], weights).endswith("The")
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (None, "u", "a < b & c"),
            (5, "u", "<nav>x</nav>"), (6, "u", "<a \"" * 500), (7, "u", "<p>w</p>" * 20000)]
    pages = spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING")
    got = {r["page_id"]: r for r in main_text.main_text(pages).collect()}
    assert len(got) == 8 and got[2]["text"] == got[3]["text"] == got[5]["text"] == ""
    assert got[None]["text"] == "a < b & c" and got[7]["n_chars"] == 20000 * 3 - 2
    assert main_text.main_text(pages.limit(0)).count() == 0


def test_region_scan_finds_the_labelled_text():
    weights = main_text.Weights()
    for page in main_text.LABELLED:
        whole = main_text.extract("".join(p for _, p in page), weights)
        inner = main_text.extract("".join(p for m, p in page if m), weights)
        assert whole == inner != ""


@pytest.mark.parametrize("page, want", [
    ("<article><p>Some words go here</p><p>more of it, see <a>here</a>\n</p></article>",
     "Some words go here\n\nmore of it, see here"),
    ("<article><h1>\n<a>Title</a></h1><p>Some words go here</p></article>",
     "Title\n\nSome words go here"),
    ("<body>\n <article>\n  <p>\n <b>One</b> paragraph<br>\n </p>\n </article>\n</body>", "One paragraph"),
    ("<p>\n a " + "<b></b>" * 30 + " b c d e f g h <i>x</i>\n</p>", "a b c d e f g h x")])
def test_white_space_beside_inline_tags_at_the_edges(page, want):
    assert main_text.extract(page, main_text.Weights()) == want


@pytest.mark.parametrize("before, after", [
    ('<body class="has-sidebar">', "</body>"), ('<body class="sidebar menu">', "</body>"),
    ('<div id="page" class="site">', "</div>"), ('<div class="layout with-sidebar">', "</div>"),
    ('<main class="menu">', "</main>"), ('<div class="sidebar">', "</div>"),
    ('<form id="aspnetForm">', "</form>"), ('<article class="comment reply">', "</article>")])
def test_wrappers_with_any_class_keep_their_text(before, after):
    inner = ('<h1>The title</h1><p>One two three four.</p><ul class="list"><li>Five six.</li>'
             '<li>Seven.</li></ul><div class="ad">Buy now</div><p>Eight nine ten.</p>')
    got = main_text.extract(f"<nav>Home</nav>{before}{inner}{after}<footer>Legal</footer>",
                            main_text.Weights())
    assert got.split("\n\n") == ["The title", "One two three four.", "Five six.", "Seven.",
                                 "Eight nine ten."]


def test_a_clue_of_one_labelled_page_does_not_count():
    weights = main_text.Weights([[(0, '<div class="odd">x</div>'), (1, "<p>y</p>")]])
    assert weights.share("div", 'class="odd"') == 1


@pytest.mark.parametrize("around", ["article", "main", 'div class="content"', "section"])
def test_an_article_of_short_divs_is_whole(around):
    blocks = ["A talk at night", *(f"Line {i} has few words." for i in range(40)), "Yes.", "No."]
    page = (f"<html><body><nav>Home</nav><div class='ad'>Buy this now</div><{around}><h1>"
            + blocks[0] + "</h1>" + "\n".join(f"<div>{b}</div>" for b in blocks[1:21])
            + "<div>" + "".join(f"<div><span>{b}</span></div>" for b in blocks[21:]) + "</div>"
            f"</{around.split()[0]}><div class='comments'>I liked it</div></body></html>")
    assert main_text.extract(page, main_text.Weights()).split("\n\n") == blocks


# ---- language model -----------------------------------------------------------------------------

def _lexicon(n=150):
    return lm.Lexicon([(b"w%d" % i, 3 * n - 2 * i) for i in range(n)] + [(lm.END, 40)],
                      sum(3 * n - 2 * i for i in range(n)) + 40, n + 1)


def test_gradients_equal_differences():
    lx = _lexicon()
    rng = np.random.default_rng(0)
    params = {k: v.astype(np.float64) for k, v in lm.initial(lx).items()}
    source, target = rng.integers(0, 150, (6, 3)), rng.integers(0, 151, (6, 3))
    keep = np.ones((6, 3))
    keep[3, 1] = 0

    def loss(p):
        states, _ = lm.run_gates(p, p["embed"][source] @ p["wx"] + p["b"],
                                 np.zeros((3, lm.HIDDEN)), keep, None)
        return -lm.log_probs(p, states.reshape(-1, lm.HIDDEN), target.ravel(), None)[0].sum()

    trainer = lm.Trainer(params, lx)
    steps = {}
    trainer._step = lambda name, grad, at: steps.__setitem__(name, (grad * source.size, at))
    trainer._window(source, target, keep, np.zeros((3, lm.HIDDEN), np.float32))
    for name in ("wx", "wh", "b", "wc", "bc", "wo", "bo", "embed"):
        grad, at = steps[name]
        full = np.zeros_like(params[name])
        full[at] = grad
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in full.shape)
            if name == "embed":
                i = (source[rng.integers(0, 6), rng.integers(0, 3)], i[1])
            e = 1e-3
            moved = [{**params, name: params[name].copy()} for _ in range(2)]
            moved[0][name][i] += e
            moved[1][name][i] -= e
            assert abs((loss(moved[0]) - loss(moved[1])) / (2 * e) - full[i]) < 2e-2 * max(
                1, abs(full[i]))


def test_probabilities_sum_to_one_and_state_spans_windows():
    lx = _lexicon()
    params = lm.initial(lx)
    h = np.random.default_rng(1).normal(0, 1, (1, lm.HIDDEN)).astype(np.float32)
    every = np.arange(lx.other + 1)
    lp, _ = lm.log_probs(params, np.repeat(h, len(every), 0), every, None)
    assert abs(np.exp(lp).sum() - 1) < 1e-4
    docs = [np.random.default_rng(i).integers(0, lx.other + 1, n).astype(np.int32)
            for i, n in enumerate([1, 5, 400, 33, 32, 31])]
    scorer = lm.Scorer(params, lx)
    together = scorer.score(docs)
    assert np.allclose(together, [scorer.score([d])[0] for d in docs], rtol=1e-4)


def test_every_token_of_a_batch_is_trained_on():
    lx, seen = _lexicon(), collections.Counter()
    texts = ["w1 w2 w3 zz w4", None, "w5 w6", " ".join(f"w{i % 90}" for i in range(1000))]

    class Watched(lm.Trainer):
        def _window(self, source, target, keep, h, *real):
            at = real[0] if real else np.ones(target.shape, bool)
            seen.update(target[at].tolist())
            return super()._window(source, target, keep, h, *real)

    trainer = Watched(lm.initial(lx), lx)
    trainer.feed([lx.numbers(t) for t in texts])
    assert seen == collections.Counter(np.concatenate([lx.numbers(t) for t in texts]).tolist())
    assert trainer.tokens == sum(seen.values())
    assert all(np.isfinite(v).all() for v in trainer.p.values())


def test_padding_changes_no_gradient():
    lx = _lexicon()
    rng = np.random.default_rng(3)
    source, target = rng.integers(0, 150, (6, 3)), rng.integers(0, 151, (6, 3))
    keep, h = np.ones((6, 3), np.float32), np.zeros((3, lm.HIDDEN), np.float32)
    plain, padded = lm.Trainer(lm.initial(lx), lx), lm.Trainer(lm.initial(lx), lx)
    plain._window(source, target, keep, h)
    wide = lambda a, v: np.append(a, np.full((6, 2), v, a.dtype), axis=1)
    padded._window(wide(source, lx.start), wide(target, lx.other), wide(keep, 0),
                   np.zeros((5, lm.HIDDEN), np.float32), wide(np.ones((6, 3), bool), False))
    for k in plain.p:
        assert np.allclose(plain.p[k], padded.p[k], atol=1e-5), k


def test_the_rounds_train_on_every_training_document(spark, monkeypatch):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("some words "), "id").alias("text"))
    seen = []
    monkeypatch.setattr(lm, "train_round", lambda rows, *a: seen.extend(
        r["id"] for r in rows.collect()) or a[-1])
    lm.score_documents(docs)
    assert sorted(seen) == [i for i in range(200) if zlib.crc32(str(i).encode()) % 10]


def _slow_score(text, p, lx, counts):
    """The model's log10 probability of a text, one word after the other."""
    h, before, out = np.zeros(lm.HIDDEN), lx.start, 0.0
    sig = lambda v: 1 / (1 + np.exp(-v))
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    n = lm.HIDDEN
    for word in (text or "").encode().lower().split() + [lm.END]:
        x, g = p["embed"][before] @ p["wx"] + p["b"], h @ p["wh"]
        z, r = sig(x[:n] + g[:n]), sig(x[n:2 * n] + g[n:2 * n])
        new = np.tanh(x[2 * n:] + r * g[2 * n:])
        h = new + z * (h - new)
        i = lx.number.get(word, lx.other)
        chance = soft(h @ p["wc"] + p["bc"])[i // lm.CLASS]
        chance *= soft(h @ p["wo"][i // lm.CLASS] + p["bo"][i // lm.CLASS])[i % lm.CLASS]
        if i == lx.other:
            chance *= (counts[word] + lm.SMOOTH) / lx.floor / lx.rest
        out, before = out + math.log10(chance), i
    return out


def test_scores_equal_a_slow_run(spark, monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(lm, "SHORT", 30)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 300))))
            for i in range(150)] + [(900, None), (901, "unseen w1 unseen"), (902, "w1 w2 " * 3000)]
    learned = {}
    plain = lm.train
    monkeypatch.setattr(lm, "train", lambda heads, slices, lx: learned.setdefault(
        "p", plain(heads, slices, lx)))
    make = lm.learn
    monkeypatch.setattr(lm, "learn", lambda *a: learned.setdefault("lx", make(*a)))
    got = lm.score_documents(spark.createDataFrame(rows, "doc_id BIGINT, text STRING").repartition(3))
    score = {r["doc_id"]: r["score"] for r in got.collect()}
    lx, counts = learned["lx"][0], collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update((t or "").encode().lower().split() + [lm.END])
    for i, t in rows[:20] + rows[-3:]:
        assert math.isclose(score[i], _slow_score(t, learned["p"], lx, counts), rel_tol=1e-4), i


def test_lanes_take_documents_of_many_batches(spark, monkeypatch, tmp_path):
    lx, log = _lexicon(), str(tmp_path / "log")
    size = [1 + 7 * i % 40 for i in range(300)]
    rows = [(i, np.arange(n, dtype=lm.NUMBER).tobytes()) for i, n in enumerate(size)]
    heads = spark.createDataFrame(rows, "row BIGINT, ids BINARY").repartition(1)
    monkeypatch.setattr(lm, "CHUNK", 4000)

    class Watched(lm.Scorer):
        def score(self, docs):
            with open(log, "a") as f:
                f.write(f"{len(docs)}\n")
            return super().score(docs)

    params, plain = lm.initial(lx), lm.Scorer
    monkeypatch.setattr(lm, "Scorer", Watched)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 16)
    try:
        got = {r["row"]: r["net"] for r in lm.with_net(heads, lx, params).collect()}
    finally:
        spark.conf.set(key, before)
    with open(log) as f:
        calls = [int(n) for n in f]
    assert sum(calls) == 300 and len(calls) == 2
    scorer = plain(params, lx)
    for i, ids in rows:
        assert math.isclose(got[i], scorer.score([np.frombuffer(ids, lm.NUMBER)])[0] / lm.LOG10,
                            rel_tol=1e-4)


def test_scores_of_documents(spark, odd, none):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["A b", "c d e", "f"]) for _ in range(rng.randint(0, 80))))
            for i in range(200)] + [(500, None), (501, "never seen words")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    counts = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            counts.update((t or "").encode().lower().split() + [lm.END])
    total, kinds = sum(counts.values()), len(counts)
    got = lm.score_documents(docs).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        words = (text[r["doc_id"]] or "").encode().lower().split() + [lm.END]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        assert math.isclose(r["base_score"], base, abs_tol=1e-9)
        assert (r["n_tokens"], r["n_known"]) == (len(words), sum(counts[w] > 0 for w in words))
        assert r["train_tokens"] == total and r["score"] <= 1e-6
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.score_documents(odd).count() == odd.count()
    assert lm.score_documents(none).count() == 0
    assert [r["score"] for r in lm.score_documents(docs.where("doc_id = 500").withColumn(
        "doc_id", F.lit(None).cast("bigint"))).collect()] == [0.0]


def test_near_masks_never_refuse_a_link():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 40, 500, 9000):
        base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for changed in (0, 1, n // 20, n // 9, n // 2):
            other = np.unique(np.concatenate([
                base[changed:], rng.integers(0, 1 << 63, changed, dtype=np.uint64)]))
            bits = (near.parity_mask(base) ^ near.parity_mask(other)).view(np.uint64)
            assert np.bitwise_count(bits).sum() <= len(np.setxor1d(base, other))

"""Resampling of documents towards a target distribution by hashed n-gram features.

Every run of LENGTHS consecutive words is a feature and has a bucket. Documents and target
texts are counted by bucket; a bucket's gain is the logarithm of the ratio of its smoothed
shares, a document's weight the mean gain of its features, and its score the weight plus
Gumbel noise drawn from a hash of its id, so the highest scores are a sample without
replacement in proportion to the weights.

Features of a batch are interned in an open-addressed NumPy table: the key is the xxhash64 of
the feature's bytes, equal keys are told apart by comparing their bytes, and occupied slots
are probed one after the other, all features at once. A slot holds the bucket and the count,
so a feature that is repeated is hashed to its bucket once; the slot numbers of the
occurrences gather the gains of a document. Batches are cut at CHUNK bytes of text, so the
table is bounded, whatever the number of rows; only a longer text is taken whole.

What reaches the driver is two counts per bucket. Ranks come from a range partition and
offsets, one per partition.

Defined results: a null text has no words; a text without features has weight 0; a row
without an id draws its noise from an empty id and comes before others of its score; rows
that repeat an id are ranked one by one; with an empty target, or without documents, the
smoothed shares decide alone.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import fresh, map_batches, placed
from corpusgate.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTHS = (1, 1)
BUCKETS = 10_000
SCALE = 1000         # scores are whole thousandths
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
CHUNK = 4 << 20      # bytes of text interned at once, if no text is longer

_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_KEEP = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_TABLE = bytes(_KEEP[c] for c in _LOWER)


def compact(text: str | None) -> bytes:
    """The words of a text, one space between them."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())


class Features:
    """Features of some texts: where each lies in `data`, and which text it is of."""

    def __init__(self, texts: list[bytes], lengths: tuple[int, int]):
        self.data = b"\n".join(texts) + b"\n" + bytes(8)
        raw = np.frombuffer(self.data, np.uint8)
        word = raw > 0x20
        edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
        first, last = edge[::2], edge[1::2]
        breaks = np.flatnonzero(raw == 0x0A)
        text = np.searchsorted(breaks, first)
        self.n_words = np.bincount(text, minlength=len(texts))
        starts, sizes, texts_of = [], [], []
        for n in range(lengths[0], lengths[1] + 1):
            m = max(0, len(first) - n + 1)
            whole = text[:m] == text[n - 1:n - 1 + m]
            starts.append(first[:m][whole])
            sizes.append((last[n - 1:n - 1 + m] - first[:m])[whole])
            texts_of.append(text[:m][whole])
        self.start, self.size = np.concatenate(starts), np.concatenate(sizes)
        self.text = np.concatenate(texts_of)
        # Eight bytes from any place on, whatever its alignment.
        self.eight = np.ndarray(len(self.data) - 7, "<u8", self.data, 0, (1,))

    def keys(self) -> np.ndarray:
        data, end = self.data, self.start + self.size
        return np.fromiter((xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(
            self.start.tolist(), end.tolist())), np.uint64, len(self.start))

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of features `a` are those of features `b`, pair by pair."""
        same = self.size[a] == self.size[b]
        left, at = np.flatnonzero(same), 0
        while len(left):
            x, y = a[left], b[left]
            rest = np.minimum(self.size[x] - at, 8).astype(np.uint64)
            drop = (np.uint64(8) - rest) * np.uint64(8)
            alike = (self.eight[self.start[x] + at] << drop) == (self.eight[self.start[y] + at] << drop)
            same[left[~alike]] = False
            at += 8
            left = left[alike & (self.size[x] > at)]
        return same


class Interned:
    """An open-addressed table of the distinct features of a batch.

    `slot` has the slot of every occurrence; `used` the slots in use, `count` and `bucket`
    what they hold.
    """

    def __init__(self, features: Features, keys: np.ndarray, buckets: int):
        n = len(keys)
        cells = 1 << max(4, (2 * n).bit_length())
        mask = cells - 1
        owner = np.full(cells, -1, np.int64)
        probe = ((keys ^ (keys >> np.uint64(32))) & np.uint64(mask)).astype(np.int64)
        self.slot, waiting = np.empty(n, np.int64), np.arange(n)
        while len(waiting):
            at = probe[waiting]
            free = owner[at] < 0
            # Of several features that meet one free slot, one takes it.
            owner[at[free]] = waiting[free]
            held = owner[at]
            same = keys[held] == keys[waiting]
            where = np.flatnonzero(same)
            same[where] = features.equal(held[where], waiting[where])
            self.slot[waiting[same]] = at[same]
            waiting = waiting[~same]
            probe[waiting] = (probe[waiting] + 1) & mask
        self.used = np.flatnonzero(owner >= 0)
        self.count = np.bincount(self.slot, minlength=cells)
        self.bucket = np.zeros(cells, np.int64)
        own, data = owner[self.used], features.data
        start, end = features.start[own].tolist(), (features.start[own] + features.size[own]).tolist()
        self.bucket[self.used] = [zlib.crc32(data[a:b]) % buckets for a, b in zip(start, end)]


def chunks(texts: list[str | None], limit: int):
    """Runs of compacted texts of about `limit` bytes."""
    held, size = [], 0
    for text in texts:
        held.append(compact(text))
        size += len(held[-1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def bucket_counts(docs: DataFrame, text_col: str, lengths=LENGTHS, buckets: int = BUCKETS,
                  limit: int = CHUNK) -> DataFrame:
    """(bucket, n): occurrences of features per bucket over all rows."""
    def make():
        def work(batch):
            total = np.zeros(buckets, np.int64)
            for texts in chunks(batch["text"], limit):
                features = Features(texts, lengths)
                table = Interned(features, features.keys(), buckets)
                np.add.at(total, table.bucket[table.used], table.count[table.used])
            found = np.flatnonzero(total)
            return {"bucket": found, "n": total[found]}
        return work

    rows = docs.select(F.col(text_col).alias("text"))
    part = map_batches(rows, make, "bucket BIGINT, n BIGINT")
    return part.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int, scale: int) -> np.ndarray:
    """Gain of every bucket, from two tables (bucket, n) of at most `buckets` rows."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, out in ((docs, s), (target, t)):
        for r in counts.collect():
            out[r["bucket"]] = r["n"]
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(scale * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            target_col: str = "text", lengths=LENGTHS, buckets: int = BUCKETS, scale: int = SCALE,
            limit: int = CHUNK) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    own = gains(bucket_counts(docs, text_col, lengths, buckets, limit),
                bucket_counts(target, target_col, lengths, buckets, limit), buckets, scale)
    shared = docs.sparkSession.sparkContext.broadcast(own)

    def make():
        gain = shared.value

        def work(batch):
            out = {"id": batch["id"], "n_words": [], "n_features": [], "weight": []}
            for texts in chunks(batch["text"], limit):
                features = Features(texts, lengths)
                table = Interned(features, features.keys(), buckets)
                by_slot = gain[table.bucket]
                total = np.zeros(len(texts), np.int64)
                np.add.at(total, features.text, by_slot[table.slot])
                n = np.bincount(features.text, minlength=len(texts))
                out["n_words"] += features.n_words.tolist()
                out["n_features"] += n.tolist()
                out["weight"] += (total // np.maximum(n, 1)).tolist()
            return out
        return work

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, make, f"id {kind}, n_words BIGINT, n_features BIGINT, weight BIGINT")


def noise(id_text, seed: str, scale: int):
    """Gumbel noise in units of 1 / scale from a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_text).cast("binary"), 256), 1, 8),
               16, 10).cast("double")
    return F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_col: str = "text", lengths=LENGTHS, buckets: int = BUCKETS,
             scale: int = SCALE, min_words: int = MIN_WORDS, percent: int = PERCENT,
             seed: str = SEED, limit: int = CHUNK) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; rank is null where not drawn."""
    own = weights(docs, target, id_col, text_col, target_col, lengths, buckets, scale, limit)
    text = F.coalesce(F.col("id").cast("string"), F.lit(""))
    scored = materialize(own.withColumn("score", F.col("weight") + noise(text, seed, scale))
                         .withColumn("enough", F.col("n_words") >= min_words), "scores")
    order = [F.col("score").desc(), F.col("id"), F.col("weight"), F.col("n_features")]
    ranked = placed(scored, order, ["enough"])
    drawn = F.col("enough") & (F.col("place") < F.expr(f"total * {int(percent)} div 100"))
    return ranked.select(F.col("id").alias(id_col), "n_features", "weight", "score",
                         F.when(drawn, F.col("place") + 1).alias("rank"))


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows drawn, with all their columns; a repeated id is drawn with all its rows."""
    own, = fresh(docs, "drawn")
    found = resample(docs, target, id_col, **options).where("rank is not null").select(
        F.col(id_col).alias(own)).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(F.col(own)), "left_semi")

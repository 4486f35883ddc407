"""Exact dedup of incoming documents against immutable snapshots.

A snapshot keeps one state row per digest (count, largest id) and, per shard of the digest
space, a static binary-fuse filter: three 8-bit cells per key, about 9 bits a key, no false
negatives. Digests of a new batch are made distinct, sent to their shard and screened. Those
that the filter denies are surely new and are only grouped among the batch. Positives join
the exact state of the snapshot, and every digest that occurs more than once has its texts
compared byte for byte, by grouping on the text itself. Groups of copies are folded before
every shuffle, so a group of any size is one row per task. Texts move once, and only those that
a filter of the repeated digests, of bounded size, does not clear; all else is done on digests.

Defined results: a null text is an empty text; of equal texts the row with the largest id
stays; rows that repeat an id are one document and share its fate; among rows without an id,
which count as smaller than any, all stay if no copy has an id. Texts whose digests collide
are told apart.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.operators.skew import lookup_by_key
from corpusgate.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHARD_KEYS = 1 << 18       # keys of a filter shard, on average
FILTER_KEYS = 1 << 24      # keys in filters that are broadcast, at most


# ---- the filter ---------------------------------------------------------------------------------

def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer of the keys under a seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(seed)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def _shape(n: int) -> tuple[int, int]:
    """(segment length, number of start segments) for n keys."""
    length = 1 << max(2, min(18, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    size = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    return length, max(1, int(np.ceil(n * size / length)) - 2)


def _cells(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """Three cells of each hash, in three segments that follow each other."""
    first = ((h >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    at = first.astype(np.int64)
    mask = length - 1
    b = at + length
    c = at + 2 * length
    b ^= (h >> np.uint64(18)).astype(np.int64) & mask
    c ^= h.astype(np.int64) & mask
    return np.stack([at, b, c], axis=1)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, cells) of a filter that holds all `keys`.

    Cells with one key left are peeled in rounds, whole rounds at a time; the keys are then
    placed in reverse. A seed for which the peeling stops early is given up for the next.
    """
    keys = np.unique(keys)
    length, segments = _shape(len(keys))
    size = (segments + 2) * length
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
        cells, prints = _cells(h, length, segments), _prints(h)
        count = np.bincount(cells.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for j in range(3):
            np.bitwise_xor.at(owner, cells[:, j], np.arange(len(keys)))
        rounds, left = [], len(keys)
        while left:
            single = np.flatnonzero(count == 1)
            if not len(single):
                break
            who, place = np.unique(owner[single], return_index=True)
            rounds.append((who, single[place]))
            left -= len(who)
            for j in range(3):
                np.subtract.at(count, cells[who, j], 1)
                np.bitwise_xor.at(owner, cells[who, j], who)
        if left:
            continue
        out = np.zeros(size, np.uint8)
        for who, place in reversed(rounds):
            own = cells[who]
            rest = np.zeros(len(who), np.uint8)
            for j in range(3):
                rest ^= np.where(own[:, j] == place, 0, out[own[:, j]]).astype(np.uint8)
            out[place] = prints[who] ^ rest
        return seed, length, segments, out.tobytes()
    raise RuntimeError("no seed gives a filter")


def in_filter(keys: np.ndarray, seed: int, length: int, segments: int,
              cells: bytes) -> np.ndarray:
    h = _mix(keys, seed * 0x9E3779B97F4A7C15 % (1 << 64))
    data, at = np.frombuffer(cells, np.uint8), _cells(h, length, segments)
    return (data[at[:, 0]] ^ data[at[:, 1]] ^ data[at[:, 2]]) == _prints(h)


# ---- snapshots ----------------------------------------------------------------------------------

def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def digests(docs: DataFrame, id_col: str, text_col: str, digest=sha256) -> DataFrame:
    """(digest, id) of every row."""
    return docs.select(digest(F.col(text_col)).alias("digest"), F.col(id_col).alias("id"))


def state_of(rows: DataFrame) -> DataFrame:
    """(digest, n, top): one row per digest, folded before the shuffle."""
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))


def _key() -> Column:
    """64 bits of the digest."""
    return F.xxhash64("digest")


def _shard(shards: int) -> Column:
    return F.pmod(F.hash("digest"), F.lit(shards))


_FILTER = "shard INT, seed INT, length INT, segments INT, cells BINARY"


def _build_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    seed, length, segments, cells = build_filter(pdf["key"].to_numpy(np.int64).view(np.uint64))
    return pd.DataFrame({"shard": [key[0]], "seed": [seed], "length": [length],
                         "segments": [segments], "cells": [cells]})


def build_filters(state: DataFrame, shards: int) -> DataFrame:
    """One filter per shard; a shard holds about SHARD_KEYS distinct digests."""
    keyed = state.select(_shard(shards).cast("int").alias("shard"), _key().alias("key"))
    return keyed.groupBy("shard").applyInPandas(_build_shard, _FILTER)


def _screen_shard(filters: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    keys = batch["key"].to_numpy(np.int64).view(np.uint64)
    hit = np.zeros(len(batch), bool)
    for f in filters.itertuples():
        hit |= in_filter(keys, f.seed, f.length, f.segments, f.cells)
    return pd.DataFrame({"digest": batch["digest"], "maybe": hit})


def screen(batch: DataFrame, filters: DataFrame, shards: int) -> DataFrame:
    """(digest, maybe): whether a snapshot may hold the digest; `batch` is distinct."""
    keyed = batch.select("digest", _shard(shards).cast("int").alias("shard"),
                         _key().alias("key"))
    return filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(
        _screen_shard, "digest STRING, maybe BOOLEAN")


# ---- dedup --------------------------------------------------------------------------------------

def repeated(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """(digest): digests that more than one row (digest, id) of snapshot and batch have."""
    old, new = (materialize(state_of(rows), name) for rows, name in (
        (snapshot, "state"), (batch, "batch")))
    shards = max(1, -(-old.count() // SHARD_KEYS))
    seen = screen(new.select("digest"), build_filters(old, shards), shards)
    positive = seen.where("maybe").select("digest")
    # Exact buckets: the filter's few false positives find no row here.
    held = old.join(positive, "digest", "left_semi").select("digest")
    within = old.where("n > 1").select("digest").unionByName(new.where("n > 1").select("digest"))
    return materialize(held.unionByName(within).distinct(), "repeated")


class Screen:
    """A test of whether column `name` of `found` may hold a value.

    The filters of `found` are broadcast, in at most 20 MB: of more than FILTER_KEYS values,
    the leading bits of their keys are kept, as many as give no more keys than that. Then
    more of the texts without a copy pass; what passes is exact in any case.
    """

    def __init__(self, found: DataFrame, name: str = "digest"):
        self.bits = 64 if found.count() <= FILTER_KEYS else FILTER_KEYS.bit_length() - 1
        keys = found.select(self.key(F.col(name)).alias("key")).distinct()
        self.shards = max(1, -(-keys.count() // SHARD_KEYS))
        own = keys.select(self.shard(F.col("key")).alias("shard"), "key")
        self.shared = found.sparkSession.sparkContext.broadcast(
            {r["shard"]: (r["seed"], r["length"], r["segments"], bytes(r["cells"]))
             for r in own.groupBy("shard").applyInPandas(_build_shard, _FILTER).collect()})

    def key(self, value: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(value), 64 - self.bits)

    def shard(self, key: Column) -> Column:
        return F.pmod(F.hash(key), F.lit(self.shards)).cast("int")


def may_hold(filters: dict, key: np.ndarray, shard: np.ndarray) -> np.ndarray:
    keys, hit = key.astype(np.int64).view(np.uint64), np.zeros(len(key), bool)
    for i, part in filters.items():
        at = np.flatnonzero(shard == i)
        hit[at] = in_filter(keys[at], *part)
    return hit


def screened(found: DataFrame, name: str = "digest"):
    """A function from a column to whether column `name` of `found` may hold its value."""
    screen = Screen(found, name)
    shared = screen.shared

    @F.pandas_udf("boolean")
    def test(key: pd.Series, shard: pd.Series) -> pd.Series:
        return pd.Series(may_hold(shared.value, key.to_numpy(), shard.to_numpy()))

    def maybe(value: Column) -> Column:
        key = screen.key(value)
        return test(key, screen.shard(key))

    return maybe


def groups(rows: DataFrame, docs: DataFrame, maybe, id_col: str, text_col: str,
           digest=sha256) -> DataFrame:
    """(id, digest, keep_id, group_size) of every row; `rows` has the digests of `docs`.

    Texts that may have a copy are grouped byte for byte, folded before the shuffle, so a
    group is one row per task. Where all texts of a digest are equal, its rows find their
    class by the digest; those of the others by digest and text.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"),
                        digest(F.col(text_col)).alias("digest")).where(maybe(F.col("digest")))
    classes = materialize(texts.groupBy("digest", "text").agg(
        F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "classes")
    by_digest = classes.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"),
        F.count(F.lit(1)).alias("classes"))
    by_digest = materialize(by_digest.where("group_size > 1"), "by_digest")
    told = lookup_by_key(rows, by_digest, "digest", "group_size", F.col("id"), "left")
    alike = told.where("classes is null or classes = 1").select(
        "id", "digest", F.when(F.col("classes").isNull(), F.col("id")).otherwise(
            F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast(
            "bigint").alias("group_size"))
    mixed = by_digest.where("classes > 1").select("digest")
    unlike = texts.join(mixed, "digest", "left_semi").join(classes, ["digest", "text"])
    return alike.unionByName(unlike.select("id", "digest", "keep_id", "group_size"))


def split(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Snapshot and incoming batch of a table without load dates: halves by hash of the id."""
    old = F.coalesce(F.pmod(F.xxhash64(F.col(id_col)), F.lit(2)) == 0, F.lit(True))
    return docs.where(old), docs.where(~old)


def _found(snapshot: DataFrame, batch: DataFrame, id_col: str, text_col: str, digest):
    """(rows with digests, whether a digest may be repeated) of snapshot and batch."""
    old, new = (materialize(digests(docs, id_col, text_col, digest), "digests")
                for docs in (snapshot, batch))
    return old.unionByName(new), screened(repeated(old, new))


def dedup(snapshot: DataFrame, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          digest=sha256) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of snapshot and batch."""
    rows, maybe = _found(snapshot, batch, id_col, text_col, digest)
    both = snapshot.select(id_col, text_col).unionByName(batch.select(id_col, text_col))
    return groups(rows, both, maybe, id_col, text_col, digest).select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest=sha256) -> DataFrame:
    """The rows, with all their columns, that stay.

    Rows that the filter clears stay without a shuffle; only the others meet the list of
    rows that go.
    """
    rows, maybe = _found(*split(docs, id_col), id_col, text_col, digest)
    told = groups(rows, docs, maybe, id_col, text_col, digest)
    gone = told.where(~F.col("id").eqNullSafe(F.col("keep_id"))).select(
        F.col("id").alias("_cg_id"), F.col("digest").alias("_cg_digest")).distinct()
    own = digest(docs[text_col])
    doubtful = docs.where(maybe(own))
    stay = doubtful.join(gone, doubtful[id_col].eqNullSafe(F.col("_cg_id"))
                         & (digest(doubtful[text_col]) == F.col("_cg_digest")), "left_anti")
    return docs.where(~maybe(own)).unionByName(stay)

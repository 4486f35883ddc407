"""MinHash near-dedup.

One-permutation hashing: the distinct shingle hashes of a text, in order, fall into BANDS x
ROWS bins by their leading bits, and the smallest of each bin is its value. An empty bin
borrows the value of a bin found by its own sequence of probes (optimal densification).
Bins are hashed in bands; texts that agree in a band share a bucket.

Equal sets are folded to their smallest id first, so copies are never compared. A bucket
then emits a star: one centre against every other member of another component. Members are drawn
by a hash of their id alone, so buckets that share members draw the same centres, and a pair
that meets in many bands is emitted and linked once. Stars are confirmed on the full sets, components are updated, centres
leave their buckets, and buckets that still hold several components go into another round,
until none does. What is left after a round is mostly texts that only look alike, so every
round draws MORE times as many centres per bucket as the one before: a round emits at most
as many edges as members times centres, and the rounds grow with the logarithm of the
largest such bucket. Every pair of texts in a bucket is confirmed, refused or already linked
by others at the end.

A pair whose sets cannot be similar enough is not carried to the confirmation: every set has
a mask of MASKS words, the parity of its shingles per bit, and two masks differ in no more
bits than the two sets in shingles. The bound is exact at any size; sets of many thousand
shingles are only held apart by their sizes before the full sets are compared.

With six rows and forty bands, two texts with a similarity of exactly 0.8 share no bucket
with probability (1 - 0.8^6)^40 = 5e-6.

Defined results: a null or blank text has an empty set, is linked with nothing and stays; a
text with fewer words than a shingle is one shingle; rows that repeat an id are one node and
share its fate; rows without an id are linked with nothing and stay.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import components, fresh, map_batches
from corpusgate.llm.exact import Screen, may_hold
from corpusgate.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WIDTH = 5
SIMILARITY = (4, 5)   # as a fraction, compared in whole numbers
BANDS, ROWS = 40, 6
REMEMBERED = 1 << 18
MORE = 8              # growth of the number of stars per bucket and round
SLICE = 1 << 8        # rows with their sets held at once by a worker
MASKS = 8             # 64-bit words of parity per set
WORDS = 1 << 16       # 64-bit words of the broadcast that tells which ids may be gone
MASK = [f"m{i}" for i in range(MASKS)]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Shingler:
    def __init__(self, width: int):
        self.width, self.hashes = width, Hashes()

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct hashes of the shingles of a text.

        Bytes are lower-cased and split as ASCII, which leaves other letters and white space
        as they are.
        """
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = np.array(list(map(self.hashes.__getitem__, words)), np.uint64)
        width = min(self.width, len(h))
        n = len(h) - width + 1
        with np.errstate(over="ignore"):
            out = h[:n].copy()
            for j in range(1, width):
                out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
            return np.unique(mix(out + np.uint64(width)))


def probes(bins: int) -> np.ndarray:
    """For every bin, the bins it tries to borrow from, the same for all texts."""
    grid = np.arange(bins * 4 * bins, dtype=np.uint64)
    return (mix(grid + np.uint64(0x51ED27)) % np.uint64(bins)).astype(np.int64).reshape(bins, -1)


def signature(shingles: np.ndarray, tries: np.ndarray) -> np.ndarray:
    """The value of every bin of a set that is not empty."""
    bins = len(tries)
    at = ((shingles >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    value, full = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    value[at[first]], full[at[first]] = shingles[first], True
    empty = np.flatnonzero(~full)
    j = 0
    while len(empty):
        if j < tries.shape[1]:
            source = tries[empty, j]
        else:  # every probe was empty: the first full bin
            source = np.full(len(empty), np.flatnonzero(full)[0])
        hit = full[source]
        value[empty[hit]] = value[source[hit]]
        empty = empty[~hit]
        j += 1
    return value


def band_keys(value: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket key per band."""
    grid = value.reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64)
        for j in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
    return key.view(np.int64)


def parity_mask(shingles: np.ndarray) -> np.ndarray:
    """MASKS words; bit i is set if an odd number of shingles falls on i."""
    bit = (shingles % np.uint64(64 * MASKS)).astype(np.int64)
    odd = np.bincount(bit, minlength=64 * MASKS).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<u8").view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH,
               bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, same, mask, keys): set size, digest and mask of the set, bucket key
    per band."""
    def make():
        shingler, tries = Shingler(width), probes(bands * rows)

        def work(batch):
            out = {"id": batch["id"], "n_shingles": [], "same": [], "mask": [], "keys": []}
            for text in batch["text"]:
                s = shingler.shingles(text)
                out["n_shingles"].append(len(s))
                if len(s):
                    out["same"].append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                    out["mask"].append(parity_mask(s))
                    out["keys"].append(band_keys(signature(s, tries), bands, rows))
                else:
                    out["same"].append(None)
                    out["mask"].append(None)
                    out["keys"].append(None)
            return out
        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make,
                       f"id {kind}, n_shingles BIGINT, same STRING, mask ARRAY<BIGINT>, keys ARRAY<BIGINT>", SLICE)


def full_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str,
              width: int) -> DataFrame:
    """(id, shingles) of the named documents.

    The filter of `ids` is asked where the shingles are made, so a task has one Python worker
    and only sets that pass are moved.
    """
    screen = Screen(ids, "id")
    shared, key = screen.shared, screen.key(F.col("id"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select(
        "id", "text", key.alias("key"), screen.shard(key).alias("shard"))

    def make():
        shingler = Shingler(width)

        def work(batch):
            hit = may_hold(shared.value, np.array(batch["key"], np.int64), np.array(batch["shard"]))
            at = np.flatnonzero(hit).tolist()
            return {"id": [batch["id"][i] for i in at], "shingles": [
                shingler.shingles(batch["text"][i]).view(np.int64) for i in at]}
        return work

    kind = rows.schema["id"].dataType.simpleString()
    sets = map_batches(rows, make, f"id {kind}, shingles ARRAY<BIGINT>", SLICE)
    return materialize(sets, "passed").join(ids, "id", "left_semi")


def confirm(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    num, den = similarity
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    shared = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    both = (F.size("sa") + F.size("sb")).cast("bigint")
    return (pairs.select("a", "b").join(b, "b").join(a, "a")
            .select("a", "b", shared.alias("shared"), both.alias("both"))
            .where(F.col("shared") * den >= (F.col("both") - F.col("shared")) * num)
            .select("a", "b"))


def _buckets(sig: DataFrame) -> DataFrame:
    """(key, id, n, masks, grp, place): members of buckets that hold several sets."""
    fold = sig.where(F.col("same").isNotNull() & F.col("id").isNotNull()).groupBy("same").agg(
        F.min("id").alias("id"))
    sets = sig.join(fold, ["same", "id"], "left_semi")
    rows = sets.select("id", F.explode("keys").alias("key"))
    ends = rows.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    rows = rows.join(ends.where("lo <> hi").select("key"), "key", "left_semi").distinct()
    facts = sets.select("id", "same", F.col("n_shingles").alias("n"), *[
        F.col("mask")[i].alias(m) for i, m in enumerate(MASK)]).dropDuplicates(["id", "same"])
    return rows.join(facts.drop("same"), "id").select(
        "key", "id", "n", *MASK, F.col("id").alias("grp"), F.xxhash64("id").alias("place"))


def _with_centres(members: DataFrame, stars: int) -> DataFrame:
    """`members` with whether each is a centre: about `stars` per bucket, one at least."""
    sizes = members.groupBy("key").agg(F.min("place").alias("lead"), F.count(F.lit(1)).alias("m"))
    drawn = F.pmod("place", F.lit(1 << 30)) * F.col("m") < F.lit(stars * (1 << 30))
    return members.join(sizes, "key").withColumn(
        "centre", (F.col("place") == F.col("lead")) | drawn).drop("lead", "m")


def _stars(members: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): the centres of every bucket against its members in other components."""
    num, den = similarity
    centre = members.where("centre").select(
        "key", F.col("id").alias("c"), F.col("n").alias("cn"), F.col("grp").alias("cg"),
        *[F.col(m).alias(f"c{m}") for m in MASK])
    apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"c{m}"))) for m in MASK[1:]),
                F.bit_count(F.col(MASK[0]).bitwiseXOR(F.col(f"c{MASK[0]}"))))
    fits = ((F.least("n", "cn") * den >= F.greatest("n", "cn") * num)
            & (apart * (den + num) <= (F.col("n") + F.col("cn")) * (den - num)))
    return members.join(centre, "key").where((F.col("grp") != F.col("cg")) & fits).select(
        F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()


def near_links(docs: DataFrame, sig: DataFrame, id_col: str, text_col: str, width: int = WIDTH,
               similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(node, grp): components of more than one set, over the smallest id of equal sets."""
    members = materialize(_buckets(sig), "buckets")
    named = materialize(members.select("id").distinct(), "named")
    sets = materialize(full_sets(docs, named, id_col, text_col, width), "sets")
    node = sig.schema["id"].dataType
    asked = sig.sparkSession.createDataFrame([], f"a {node.simpleString()}, b {node.simpleString()}")
    labels = asked.select(F.col("a").alias("node"), F.col("b").alias("grp"))
    stars = 1
    while not members.isEmpty():
        members = materialize(_with_centres(members, stars), "centres")
        pairs = _stars(members, similarity).join(asked, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        asked = asked.unionByName(pairs)
        found = materialize(confirm(pairs, sets, similarity), "links")
        if not found.isEmpty():
            # Earlier links are told by one edge a node.
            told = labels.where("node <> grp").select(
                F.col("node").alias("a"), F.col("grp").alias("b"))
            labels = components(told.unionByName(found))
        # Centres have met every member; buckets of one component are settled.
        left = members.where("not centre").drop("centre", "grp")
        left = left.join(labels.select(F.col("node").alias("id"), "grp"), "id", "left").select(
            "key", "id", "n", *MASK, F.coalesce("grp", "id").alias("grp"), "place")
        ends = left.groupBy("key").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        open_keys = ends.where("lo <> hi").select("key")
        members = materialize(left.join(open_keys, "key", "left_semi"), "buckets")
        stars *= MORE
    return labels


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                width: int = WIDTH, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    sig = materialize(signatures(docs, id_col, text_col, width), "signatures")
    labels = near_links(docs, sig, id_col, text_col, width, similarity)
    fold = sig.where(F.col("same").isNotNull()).groupBy("same").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    named = fold.join(labels, fold["id"] == labels["node"], "left").where(
        "copies > 1 or grp is not null").select(
        F.col("same").alias("s"), F.coalesce("grp", "id").alias("grp"))
    rows = sig.select("id", "n_shingles", "same").join(named, F.col("same") == F.col("s"), "left")
    group = F.when(F.col("id").isNotNull(), F.coalesce("grp", "id"))
    return rows.select(F.col("id").alias(id_col), "n_shingles", group.alias("component_id"),
                       F.col("id").eqNullSafe(group).alias("kept"))


def without(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The rows of `docs` whose id is not in `gone` (one column, stored).

    Texts of rows that stay are not shuffled: a broadcast of at most WORDS rows of 64 bits
    has a bit for every id that is gone, and only rows on a set bit go through the exact join,
    those that are gone and few others. `docs` is read twice.
    """
    word, bits, key = fresh(docs, "word", "bits", "key")
    name = gone.columns[0]

    def place(c):
        return F.pmod(F.shiftright(F.xxhash64(c), 6), F.lit(WORDS)).cast("int")

    def bit(c):
        return F.call_function("shiftleft", F.lit(1).cast("bigint"),
                               F.pmod(F.xxhash64(c), F.lit(64)).cast("int"))

    kind = docs.schema[id_col].dataType
    gone = gone.select(F.col(name).cast(kind).alias(key))
    filled = gone.groupBy(place(F.col(key)).alias(word)).agg(F.bit_or(bit(F.col(key))).alias(bits))
    seen = docs.join(F.broadcast(filled), place(F.col(id_col)) == F.col(word), "left")
    hit = F.coalesce(F.col(bits).bitwiseAND(bit(F.col(id_col))) != 0, F.lit(False))
    asked = seen.where(hit).join(gone, F.col(id_col) == F.col(key), "left_anti")
    return seen.where(~hit).select(*docs.columns).unionByName(asked.select(*docs.columns))


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of the document that stays of each group."""
    groups = near_groups(docs, id_col, text_col)
    out = materialize(groups.where("not kept").select(id_col).distinct(), "gone")
    return without(docs, out, id_col)

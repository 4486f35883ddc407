"""Byte-level BPE encoding and decoding as a monoid tree reduction.

The encodings of the pieces of a text form a monoid. A piece is encoded by halves,
recursively; two neighbours are joined by re-encoding a window around the boundary, which
grows until the tokens outside it cannot change. They cannot when every adjacent pair is
stable, that is when encoding the bytes of the two tokens gives these two tokens again: a
sequence of reachable tokens is the encoding of its bytes if and only if all its adjacent
pairs are stable. Pieces, the matches of the splitting pattern, are encoded separately, so
they concatenate without a window. Decoding concatenates byte strings up the tree.

Defined results: a null text is an empty text, with no tokens; every text, however long, is
encoded whole; equal texts give equal rows; a null id stays null; columns other than the id
and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import struct
import sys

import numpy as np
import public_tokenizers
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from corpusgate.llm.common import file_bytes, map_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Unicode White_Space, spelled out.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: White space and what follows it: no match of the pattern reaches from a character that is
#: not white space to one that is, so these units can be split and remembered one by one.
UNIT = f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+"
LEAF = 16            # bytes encoded directly
REMEMBERED = 1 << 19  # units a task remembers before it starts afresh
SLICE = 1 << 8       # rows with their ids held at once by a worker
ABSENT = 1 << 60


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank)
            for token, rank in (line.split() for line in data.splitlines() if line)}


class TreeEncoder:
    """Encodes byte strings under a table of ranks; tokens are byte strings."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs: dict[tuple[bytes, bytes], bool] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """The encoding by its definition: always the leftmost pair of the lowest rank."""
        if len(data) > 8 * LEAF:
            return self._merge_long(data)
        rank = self.ranks.get
        parts = [data[i:i + 1] for i in range(len(data))]
        pair = [rank(data[i:i + 2], ABSENT) for i in range(len(data) - 1)]
        while pair:
            low = min(pair)
            if low == ABSENT:
                break
            i = pair.index(low)
            parts[i] += parts.pop(i + 1)
            del pair[i]
            if i:
                pair[i - 1] = rank(parts[i - 1] + parts[i], ABSENT)
            if i < len(pair):
                pair[i] = rank(parts[i] + parts[i + 1], ABSENT)
        return parts

    def _merge_long(self, data: bytes) -> list[bytes]:
        """The same for a long window, with the pairs in a heap."""
        n, rank = len(data), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1)
                if (r := rank(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _r, i, stop = heapq.heappop(heap)
            mid = end[i]
            if mid == 0 or mid >= n or end[mid] != stop:
                continue
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(data[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := rank(data[before[i]:stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, at = [], 0
        while at < n:
            out.append(data[at:end[at]])
            at = end[at]
        return out

    def stable(self, left: bytes, right: bytes) -> bool:
        """Whether the two tokens stay as they are next to each other."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The monoid's operation: the encoding of the concatenated bytes."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            window = self.merge(b"".join(left[a:]) + b"".join(right[:b]))
            if ((a == 0 or self.stable(left[a - 1], window[0]))
                    and (b == len(right) or self.stable(window[-1], right[b]))):
                return left[:a] + window + right[b:]
            k *= 2

    def encode(self, data: bytes) -> list[bytes]:
        if len(data) <= LEAF:
            return self.merge(data)
        half = LEAF
        while 2 * half < len(data):
            half *= 2
        return self.join(self.encode(data[:half]), self.encode(data[half:]))


class TextCodec:
    """Whole texts to packed ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tree = TreeEncoder(ranks)
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.piece = regex.compile(pattern.replace(r"\s", f"[{SPACE}]").replace(
            r"\S", f"[^{SPACE}]").replace(rf"[^[{SPACE}]", f"[^{SPACE}"))
        self.unit = re.compile(UNIT)
        self.known: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        ids = []
        for piece in self.piece.findall(unit):
            data = piece.encode()
            whole = self.ranks.get(data)
            ids += [whole] if whole is not None else [
                self.ranks[t] for t in self.tree.encode(data)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        units = self.unit.findall(text or "")
        known = self.known
        found = list(map(known.get, units))
        if None in found:
            if len(known) >= REMEMBERED:
                known.clear()
            for i, ids in enumerate(found):
                if ids is None:
                    unit = units[i]
                    ids = known.get(unit)
                    if ids is None:
                        ids = self._unit(unit)
                        if len(unit) <= 64:
                            known[unit] = ids
                    found[i] = ids
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the tokens, concatenated by halves up the tree."""
        def build(lo: int, hi: int) -> bytes:
            if hi - lo <= 1 << 14:
                return b"".join(map(self.tokens.__getitem__, numbers[lo:hi].tolist()))
            mid = (lo + hi) // 2
            return build(lo, mid) + build(mid, hi)

        numbers = np.frombuffer(ids, "<u4")
        return build(0, len(numbers))


def _codec(vocabulary, pattern: str) -> TextCodec:
    return TextCodec(read_ranks(vocabulary.value), pattern)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, ids BINARY, n_tokens): the ids of every text, packed little-endian."""
    data = file_bytes(docs.sparkSession, vocabulary or public_tokenizers.path(VOCABULARY))
    rows = docs.select(id_col, text_col)

    def make():
        codec = _codec(data, pattern)

        def work(batch):
            ids = [codec.encode(t) for t in batch[text_col]]
            return {id_col: batch[id_col], "ids": ids, "n_tokens": [len(x) // 4 for x in ids]}
        return work

    return map_batches(rows, make, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, "
                                   "ids BINARY, n_tokens BIGINT")


def decode(encoded: DataFrame, id_col: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """(id, data BINARY): the bytes that packed ids stand for; null ids are no bytes."""
    data = file_bytes(encoded.sparkSession, vocabulary or public_tokenizers.path(VOCABULARY))
    rows = encoded.select(id_col, "ids")

    def make():
        codec = _codec(data, "")
        return lambda batch: {id_col: batch[id_col],
                              "data": [codec.decode(x or b"") for x in batch["ids"]]}

    return map_batches(rows, make, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, "
                                   "data BINARY")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN,
               keep_ids: bool = False) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids, in one pass.

    One pass keeps the ids, about as large as the text, out of any shuffle or table, unless
    `keep_ids` asks for them as a last column.
    """
    data = file_bytes(docs.sparkSession, vocabulary or public_tokenizers.path(VOCABULARY))
    rows = docs.select(id_col, text_col)

    def make():
        codec = _codec(data, pattern)

        def work(batch):
            out = {id_col: batch[id_col], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            if keep_ids:
                out["ids"] = []
            for text in batch[text_col]:
                ids = codec.encode(text)
                out["n_tokens"].append(len(ids) // 4)
                out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if keep_ids:
                    out["ids"].append(ids)
            return out
        return work

    return map_batches(rows, make, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, "
                                   "n_tokens BIGINT, ids_sha256 STRING, decoded_sha256 STRING"
                       + (", ids BINARY" if keep_ids else ""), SLICE)

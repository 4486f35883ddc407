"""Token counts of whole texts, without producing tokens.

A piece starts as a linked list of byte symbols; a heap holds its adjacent pairs by merge
rank. The lowest pair is popped and merged as long as there is one, and the count is the
number of initial symbols minus the number of merges.

Defined results: a null text counts as empty, 0 tokens and 0 bytes; the special strings of
the vocabulary are found inside texts as the library does by default and count one token
each; whole texts are counted, however long; a null id stays null.
"""

from __future__ import annotations

import heapq
import json
import re
import sys

import public_tokenizers
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from corpusgate.llm.byte_pairs import REMEMBERED, SPACE, UNIT
from corpusgate.llm.common import file_bytes, map_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary (fixed values).

    Printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Counter:
    def __init__(self, data: bytes, pattern: str):
        spec = json.loads(data)
        self.rank: dict[str, int] = {}
        for i, (a, b) in enumerate(spec["model"]["merges"]):
            self.rank.setdefault(f"{a} {b}", i)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.symbols = byte_symbols()
        self.piece = regex.compile(pattern.replace(r"\s", f"[{SPACE}]").replace(
            r"\S", f"[^{SPACE}]").replace(rf"[^[{SPACE}]", f"[^{SPACE}"))
        self.unit = re.compile(UNIT)
        self.known: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def merges(self, symbols: list[str]) -> int:
        """How many merges the list of symbols goes through."""
        rank, n = self.rank.get, len(symbols)
        heap = []
        for i in range(n - 1):
            r = rank(f"{symbols[i]} {symbols[i + 1]}")
            if r is not None:
                heap.append((r, i, symbols[i], symbols[i + 1]))
        if not heap:
            return 0
        heapq.heapify(heap)
        after, before, done = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            _r, i, a, b = heapq.heappop(heap)
            j = after[i]
            # A pair that an earlier merge has changed is no longer there.
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            done += 1
            both, symbols[j] = a + b, None
            symbols[i] = both
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = rank(f"{both} {symbols[k]}")
                if r is not None:
                    heapq.heappush(heap, (r, i, both, symbols[k]))
            h = before[i]
            if h >= 0:
                r = rank(f"{symbols[h]} {both}")
                if r is not None:
                    heapq.heappush(heap, (r, h, symbols[h], both))
        return done

    def _unit(self, unit: str) -> int:
        total = 0
        for piece in self.piece.findall(unit):
            n = self.pieces.get(piece)
            if n is None:
                data = piece.encode()
                n = len(data) - self.merges([self.symbols[b] for b in data])
                if len(piece) <= 64:
                    if len(self.pieces) >= REMEMBERED:
                        self.pieces.clear()
                    self.pieces[piece] = n
            total += n
        return total

    def _plain(self, text: str) -> int:
        units, known = self.unit.findall(text), self.known
        found = list(map(known.get, units))
        if None in found:
            if len(known) >= REMEMBERED:
                known.clear()
            for i, n in enumerate(found):
                if n is None:
                    unit = units[i]
                    n = known.get(unit)
                    if n is None:
                        n = self._unit(unit)
                        if len(unit) <= 64:
                            known[unit] = n
                    found[i] = n
        return sum(found)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str | None = None, limit: int = LIMIT,
                 pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every text."""
    data = file_bytes(docs.sparkSession, vocabulary or public_tokenizers.path(VOCABULARY))
    rows = docs.select(id_col, text_col)

    def make():
        counter = Counter(data.value, pattern)

        def work(batch):
            texts = batch[text_col]
            counts = [counter.count(t) for t in texts]
            return {id_col: batch[id_col], "n_bytes": [len((t or "").encode()) for t in texts],
                    "n_tokens": counts, "over_limit": [n > limit for n in counts]}
        return work

    return map_batches(rows, make, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, "
                                   "n_bytes BIGINT, n_tokens BIGINT, over_limit BOOLEAN")

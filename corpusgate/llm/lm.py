"""Scoring of whole documents with a gated recurrent language model.

Words of the training documents are counted over the whole corpus. The model predicts the
SHORT most frequent words, the end of a document, and one symbol for all other words; a word
behind that symbol has its share of the smoothed corpus counts, so the probabilities of all
words, the unseen ones together, sum to one. The output softmax is factored into classes of
words of similar rank; that symbol, about half of all tokens, is the last class by itself. Biases start at the corpus frequencies. The weights are trained in
numpy by truncated backpropagation through time: training documents are trained on where they
lie, each task from the same weights, and the weights of all tasks are averaged by their
tokens, in the order of the tasks; that is done in ROUNDS rounds, which share out all training
documents, so every token is learned from once.

Every text is split and looked up once: its words' numbers are written and serve training and
scoring. Scoring carries the state over windows through a whole document. Counts of the HEAD
most frequent words are broadcast, a bounded table; the others are joined.

Defined results: a null text is an empty text, one end token; a document without words has
the score of its end alone; without training documents every score is 0; rows without an id
are scored but not learned from; rows that repeat an id are scored one by one.
"""

from __future__ import annotations

import heapq
import sys
from collections import Counter
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import map_batches, remainder, small_batches
from corpusgate.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = b"\n"          # no word holds a line feed
SHORT = 2047         # words that the network tells apart
HEAD = 1 << 16       # words whose counts every task holds
SMOOTH = 0.1
HIDDEN = 12
CLASS = 64           # words of a class
ROUNDS = 2           # every training document is in one of them
LANES, WINDOW = 512, 16
SCORE_LANES, SCORE_WINDOW, MIN_LANES = 512, 64, 64
CHUNK = 1 << 22      # tokens scored at once, if no document is longer
TOP = 80.0           # logits beyond it are held there, so no exponential overflows
RATE, FLAT = 0.1, 1e-6  # step size, and where the sums of squared gradients begin
BLOCKS = 32
FEED = 1 << 11       # documents looked up or learned from at once
NUMBER = np.int16    # of a word
LOG10 = float(np.log(10))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


# ---- counts -------------------------------------------------------------------------------------

def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c) over all rows, ends of documents included; folded in every task first."""
    def make():
        def work(batch):
            found = Counter()
            for text in batch["text"]:
                found.update(words_of(text))
                found[END] += 1
            return {"word": list(found), "c": list(found.values())}
        return work

    part = map_batches(docs.select(F.col(text_col).alias("text")), make, "word BINARY, c BIGINT")
    return part.groupBy("word").agg(F.sum("c").alias("c"))


class Lexicon:
    """Frequent words, their numbers in the network, and base probabilities.

    Numbers run from 0; the first of the class after the last word's stands for all other
    words, and the one after that for the start of a document.
    """

    def __init__(self, head: list[tuple[bytes, int]], total: int, distinct: int):
        self.total, self.distinct = total, distinct
        self.floor = total + SMOOTH * (distinct + 1)
        counts = dict(head)
        ends = counts.pop(END, 0)
        order = sorted(counts, key=lambda w: (-counts[w], w))
        short = [END, *order[:SHORT - 1]] if total else []
        counts[END] = ends
        mass = [(counts[w] + SMOOTH) / self.floor for w in short]
        self.rest = max(1.0 - sum(mass), SMOOTH / self.floor)
        ranked = sorted(range(len(short)), key=lambda i: -mass[i])
        self.number = {short[i]: n for n, i in enumerate(ranked)}
        self.other = -(-len(short) // CLASS) * CLASS
        self.start = self.other + 1
        self.share = np.zeros(self.other + 1)
        self.share[:len(short)], self.share[-1] = [mass[i] for i in ranked], self.rest
        seen = [w for w, c in counts.items() if c]
        chance = np.log10((np.array([counts[w] for w in seen]) + SMOOTH) / self.floor)
        self.base = dict(zip(seen, chance.tolist()))

    def numbers(self, text: str | None) -> np.ndarray:
        other, get = self.other, self.number.get
        return np.array([get(w, other) for w in words_of(text)] + [get(END, other)], NUMBER)


# ---- the network --------------------------------------------------------------------------------

def initial(lexicon: Lexicon) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    n, h = lexicon.other + 1, HIDDEN
    classes = -(-n // CLASS)
    share = np.zeros(classes * CLASS)
    share[:n] = lexicon.share
    by_class = share.reshape(classes, CLASS)
    mass = by_class.sum(axis=1)
    with np.errstate(divide="ignore"):
        word_bias = np.where(by_class > 0, np.log(by_class / mass[:, None]), -30.0)

    def draw(*shape):
        return rng.normal(0, 1 / np.sqrt(h), shape).astype(np.float32)

    return {"embed": draw(n + 1, h), "wx": draw(h, 3 * h), "wh": draw(h, 3 * h),
            "b": np.zeros(3 * h, np.float32), "wc": 0.1 * draw(h, classes),
            "bc": np.log(mass).astype(np.float32), "wo": 0.1 * draw(classes, h, CLASS),
            "bo": word_bias.astype(np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(np.minimum(x, TOP, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def run_gates(p: dict, x: np.ndarray, h: np.ndarray, keep: np.ndarray, trace: dict | None):
    """States of a window; `x` is (steps, lanes, 3 hidden), `keep` 0 where a document starts."""
    if trace is None:
        return _run_gates_across(p, x, h, keep)
    n = HIDDEN
    out = np.empty((len(x), len(h), n), np.result_type(x, h))
    trace |= {k: np.empty_like(out) for k in ("before", "new", "gn", "z", "r")}
    for t in range(len(x)):
        h = h * keep[t][:, None]
        g = h @ p["wh"]
        zr = _sigmoid(x[t, :, :2 * n] + g[:, :2 * n])
        new = zr[:, n:] * g[:, 2 * n:]
        new += x[t, :, 2 * n:]
        np.tanh(new, out=new)
        trace["before"][t], trace["new"][t], trace["gn"][t] = h, new, g[:, 2 * n:]
        trace["z"][t], trace["r"][t] = zr[:, :n], zr[:, n:]
        h -= new
        h *= zr[:, :n]
        h += new
        out[t] = h
    return out, h


def _run_gates_across(p: dict, x: np.ndarray, h: np.ndarray, keep: np.ndarray):
    """The same without a trace; lanes lie side by side, so every gate is one run of memory."""
    n = HIDDEN
    out = np.empty((len(x), n, len(h)), np.result_type(x, h))
    x = np.ascontiguousarray(x.transpose(0, 2, 1))
    by, h = np.ascontiguousarray(p["wh"].T), np.ascontiguousarray(h.T)
    for t in range(len(x)):
        h = h * keep[t]
        g = by @ h
        g[:2 * n] += x[t, :2 * n]
        zr, new = _sigmoid(g[:2 * n]), g[2 * n:]
        new *= zr[n:]
        new += x[t, 2 * n:]
        np.tanh(new, out=new)
        h -= new
        h *= zr[:n]
        h += new
        out[t] = h
    return np.ascontiguousarray(out.transpose(0, 2, 1)), h.T


def _choose(x: np.ndarray, at: np.ndarray, gradient: bool):
    """Log-probability of place `at` of every row of logits; `x` becomes the gradient."""
    rows = np.arange(len(x))
    np.minimum(x, TOP, out=x)
    chosen = x[rows, at].astype(np.float64)
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    chosen -= np.log(total)
    if gradient:
        x /= total[:, None]
        x[rows, at] -= 1
    return chosen


def log_probs(p: dict, h: np.ndarray, target: np.ndarray, grads: dict | None):
    """Natural log-probability of every target, and the gradient of minus their sum by h.

    Rows are sorted by the class of their target once; each class is then one product. The
    last class has one symbol, which is certain in it.
    """
    want = grads is not None
    order = np.argsort((target // CLASS).astype(np.int16), kind="stable")
    h, target = h[order], target[order]
    cls, word = target // CLASS, target % CLASS
    d = h @ p["wc"]
    d += p["bc"]
    found = _choose(d, cls, want)
    if want:
        dh = d @ p["wc"].T
        grads["wc"], grads["bc"] = h.T @ d, d.sum(axis=0)
        grads["wo"], grads["bo"] = np.zeros_like(p["wo"]), np.zeros_like(p["bo"])
    ends = np.searchsorted(cls, np.arange(len(p["wo"]))).tolist()
    for c, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
        if lo == hi:
            continue
        own = h[lo:hi]
        d = own @ p["wo"][c]
        d += p["bo"][c]
        found[lo:hi] += _choose(d, word[lo:hi], want)
        if want:
            dh[lo:hi] += d @ p["wo"][c].T
            grads["wo"][c] = own.T @ d
            grads["bo"][c] = d.sum(axis=0)
    out = np.empty_like(found)
    out[order] = found
    if not want:
        return out, None
    back = np.empty_like(dh)
    back[order] = dh
    return out, back


class Symbols(NamedTuple):
    """The two numbers that stand for no word."""

    other: int
    start: int


class Trainer:
    """Truncated backpropagation over lanes of documents put end to end."""

    def __init__(self, params: dict[str, np.ndarray], lexicon: Lexicon | Symbols):
        self.p = {k: v.copy() for k, v in params.items()}
        self.lexicon = lexicon
        self.seen = {k: np.full_like(v, FLAT) for k, v in params.items()}
        self.tokens = 0

    def feed(self, docs: list[np.ndarray]):
        """Learn from documents given as numbers."""
        lx = self.lexicon
        if not docs:
            return
        target = np.concatenate(docs)
        first = np.cumsum([0] + [len(d) for d in docs[:-1]])
        source = np.concatenate([[lx.start], target[:-1]]).astype(NUMBER)
        source[first] = lx.start
        keep = np.ones(len(target), np.float32)
        keep[first] = 0
        self.tokens += len(target)
        lanes = min(LANES, len(target))
        steps = -(-len(target) // lanes)
        # The last lanes are filled up with starts of documents that predict nothing.
        fill = lanes * steps - len(target)
        cut = lambda a, v: np.append(a, np.full(fill, v, a.dtype)).reshape(
            lanes, steps).T
        real = cut(np.ones(len(target), bool), False)
        source, target, keep = cut(source, lx.start), cut(target, lx.other), cut(keep, 0)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, steps, WINDOW):
            w = slice(t, t + WINDOW)
            h = self._window(source[w], target[w], keep[w], h, real[w])

    def _window(self, source, target, keep, h, real=None):
        p, n, trace = self.p, HIDDEN, {}
        inputs = p["embed"][source]
        states, last = run_gates(p, inputs @ p["wx"] + p["b"], h, keep, trace)
        grads: dict[str, np.ndarray] = {}
        if real is None or real.all():
            _lp, dh = log_probs(p, states.reshape(-1, n), target.ravel(), grads)
        else:
            at, dh = real.ravel(), np.zeros((target.size, n), states.dtype)
            _lp, dh[at] = log_probs(p, states.reshape(-1, n)[at], target.ravel()[at], grads)
        dh = dh.reshape(states.shape)
        before, new, z, r = (trace[k] for k in ("before", "new", "z", "r"))
        # What does not depend on later steps is made for the whole window at once.
        by_new = (1 - z) * (1 - new * new)
        by_z = (before - new) * z * (1 - z)
        by_r = trace["gn"] * r * (1 - r)
        dx = np.empty((*source.shape, 3 * n), states.dtype)
        dg = np.empty_like(dx)
        back, carry = np.ascontiguousarray(p["wh"].T), np.zeros_like(h)
        for t in range(len(source) - 1, -1, -1):
            d = dh[t] + carry
            dn = d * by_new[t]
            dx[t, :, :n] = d * by_z[t]
            dx[t, :, n:2 * n] = dn * by_r[t]
            dx[t, :, 2 * n:] = dn
            dg[t, :, :2 * n] = dx[t, :, :2 * n]
            dg[t, :, 2 * n:] = dn * r[t]
            carry = dg[t] @ back
            d *= z[t]
            carry += d
            carry *= keep[t][:, None]
        flat = dx.reshape(-1, 3 * n)
        grads["wh"] = before.reshape(-1, n).T @ dg.reshape(-1, 3 * n)
        grads["b"], grads["wx"] = flat.sum(axis=0), inputs.reshape(-1, n).T @ flat
        count = float(source.size if real is None else real.sum())
        words = source.ravel()
        order = np.argsort(words.astype(np.int16), kind="stable")
        used, first = np.unique(words[order], return_index=True)
        self._step("embed", np.add.reduceat((flat @ p["wx"].T)[order], first) / count, used)
        for k, g in grads.items():
            self._step(k, g / count, slice(None))
        return last

    def _step(self, name: str, grad: np.ndarray, at):
        grad = np.clip(grad, -1, 1)
        self.seen[name][at] += grad * grad
        self.p[name][at] -= RATE * grad / np.sqrt(self.seen[name][at])


def pack(params: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([params[k].ravel() for k in sorted(params)])


def unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _average(pdf: pd.DataFrame) -> pd.DataFrame:
    """Weighted mean of the parameter blocks of several tasks, in the order of the tasks."""
    pdf = pdf.sort_values(["lot", "task"])
    weight = pdf["weight"].sum()
    total = sum(np.frombuffer(v, np.float32).astype(np.float64) * w
                for v, w in zip(pdf["part"], pdf["weight"]))
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "lot": [pdf["lot"].iloc[0]], "task": [0], "weight": [weight],
                         "part": [(total / weight).astype(np.float32).tobytes()]})


_PARTS = "block INT, lot INT, task INT, weight DOUBLE, part BINARY"


def train_round(heads: DataFrame, lexicon: Lexicon, params: dict) -> dict:
    """Train on the `ids` of all rows where they lie, and average; the driver gets one set of
    weights."""
    spark = heads.sparkSession
    shared = spark.sparkContext.broadcast((params, lexicon.other, lexicon.start))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        weights, other, start = shared.value
        trainer = Trainer(weights, Symbols(other, start))
        for batch in batches:
            for lo in range(0, batch.num_rows, FEED):
                rows = batch.column(0).slice(lo, FEED).to_pylist()
                trainer.feed([np.frombuffer(x, NUMBER) for x in rows])
        if trainer.tokens:
            parts = np.array_split(pack(trainer.p), BLOCKS)
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array(range(BLOCKS), pa.int32()),
                 "lot": pa.array([task % 64] * BLOCKS, pa.int32()),
                 "task": pa.array([task] * BLOCKS, pa.int32()),
                 "weight": [float(trainer.tokens)] * BLOCKS,
                 "part": [x.astype(np.float32).tobytes() for x in parts]})

    trained = heads.select("ids").mapInArrow(run, _PARTS)
    for keys in (["block", "lot"], ["block"]):
        trained = trained.groupBy(*keys).applyInPandas(_average, _PARTS)
    rows = sorted(trained.collect(), key=lambda r: r["block"])
    if not rows:
        return params
    return unpack(np.concatenate([np.frombuffer(r["part"], np.float32) for r in rows]), params)


# ---- scoring ------------------------------------------------------------------------------------

class Scorer:
    def __init__(self, params: dict[str, np.ndarray], lexicon: Lexicon | Symbols):
        self.p, self.lexicon = params, lexicon
        self.table = params["embed"] @ params["wx"] + params["b"]

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of whole documents, given as numbers.

        Documents are dealt to lanes, longest first; a lane takes its documents one after
        the other and its state starts afresh with each. Lanes lie end to end, so memory
        follows the tokens, however unequal the lanes are.
        """
        if not self.lexicon.other:  # one symbol, which is certain
            return np.zeros(len(docs))
        sizes = [len(d) for d in docs]
        lanes = min(len(docs), SCORE_LANES, max(MIN_LANES, sum(sizes) // max(sizes)))
        heap, dealt = [(0, i) for i in range(lanes)], [[] for _ in range(lanes)]
        for i in sorted(range(len(docs)), key=lambda i: -sizes[i]):
            used, lane = heapq.heappop(heap)
            dealt[lane].append(i)
            heapq.heappush(heap, (used + sizes[i], lane))
        # Longest lane first, so the lanes still running are always the first ones.
        dealt.sort(key=lambda own: -sum(sizes[i] for i in own))
        load = np.array([sum(sizes[i] for i in own) for own in dealt])
        order = [i for own in dealt for i in own]
        target = np.concatenate([docs[i] for i in order])
        size = np.array([sizes[i] for i in order])
        first = np.cumsum(size) - size
        source = np.concatenate([[self.lexicon.start], target[:-1]]).astype(NUMBER)
        source[first] = self.lexicon.start
        keep = np.ones(len(target), bool)
        keep[first] = False
        chance, begin = np.zeros(len(target)), np.cumsum(load) - load
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, int(load[0]), SCORE_WINDOW):
            on = int((load > t).sum())
            step = t + np.arange(SCORE_WINDOW)[:, None]
            real = step < load[:on]
            at = np.where(real, begin[:on] + step, begin[:on])
            states, h = run_gates(self.p, self.table[source[at]], h[:on], keep[at], None)
            own = at[real]
            chance[own], _ = log_probs(self.p, states[real], target[own], None)
        out = np.empty(len(docs))
        out[order] = np.add.reduceat(chance, first)
        return out


_HEADS = ("n_tokens BIGINT, n_known BIGINT, base DOUBLE, others BIGINT, base_other DOUBLE, "
          "rare ARRAY<BINARY>, rare_n ARRAY<BIGINT>, ids BINARY")


def heads_of(docs: DataFrame, id_col: str, text_col: str, lexicon) -> DataFrame:
    """(id, n_tokens, n_known, base, others, base_other, rare, rare_n, ids): all that the head
    table decides.

    `ids` are the numbers of the words, `others` counts those that the network does not tell
    apart, `base_other` is their base score; `rare` lists words outside the head.
    """
    def make():
        lx = Lexicon(*lexicon.value)
        place = {w: i for i, w in enumerate(lx.base)}.get
        base = np.array([*lx.base.values(), 0.0])
        number = np.array([*(lx.number.get(w, lx.other) for w in lx.base), lx.other], NUMBER)
        names = [x.split()[0] for x in _HEADS.split(", ")]

        def work(batch):
            out = {k: [] for k in names}
            for text in batch["text"]:
                words = words_of(text)
                words.append(END)
                at = np.fromiter(map(place, words, repeat(-1)), np.int32, len(words))
                unknown = np.flatnonzero(at < 0)
                ids, chance = number[at], base[at]
                other = ids == lx.other
                rare = Counter([words[i] for i in unknown.tolist()])
                for name, value in zip(names, (
                        len(words), len(words) - len(unknown), float(chance.sum()),
                        int(other.sum()), float(chance[other].sum()), list(rare),
                        list(rare.values()), ids.tobytes())):
                    out[name].append(value)
            return {"id": batch["id"], **out}
        return work

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(rows, make, f"id {kind}, {_HEADS}", FEED)


def with_net(heads: DataFrame, lexicon: Lexicon, params: dict) -> DataFrame:
    """`heads` with `net`, the network's log10 probability, all other words being one symbol."""
    symbols = Symbols(lexicon.other, lexicon.start)
    shared = heads.sparkSession.sparkContext.broadcast(params)
    names = [c for c in heads.columns if c != "ids"]

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(shared.value, symbols)

        def scored():
            net = pa.array(scorer.score(docs) / LOG10)
            at = 0
            for part in parts:
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + [net.slice(at, part.num_rows)], [*names, "net"])
                at += part.num_rows

        # Lanes are as full as the documents at hand allow, which are more than a batch's.
        parts, docs, held = [], [], 0
        for batch in batches:
            lo = 0
            for i, ids in enumerate(batch.column("ids").to_pylist()):
                docs.append(np.frombuffer(ids, NUMBER))
                held += len(docs[-1])
                if held >= CHUNK:
                    parts.append(batch.slice(lo, i + 1 - lo).select(names))
                    yield from scored()
                    parts, docs, held, lo = [], [], 0, i + 1
            if lo < batch.num_rows:
                parts.append(batch.slice(lo).select(names))
        if docs:
            yield from scored()

    small_batches(heads.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in heads.schema
                      if f.name != "ids")
    return heads.mapInArrow(run, f"{kinds}, net DOUBLE")


def learn(docs: DataFrame, train: Column, text_col: str):
    """(lexicon, its broadcast as a table, counts) from the rows that `train` names."""
    spark = docs.sparkSession
    counts = materialize(word_counts(docs.where(train), text_col), "counts")
    size = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # The head is cut between steps of the count's logarithm: a few hundred rows decide where.
    step = F.floor(8 * F.log2("c"))
    sizes = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, room = None, HEAD
    for r in sorted(sizes, key=lambda r: -r["step"]):
        room -= r["n"]
        if room < 0:
            break
        least = r["step"]
    head = [] if least is None else counts.where(step >= least).collect()
    pairs = {bytes(r["word"]): r["c"] for r in head}
    ends = counts.where(F.col("word") == F.lit(END)).first()
    if ends is not None:
        pairs[END] = ends["c"]
    table = (sorted(pairs.items()), size["n"] or 0, size["v"])
    return Lexicon(*table), spark.sparkContext.broadcast(table), counts


def train(heads: DataFrame, slices: Column, lexicon: Lexicon) -> dict:
    """Weights trained on all of `heads`; round i takes the slices that are i modulo ROUNDS."""
    params = initial(lexicon)
    for i in range(ROUNDS):
        params = train_round(heads.where(F.pmod(slices, F.lit(ROUNDS)) == i), lexicon, params)
    return params


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    folds: int = 10, held: int = 0) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32 of the id is `held` modulo `folds` are held out of all learning.
    """
    def learned(name):
        return F.coalesce(remainder(name, folds) != held, F.lit(False))

    lx, shared, counts = learn(docs, learned(id_col), text_col)
    heads = heads_of(docs, id_col, text_col, shared)
    heads = materialize(heads.withColumn("row", F.monotonically_increasing_id()), "heads")
    params = train(heads.where(learned("id")).select("id", "ids"), F.xxhash64("id"), lx)
    rare = heads.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("w")).select(
        "row", F.col("w.rare").alias("word"), F.col("w.rare_n").alias("n"))
    floor, c = F.lit(lx.floor), F.coalesce("c", F.lit(0))
    joined = rare.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("n") * F.log10((c + SMOOTH) / floor)).alias("rare_base"))
    rows = with_net(heads.drop("rare", "rare_n"), lx, params).join(joined, "row", "left")
    extra = F.coalesce("rare_base", F.lit(0.0))
    other = F.col("base_other") + extra - F.col("others") * F.lit(float(np.log10(lx.rest)))
    return rows.select(
        F.col("id").alias(id_col),
        F.coalesce(remainder("id", folds) == held, F.lit(False)).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(lx.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + extra).alias("base_score"), (F.col("net") + other).alias("score"))

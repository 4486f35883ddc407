"""Language identification with averaged hashed subword embeddings.

A text is the average of the embeddings of the hashed n-grams of its words, taken over UTF-8; a linear
softmax turns the average into probabilities. Embeddings and softmax are trained by
stochastic gradient descent in numpy on a bounded, repeatable sample of labelled rows. A
held-back part of the sample sets the softmax temperature and the score below which a
prediction is rejected, so that about REJECT of right predictions would be.

Since embedding and softmax are linear, prediction adds up one row of class scores per
n-gram; it reads whole texts and nothing but texts.

Defined results: a null text, or one without a letter, is `und` with score 0 and is
rejected; so is every text when no labelled row exists. One known language has score 1.
Ties go to the first label in code point order. Every label with a letter in one of its texts
is learned. Rows with a null id or label are predicted but never learned from.
"""

from __future__ import annotations

import re
import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.llm.common import giving_back, map_batches, remainder, small_batches
from corpusgate.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
BUCKETS = 1 << 15
DIM = 16
GRAMS = (1, 2, 3, 4, 5)   # in bytes of UTF-8
SAMPLE = 4000        # labelled rows that training sees, about the same number per label
EPOCHS = 3
RATE = 4.0
REJECT = 0.001
CALIBRATE = 5        # every fifth sampled row calibrates
FEW = 64                # labels up to which the next two hold; with more they shrink
REMEMBERED = 1 << 17
SLICE = 1 << 10         # rows with all their columns held at once
CHUNK = 1 << 15         # words whose scores are added up at once
LOT = 1 << 10           # new words whose n-grams are looked up at once
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return LETTERS.findall((text or "").lower())


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, starts): hashed n-grams of each word, its ends marked, words one by one."""
    data = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    length = np.array([len(d) for d in data])
    codes = np.frombuffer(b"".join(data) + bytes(max(GRAMS)), np.uint8).astype(np.uint64)
    n = int(length.sum())
    ends = np.repeat(np.cumsum(length), length)
    at, order = np.arange(n), np.repeat(np.arange(len(data)), length)
    h, found, owner = np.zeros(n, np.uint64), [], []
    with np.errstate(over="ignore"):
        for size in range(1, max(GRAMS) + 1):
            h = (h ^ codes[size - 1:size - 1 + n]) * np.uint64(0x9E3779B97F4A7C15)
            if size in GRAMS:
                inside = at + size <= ends
                found.append((h[inside] >> np.uint64(64 - BUCKETS.bit_length() + 1)))
                owner.append(order[inside])
    owner = np.concatenate(owner)
    by_word = np.argsort(owner, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(data)))[:-1]])
    return np.concatenate(found)[by_word].astype(np.int64), starts


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray      # class scores of each bucket, BUCKETS x labels
    bias: np.ndarray
    temperature: float
    threshold: float


class Numbers(dict):
    """Numbers words as they are met."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Predictor:
    """Scores texts; remembers the class scores of words."""

    def __init__(self, model: Model):
        self.model = model
        labels = max(FEW, len(model.labels))
        self.remembered, self.chunk = REMEMBERED * FEW // labels, CHUNK * FEW // labels
        self.lot = max(1, LOT * FEW // labels)
        self._forget()

    def _forget(self):
        self.known, self.sums = Numbers(), np.zeros((0, len(self.model.labels) + 1))

    def _learn(self):
        """Class scores and number of n-grams of the words met since the last time."""
        new, found = list(self.known)[len(self.sums):], [self.sums]
        for lo in range(0, len(new), self.lot):
            buckets, starts = grams_of(new[lo:lo + self.lot])
            sums = np.add.reduceat(self.model.table[buckets], starts, axis=0)
            count = np.diff(np.append(starts, len(buckets)))[:, None]
            found.append(np.hstack([sums, count]))
        self.sums = np.concatenate(found)

    def _flush(self, waiting: list[list[int]], out: list[tuple[str, float]]):
        self._learn()
        full = [w for w in waiting if w]
        if full:
            starts = np.cumsum([0] + [len(w) for w in full[:-1]])
            words = np.fromiter((i for w in full for i in w), np.int64)
            total = np.add.reduceat(self.sums[words], starts, axis=0)
            z = (total[:, :-1] / total[:, -1:] + self.model.bias) / self.model.temperature
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            found = iter(zip(best.tolist(), p[np.arange(len(p)), best].tolist()))
        for w in waiting:
            if w:
                i, score = next(found)
                out.append((self.model.labels[i], score))
            else:
                out.append((UNKNOWN, 0.0))
        waiting.clear()
        if len(self.known) > self.remembered:
            self._forget()

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        waiting, out, held = [], [], 0
        for text in texts:
            known = self.known
            if text and self.model.labels and any(map(str.isalpha, text)):
                waiting.append(list(map(known.__getitem__, words_of(text))))
                held += len(waiting[-1])
            else:
                waiting.append([])
            if held >= self.chunk:
                self._flush(waiting, out)
                held = 0
        self._flush(waiting, out)
        return out


def _features(sample: DataFrame) -> DataFrame:
    """(label, place, bucket, share): n-gram shares of every sampled whole text, packed."""
    def make():
        def work(batch):
            out = {"label": [], "place": [], "bucket": [], "share": []}
            for text, label, place in zip(batch["text"], batch["label"], batch["place"]):
                words = words_of(text)
                if words:
                    bucket, n = np.unique(grams_of(words)[0], return_counts=True)
                    out["label"].append(label)
                    out["place"].append(place)
                    out["bucket"].append(bucket.astype(np.int32).tobytes())
                    out["share"].append((n / n.sum()).astype(np.float32).tobytes())
            return out
        return work

    return map_batches(sample, make, "label STRING, place BIGINT, bucket BINARY, share BINARY")


def draw(labelled: DataFrame, text: str, label: str, key: str, size: int) -> DataFrame:
    """(text, label, place): about `size` labelled rows, evenly over labels, one each at least.

    Counting labels is a combinable aggregate of one row per label, which is broadcast. Each
    row then decides by its own hash whether it is in, so no label is gathered anywhere. The
    lowest hash of a label's texts with letters is in whatever the label's share is.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"),
                           F.xxhash64(F.col(key)).alias("place")).where(
        F.col("label").isNotNull() & F.col(key).isNotNull())
    at = F.pmod("place", F.lit(1 << 30))
    counts = materialize(rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("text").rlike(r"\p{L}"), at)).alias("least")), "labels")
    each = size / max(1, counts.count())
    share = F.least(F.lit(1.0), F.lit(each) / F.col("n"))
    return rows.join(F.broadcast(counts), "label").where(
        (at < share * F.lit(float(1 << 30))) | (at == F.col("least"))).select(
        "text", "label", "place")


def train(rows: list, labels: list[str]) -> Model:
    """Gradient descent over sampled rows, then calibration on every fifth."""
    rng = np.random.default_rng(1)
    k, number = len(labels), {label: i for i, label in enumerate(labels)}
    data = [(np.frombuffer(r["bucket"], np.int32), np.frombuffer(r["share"], np.float32)[:, None],
             number[r["label"]]) for r in rows]
    held = data[::CALIBRATE] if len(data) >= 10 * CALIBRATE else []
    fit = [d for i, d in enumerate(data) if i % CALIBRATE] if held else data
    # A label that only calibration has drawn is learned from there.
    known = {d[2] for d in fit}
    fit += [d for d in held if d[2] not in known]
    emb = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, k), np.float32), np.zeros(k, np.float32)
    steps, total = 0, EPOCHS * len(fit)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(fit)):
            bucket, share, y = fit[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            own = emb[bucket]
            x = (own * share).sum(axis=0)
            z = x @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= 0.1 * rate * np.outer(x, p)
            bias -= 0.01 * rate * p
            emb[bucket] = own - rate * share * back * min(len(bucket), 64)
    table = (emb @ out).astype(np.float64)
    model = Model(labels, table, bias.astype(np.float64), 1.0, 0.0)
    if held and k > 1:
        z = np.array([(table[b] * s).sum(axis=0) for b, s, _y in held]) + model.bias
        y = np.array([d[2] for d in held])

        def loss(t: float) -> float:
            q = z / t - (z / t).max(axis=1, keepdims=True)
            return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(y)), y]).mean())

        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        q = z / model.temperature
        q = np.exp(q - q.max(axis=1, keepdims=True))
        q /= q.sum(axis=1, keepdims=True)
        right = np.sort(q.max(axis=1)[q.argmax(axis=1) == y])
        if len(right):
            model.threshold = float(right[int(REJECT * (len(right) + 1))]) * (1 - 1e-9)
    return model


_MODEL = "labels ARRAY<STRING>, table BINARY, bias BINARY, temperature DOUBLE, threshold DOUBLE"


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id",
        size: int = SAMPLE) -> Model:
    """Train on a sample of at most about `size` rows; the driver gets the model alone.

    The sample is stored and trained on by one task, so that the n-gram shares of its texts,
    some 17 KB each, take no memory of the driver.
    """
    sample = materialize(_features(draw(labelled, text, label, key, size)), "sample")

    def learn(batches):
        import pyarrow as pa

        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: (r["place"], r["label"], r["bucket"]))
        labels = sorted({r["label"] for r in rows}, key=lambda s: s.encode())
        if labels:
            m = train(rows, labels)
            yield pa.RecordBatch.from_pydict({
                "labels": pa.array([m.labels], pa.list_(pa.string())),
                "table": [m.table.tobytes()], "bias": [m.bias.tobytes()],
                "temperature": [m.temperature], "threshold": [m.threshold]})

    found = sample.coalesce(1).mapInArrow(giving_back(learn), _MODEL).collect()
    if not found:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    m = found[0]
    return Model(list(m["labels"]), np.frombuffer(m["table"]).reshape(BUCKETS, -1),
                 np.frombuffer(m["bias"]), m["temperature"], m["threshold"])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, accepted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.labels, model.table, model.bias, model.temperature, model.threshold))
    rows = docs.select(id_col, text_col)

    def make():
        worker = Predictor(Model(*shared.value))

        def work(batch):
            found = worker.predict(batch[text_col])
            least = worker.model.threshold
            return {id_col: batch[id_col], "lang_pred": [f[0] for f in found],
                    "score": [f[1] for f in found],
                    "accepted": [f[0] != UNKNOWN and f[1] >= least for f in found]}
        return work

    return map_batches(rows, make, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, "
                                   "lang_pred STRING, score DOUBLE, accepted BOOLEAN")


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language the model accepts."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.labels, model.table, model.bias, model.temperature, model.threshold))
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        worker = Predictor(Model(*shared.value))
        least = worker.model.threshold
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                found = worker.predict(part.column(at).to_pylist())
                yield part.filter(pa.array([f[0] != UNKNOWN and f[1] >= least for f in found],
                                           pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(giving_back(run), docs.schema)


def learnable(docs: DataFrame, key: str = "doc_id", mod: int = 4, out: int = 2) -> Column:
    """Rows to learn from: those outside the held-out remainder."""
    return F.coalesce(remainder(key, mod) != out, F.lit(False))

"""Structured Streaming forms of the checks: intake, dedupe, gates, sessions, collisions."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from corpusgate.operators import rules as R
from corpusgate.session import DEFAULTS


def intake_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                  glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder, each picked up once (the sink's checkpoint remembers them)."""
    reader = (spark.readStream.format(fmt).schema(schema)
              .option("maxFilesPerTrigger", files_per_trigger))
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def dedupe_stream(notes: DataFrame, ts: str, delay: str = "1 hour",
                  key: str = "text") -> DataFrame:
    """Drops exact repeats that arrive within the watermark.

    The state is keyed by the digest of the text, so copies of one text meet in one place
    but only their first row is kept there.
    """
    marked = notes.withWatermark(ts, delay).withColumn("_digest", F.sha2(F.col(key), 256))
    return marked.dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def gate_counts_by_window(rows: DataFrame, ts: str, by: list, width: str = "1 hour",
                          slide: str | None = None, delay: str | None = None) -> DataFrame:
    """(window start, by..., n): findings per time window; late rows fall to the watermark.

    Works on batches and streams alike; with `delay` it is a stream with a watermark.
    """
    source = rows.withWatermark(ts, delay) if delay else rows
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    return (source.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
            .select(F.col("w.start").alias("start"), *by, "n"))


def gate_stream(notes: DataFrame, ts: str, width: str = "1 hour", slide: str | None = None,
                delay: str | None = None) -> DataFrame:
    """(start, rule, n): house-rule, dose and provenance findings per window."""
    flags = F.concat(R.house_rules(audit=True),
                     R.flag_list((R.dose_without_drug(), "dose without drug")))
    if "textbook" in notes.columns and "tags" in notes.columns:
        flags = F.concat(flags, R.provenance_blank())
    found = notes.select(ts, F.explode(flags).alias("rule"))
    return gate_counts_by_window(found, ts, ["rule"], width, slide, delay)


def activity_sessions(events: DataFrame, ts: str, by: list[str], gap: str = "180 minutes",
                      delay: str | None = None) -> DataFrame:
    """(by..., start, end, n): sessions with a gap, for streams.

    For batches `operators.order.sessions` gives the same rows and splits a key that holds
    a large share of the events.
    """
    source = events.withWatermark(ts, delay) if delay else events
    grouped = source.groupBy(F.session_window(ts, gap).alias("w"), *by)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(
        *by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


CLAIM = ["subject", "attribute", "value"]
HELD = pa.schema([*((c, pa.string()) for c in CLAIM), ("until", pa.int64())])
BEFORE = np.iinfo(np.int64).min   # start of what was held before the rows at hand
PAIRS = 1 << 20                   # spans of a claim compared at a time


def packed(held: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(held)
    return out.getvalue().to_pybytes()


def unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(rows).read_all()


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def meetings(claim: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple]:
    """Pairs (i, j) of spans in order of claim and start: j came before i and is held when i starts.

    What all earlier spans of the claim have left behind is skipped by the running maximum of
    their ends; the rest is compared in pieces of at most PAIRS, or one span's.
    """
    times, at = np.unique(np.concatenate([start, end]), return_inverse=True)
    began, ended = (claim * len(times) + part for part in np.split(at, 2))
    low = np.searchsorted(np.maximum.accumulate(ended), began, "right")
    count = np.where(start == BEFORE, 0, np.maximum(np.arange(len(claim)) - low, 0))
    total = np.cumsum(count)
    done = 0
    while done < len(claim):
        base = total[done - 1] if done else 0
        to = max(done + 1, int(np.searchsorted(total, base + PAIRS, "right")))
        i = np.repeat(np.arange(done, to), count[done:to])
        j = np.arange(len(i)) - (total[i] - count[i] - base) + low[i]
        met = end[j] > start[i]
        yield i[met], j[met]
        done = to


def collide(held: pa.Table, found: pa.Table, keep_ms: int) -> tuple[pa.Table, pd.DataFrame]:
    """(held, collisions) after the rows found, which have the columns of CLAIM and `at`.

    Sightings of a value make a span as long as each comes before the last one has run out. A
    span that begins is reported with the other values whose spans cover its start; what starts
    at the same time counts in the order of the values. All steps work on whole columns.
    """
    def codes(name: str) -> tuple[np.ndarray, pa.Array]:
        column = pa.chunked_array([*held[name].chunks, *found[name].chunks], pa.string())
        told = column.combine_chunks().dictionary_encode()
        return told.indices.to_numpy().astype(np.int64), told.dictionary

    (subject, subjects), (attribute, attributes), (value, values) = map(codes, CLAIM)
    by_name = pc.sort_indices(values).to_numpy()
    value, values = np.argsort(by_name)[value], values.take(pa.array(by_name))
    at = found["at"].to_numpy()
    start = np.concatenate([np.full(held.num_rows, BEFORE), at])
    end = np.concatenate([held["until"].to_numpy(), at + keep_ms])

    order = np.lexsort((start, value, attribute, subject))
    subject, attribute, value, start, end = (c[order] for c in (subject, attribute, value, start, end))
    first = firsts(subject, attribute, value)
    # What was held before leads its value and alone may run out later than what follows it.
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    end = np.where(start[lead] == BEFORE, np.maximum(end, end[lead]), end)
    begins = first.copy()
    begins[1:] |= (end[:-1] <= start[1:]) & (start[:-1] < start[1:])
    head = np.flatnonzero(begins)
    end = end[np.append(head[1:], len(order)) - 1]
    subject, attribute, value, start = (c[head] for c in (subject, attribute, value, start))

    def names(at: np.ndarray) -> list[pa.Array]:
        return [d.take(pa.array(c[at])) for d, c in (
            (subjects, subject), (attributes, attribute), (values, value))]

    last = np.flatnonzero(np.append(first[head][1:], True))
    kept = pa.table([*names(last), pa.array(end[last])], schema=HELD)

    order = np.lexsort((value, start, attribute, subject))
    claim = np.cumsum(firsts(subject[order], attribute[order]))
    pairs = list(meetings(claim, start[order], end[order]))
    new, other = (order[np.concatenate(part)] for part in zip(*pairs))
    by_value = np.lexsort((value[other], new))
    new, other = new[by_value], other[by_value]
    at = np.flatnonzero(firsts(new)) if len(new) else new
    out = pd.DataFrame({c: column.to_numpy(zero_copy_only=False) for c, column in zip(CLAIM, names(new[at]))})
    out["at"] = pd.to_datetime(start[new[at]], unit="ms")
    out["others"] = pd.Series(np.split(
        values.to_numpy(zero_copy_only=False)[value[other]], at[1:]) if len(at) else [], dtype=object)
    return kept, out


class ValueSet(StatefulProcessor):
    """Keeps the values of claims, each until `keep_ms` after its last sighting.

    A value that is not held is reported with the others that are held at its time. What the
    watermark has passed is dropped with the next rows or by a timer in event time, so the state
    holds what may still collide and no more. One call serves a hash bucket of many claims, whose
    state is one Arrow table: a call and a state of their own cost milliseconds a claim, and a
    row of state or a step in Python costs as much as all steps on columns.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getValueState("values", "rows BINARY")
        self.clean: set = set()   # buckets that this task has cleared of what ran out

    def _alive(self, watermark: int) -> pa.Table:
        """What is held beyond the watermark."""
        state = self.values.get()
        held = unpacked(state[0]) if state else HELD.empty_table()
        return held.filter(pc.greater(held["until"], watermark))

    def _keep(self, key, held: pa.Table) -> None:
        self.clean.add(key)
        if held.num_rows:
            self.values.update((packed(held),))
            self.handle.registerTimer(pc.min(held["until"]).as_py())
        else:
            self.values.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # All rows of the micro-batch are put in order together.
        found = pa.concat_tables(pa.table({c: pa.array(
            pdf[c], pa.int64() if c == "at" else pa.string()) for c in [*CLAIM, "at"]}) for pdf in rows)
        held, out = collide(self._alive(timerValues.getCurrentWatermarkInMs()), found, self.keep_ms)
        self._keep(key, held)
        if len(out):
            yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Several timers of a bucket may have run out at once.
        if key not in self.clean:
            self._keep(key, self._alive(timerValues.getCurrentWatermarkInMs()))
        return iter(())

    def close(self) -> None:
        pass


# Python workers get this module's functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLLISION = ("subject STRING, attribute STRING, value STRING, at TIMESTAMP, "
             "others ARRAY<STRING>")
STORE = "spark.sql.streaming.stateStore.providerClass"
BUCKETS = 1024   # hash buckets of claims; fixed for the life of a checkpoint


def collision_stream(claims: DataFrame, ts: str, delay: str = "1 hour",
                     keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """(subject, attribute, value, at, others): each value that meets other values of its claim.

    A value is held until `keep_ms` after its last sighting, and reported again if it comes
    back later; `others` are the values held at its time. Rows later than the watermark are
    dropped. Claims lacking a part are left out. Start it with `run_once(..., keyed=True)`.
    """
    rows = claims.withWatermark(ts, delay).where(
        F.col("subject").isNotNull() & F.col("attribute").isNotNull() & F.col("value").isNotNull()
        & F.col(ts).isNotNull()).select(
        "subject", "attribute", "value", ts, F.unix_millis(ts).alias("at"),
        F.pmod(F.xxhash64("subject", "attribute"), F.lit(BUCKETS)).alias("bucket"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        ValueSet(keep_ms), COLLISION, "append", "EventTime")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
             keyed: bool = False) -> None:
    """Process everything that is there now into a Parquet folder, then stop.

    `keyed` state of several columns needs the RocksDB store; the session's own setting is put
    back when the query has ended.
    """
    conf = stream.sparkSession.conf
    before = conf.get(STORE, None)
    if keyed:
        conf.set(STORE, DEFAULTS[STORE])
    try:
        query = (stream.writeStream.format("parquet").outputMode(mode)
                 .option("path", path).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        if keyed:
            conf.unset(STORE) if before is None else conf.set(STORE, before)

"""Streaming queries, run to completion over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusgate.plans.base import query, table
from corpusgate.plans.claim import _CLAIMS, item_claims
from corpusgate.session import make_folder, scratch_path
from corpusgate.streaming import streams as X
from corpusgate.streaming.merge_table import MergeTable

_EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def table_stream(spark, d, name, schema):
    """A driver table as a stream of its files, whether it is one file or a folder of them.

    A file source takes a single file by a pattern only, and a name filter on the parent folder
    does not look into a table that is a folder.
    """
    return X.intake_stream(spark, f"{d}/{name}.parque[t]", schema)


def event_stream(spark, d):
    """Events as a stream with a session timestamp."""
    raw = table_stream(spark, d, "events", _EVENTS)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def finished(spark, stream, name, mode="append"):
    """Result of a stream that has processed all there is."""
    path = scratch_path(spark, name)
    X.run_once(stream, path, path + "-checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(path)


@query("intake_stream", "SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def intake_stream(spark, d):
    docs = table_stream(spark, d, "documents", table(spark, d, "documents").schema)
    return finished(spark, docs.select("doc_id", F.length("text").cast("bigint").alias("n")), "intake")


@query("dedupe_stream", "SELECT md5(text) AS digest FROM documents GROUP BY md5(text)")
def dedupe_stream(spark, d):
    docs = table_stream(spark, d, "documents", table(spark, d, "documents").schema).select(
        "text", F.timestamp_seconds(F.lit(1700000000)).alias("ts"))
    return finished(spark, X.dedupe_stream(docs, "ts").select(F.md5("text").alias("digest")), "dedupe")


_GATE = """
SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*)::BIGINT AS n
FROM events GROUP BY ALL"""


@query("hourly_gate_counts", _GATE, bench=True)
def hourly_gate_counts(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = X.gate_counts_by_window(events, "ts", ["event_type"])
    return counted.select(F.unix_micros("start").alias("start_us"), "event_type", "n")


@query("gate_stream", """
WITH last AS (SELECT time_bucket(INTERVAL 1 HOUR, max(ts) - INTERVAL 1 HOUR) AS m FROM events)
SELECT epoch_us(b) AS start_us, rule, count(*)::BIGINT AS n FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS b, unnest(list_filter(['no cloze',
    CASE WHEN event_type = 'error' THEN 'empty Extra' END], lambda r: r IS NOT NULL)) AS rule FROM events)
WHERE b < (SELECT m FROM last) GROUP BY ALL""")
def gate_stream(spark, d):
    # Windows that the final watermark has not passed are still open and not emitted.
    notes = event_stream(spark, d).select("ts", F.col("event_type").alias("text"), F.when(
        F.col("event_type") == "error", "").otherwise("x").alias("extra"))
    counted = X.gate_stream(notes, "ts", delay="1 hour")
    done = finished(spark, counted.select(F.unix_micros("start").alias("start_us"), "rule", "n"), "gates")
    return done


@query("session_stream", """
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 180 MINUTE THEN 0 ELSE 1 END
    AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e),
s AS (SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 10800000000 AS end_us,
       count(*)::BIGINT AS n FROM g GROUP BY user_id, run)
SELECT user_id, start_us, end_us, n FROM s
WHERE end_us <= (SELECT (epoch_us(max(ts)) // 1000) * 1000 - 3600000000 FROM events)""")
def session_stream(spark, d):
    found = X.activity_sessions(event_stream(spark, d), "ts", ["user_id"], delay="1 hour")
    shown = found.select("user_id", F.unix_micros("start").alias("start_us"),
                         F.unix_micros("end").alias("end_us"), "n")
    return finished(spark, shown, "sessions")


KEEP_DAYS = 200


@query("collision_stream", f"""WITH {_CLAIMS.replace(' FROM lineitem', ', l_shipdate AS day FROM lineitem')},
c AS (SELECT DISTINCT subject, attribute, value, day::DATE AS day FROM claims),
alive AS (SELECT c.*, p.value AS other, p.value = c.value AS same FROM c LEFT JOIN c p
  ON p.subject = c.subject AND p.attribute = c.attribute AND p.day + {KEEP_DAYS} > c.day
  AND (p.day < c.day OR (p.day = c.day AND p.value < c.value)))
SELECT subject, attribute, value, epoch_ms(day::TIMESTAMP) AS at_ms,
  string_agg(DISTINCT other, ',' ORDER BY other) AS others
FROM alive GROUP BY ALL HAVING count(*) FILTER (WHERE same) = 0 AND count(other) > 0""")
def collision_stream(spark, d):
    """Claims by ship date, in files of three years; the stream stops after each and restarts."""
    path = scratch_path(spark, "claims")
    saved = item_claims(spark, d, F.to_timestamp("l_shipdate").alias("ts")).select(
        "subject", "attribute", "value", "ts", F.floor(F.year("ts") / 3).alias("_era"))
    kind = "subject STRING, attribute STRING, value STRING, ts TIMESTAMP"
    make_folder(spark, f"{path}/in")
    stream = X.collision_stream(X.intake_stream(spark, f"{path}/in", kind), "ts", "1 day",
                                KEEP_DAYS * 86_400_000)
    for era in sorted(r[0] for r in saved.select("_era").distinct().collect()):
        saved.where(F.col("_era") == era).drop("_era").write.mode("append").parquet(f"{path}/in")
        X.run_once(stream, f"{path}/out", f"{path}/checkpoint", keyed=True)
    found = spark.read.schema(stream.schema).parquet(f"{path}/out")
    return found.select("subject", "attribute", "value", F.unix_millis("at").alias("at_ms"),
                        F.array_join("others", ",").alias("others"))


@query("registry_stream", """
SELECT user_id AS name, event_type AS status FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) = 1""")
def registry_stream(spark, d):
    """Latest state per user from the event log, upserted into a table of base and deltas."""
    path = scratch_path(spark, "registry")
    events = table(spark, d, "events").select(
        F.col("user_id").alias("name"), "ts", F.col("event_type").alias("status"))
    registry = MergeTable(spark, f"{path}/registry", events.schema, buckets=8, every=4)
    # Six files whose order has nothing to do with time, one per micro-batch; the stream stops
    # after two of them and is started again.
    late = F.pmod(F.xxhash64("ts", "name"), F.lit(3)) == 0
    for files, part in ((2, late), (4, ~late)):
        events.where(part).repartition(files, F.xxhash64("name", "ts")).write.mode("append").parquet(
            f"{path}/events")
        stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
                  .parquet(f"{path}/events"))
        stream.writeStream.foreachBatch(registry.upsert).option(
            "checkpointLocation", f"{path}/checkpoint").trigger(
            availableNow=True).start().awaitTermination()
    return registry.read().select("name", "status")

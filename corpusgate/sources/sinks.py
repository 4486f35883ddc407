"""Sinks and the readers that take their output back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusgate import schemas as D
from corpusgate.functions.base import text


def write_text_export(notes: DataFrame, path: str, separator: str = "|") -> None:
    """Front and back of each note on one line, ordered by note number.

    The sort is a range partitioning: every task writes one consecutive piece.
    """
    line = F.concat_ws(separator, text("text"), text("extra"))
    notes.orderBy("nid").select(F.regexp_replace(line, r"[\r\n]+", " ").alias("value")
                                ).write.mode("overwrite").text(path)


def write_claims(claims: DataFrame, path: str) -> None:
    claims.drop("span").write.mode("overwrite").parquet(path)


def write_baseline(collisions: DataFrame, path: str) -> None:
    collisions.select("subject", "attribute").write.mode("overwrite").parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(D.BASELINE).parquet(path).distinct()


def write_topics(topics: DataFrame, path: str) -> None:
    topics.write.mode("overwrite").json(path)


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(D.TOPIC).json(path)


def write_ledger(entries: DataFrame, path: str) -> None:
    entries.write.mode("overwrite").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(D.LEDGER).parquet(path)


def write_snapshot(inventory: DataFrame, path: str) -> None:
    inventory.write.mode("overwrite").partitionBy("kind").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(D.SNAPSHOT).parquet(path)


def write_page_report(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").json(path)


def write_digest(lines: DataFrame, path: str) -> None:
    """One digest line per note, in note order."""
    lines.orderBy("nid").select(F.regexp_replace("line", r"[\r\n]+", " ").alias("value")
                                ).write.mode("overwrite").text(path)


def write_changelog(entries: DataFrame, path: str) -> None:
    """Append only: what is already there is never rewritten."""
    entries.write.mode("append").parquet(path)


def read_changelog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(D.CHANGELOG).parquet(path)


def roundtrip_check(df: DataFrame, path: str) -> DataFrame:
    """Write, read back, compare: (rows_written, rows_read, pass).

    Rows and digest are observed while they are written, so the source is evaluated once and
    may even be one that gives other rows when it is evaluated again.
    """
    def seal(columns: list[str]) -> list:
        total = F.sum(F.xxhash64(*sorted(columns)).cast("decimal(38,0)"))
        return [F.count(F.lit(1)).alias("n"), total.alias("h")]

    written = Observation()
    df.observe(written, *seal(df.columns)).write.mode("overwrite").parquet(path)
    told = written.get
    again = df.sparkSession.read.schema(df.schema).parquet(path).agg(*seal(df.columns))
    rows = F.lit(told["n"]).cast("bigint")
    digest = F.lit(None if told["h"] is None else str(told["h"])).cast("decimal(38,0)")
    return again.select(rows.alias("rows_written"), F.col("n").alias("rows_read"), (
        (F.col("n") == rows) & F.col("h").eqNullSafe(digest)).alias("pass"))

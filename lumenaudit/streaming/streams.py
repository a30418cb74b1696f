"""Incremental scans with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenaudit import catalog as C
from lumenaudit.operators import findings as O
from lumenaudit.operators.secrets import secret_findings
from lumenaudit.plans.scan import content_findings


def stream_findings(texts: DataFrame, text: str = "text", time: str | None = None) -> DataFrame:
    """Findings of a stream of texts; stateless, the batch detectors as they are.

    With ``time`` that column is carried along as ``event_time``.
    """
    if time is None:
        return O.enrich(secret_findings(texts, text))
    stamped = texts.withColumn("event_time", F.col(time).cast("timestamp"))
    return O.enrich(secret_findings(stamped, text, carry=("event_time",)))


def stream_content(captures: DataFrame) -> DataFrame:
    """Findings of all content checks and secrets over a stream of captures; stateless, one capture at a time."""
    return O.enrich(content_findings(captures))


def deduplicated(stream: DataFrame, delay: str | None = None) -> DataFrame:
    """First arrival per target, URL, category and whole value.

    With ``delay`` state is kept for that long past the watermark over
    ``event_time`` and an older key may pass again; without it all keys are kept.
    """
    keyed = stream.withColumn("value_key", F.col("value"))
    key = ["target", "url", "category", "value_key"]
    if delay is None:
        return keyed.dropDuplicates(key)
    return keyed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(key)


def running_counts(stream: DataFrame) -> DataFrame:
    """``target, category, confidence, n, actionable`` as running aggregates."""
    return stream.groupBy("target", "category", "confidence").agg(
        F.count("*").alias("n"), F.count_if(~F.col("informational")).alias("actionable"))


def write_changes(counts: DataFrame, folder: str, checkpoint: str, trigger: dict) -> StreamingQuery:
    """Writes the changed rows of every micro-batch to a folder of its own.

    A repeated batch overwrites its folder, so the table stays exact after a failure.
    """
    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return (counts.writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def latest_counts(spark, folder: str) -> DataFrame:
    """The state after the last batch: the newest row per key."""
    d = spark.read.parquet(folder)
    key = ["target", "category", "confidence"]
    d = d.groupBy(*key).agg(F.max_by(F.struct("n", "actionable"), "batch").alias("s"))
    return d.select(*key, "s.n", "s.actionable")


def verdicts(counts: DataFrame) -> DataFrame:
    """Verdict per target from running counts."""
    # one pseudo finding per counted one is not needed: the score caps volume at three
    some = counts.filter(F.col("actionable") > 0).select(
        "target", "category", "confidence", F.lit(False).alias("informational"),
        F.explode(F.sequence(F.lit(1), F.least(F.col("actionable"), F.lit(C.SCORE_VOLUME_CAP)))).alias("_k"))
    return O.overall_risk(some, counts)

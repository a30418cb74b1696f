"""Readers and row filters for captured responses, word lists and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumenaudit import catalog as C
from lumenaudit.functions import text as X
from lumenaudit.schemas import RESPONSE
from lumenaudit.session import written


def parse_headers(raw: Column) -> Column:
    """``Name: value`` lines as ``array<struct<name, value>>``; repeated names stay apart."""
    lines = F.filter(F.split(raw, "\r?\n"), lambda l: l.contains(":"))
    return F.transform(lines, lambda l: F.struct(
        X.strip(X.before_first(l, ":")).alias("name"), X.strip(X.after_first(l, ":")).alias("value")))


def conform(df: DataFrame) -> DataFrame:
    """Fills what a capture table lacks and casts it to the response schema."""
    d = df
    if "headers" not in d.columns and "raw_headers" in d.columns:
        d = d.withColumn("headers", parse_headers(F.col("raw_headers")))
    if "body_bytes" not in d.columns and "body" in d.columns:
        d = d.withColumn("body_bytes", F.octet_length("body"))
    defaults = {"probe": F.lit("page"), "method": F.lit("GET"), "redirected": F.lit(False)}
    if "url" in d.columns:
        defaults["final_url"] = F.col("url")
    out = []
    for f in RESPONSE.fields:
        c = F.col(f.name) if f.name in d.columns else defaults.get(f.name, F.lit(None))
        if f.name == "content_type":
            c = F.lower(c)
        if f.name == "headers":
            c = F.coalesce(c.cast(f.dataType), F.array().cast(f.dataType))
        out.append(c.cast(f.dataType).alias(f.name))
    return d.select(*out)


def read_captures(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured responses from a folder; an explicit schema, so nothing is inferred."""
    return conform(spark.read.schema(RESPONSE).format(fmt).load(path))


#: Name of the column that holds a line which is no capture.
CORRUPT = "_corrupt_record"


def read_landed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Captures from JSON lines as crawlers land them, and a quarantine of the lines that are none.

    Fields may be missing (they get their defaults) or unknown (they are left
    out), so old and new crawlers can land in one folder.  A line that does not
    parse, has a field of another type, or names neither target nor URL goes to
    the quarantine with its ``reason``; no line is lost.  The lines are parsed
    once, into a table of the shared folder that both results read.
    """
    raw = spark.read.schema(StructType([*RESPONSE.fields, StructField(CORRUPT, StringType())])).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    raw = written(raw, "landed")  # parsed with all fields: a scan of some would not notice what is wrong in the others
    unnamed = F.col("target").isNull() | F.col("url").isNull()
    good = raw.filter(F.col(CORRUPT).isNull() & ~unnamed)
    filled = {"probe": F.lit("page"), "method": F.lit("GET"), "redirected": F.lit(False), "final_url": F.col("url"),
              "body_bytes": F.octet_length("body").cast("long")}
    good = good.withColumns({c: F.coalesce(F.col(c), v) for c, v in filled.items()}).drop(CORRUPT)
    plain = [f.name for f in RESPONSE.fields]
    bad = raw.filter(F.col(CORRUPT).isNotNull() | unnamed).select(
        F.when(F.col(CORRUPT).isNotNull(), "unreadable").otherwise("no target or url").alias("reason"),
        F.coalesce(CORRUPT, F.to_json(F.struct(*plain))).alias("line"))
    return conform(good), bad


def stream_captures(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """The same from a landing folder as a stream."""
    return conform(spark.readStream.schema(RESPONSE).format(fmt).options(**options).load(path))


def is_eligible(max_bytes: int | None = None) -> Column:
    text = (F.col("status_code") == 200) & X.contains_any(F.lower(F.col("content_type")), C.TEXT_TYPES)
    return text if max_bytes is None else text & (F.col("body_bytes") <= max_bytes)


def eligible(responses: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Answers that count as text: status 200, known type, of any size unless ``max_bytes`` is given.

    The status is a plain column test and reaches the file scan.
    """
    return responses.filter(is_eligible(max_bytes))


def scan_window(df: DataFrame, column: str = "body", chars: int = C.SCAN_WINDOW_CHARS) -> DataFrame:
    """Keeps only the first characters of a text; nothing applies it unless asked to."""
    return df.withColumn(column, F.left(column, F.lit(chars)))


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """A word list: blank and ``#`` lines are skipped.  Column ``word``."""
    d = spark.read.text(path).select(X.strip(F.col("value")).alias("word"))
    return d.filter((F.col("word") != "") & ~F.col("word").startswith("#"))

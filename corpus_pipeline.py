"""Training-data pipeline over the documents table: five stages, each written and read again.

A document leaves when no language is found in it, when all its lines are
boilerplate, when a near duplicate with a smaller id stays, or when it holds a
passage of the benchmark.  Recurring lines leave the texts that keep others.
What is left is segmented into pieces, sampled without replacement.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenaudit.llm import decontaminate, language, lines, minhash, pieces
from lumenaudit.llm.common import stored, table

def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in which no language is found; mixed ones stay.  A null ``lang`` becomes the predicted one."""
    model = language.fit(docs, ~language.held_out())
    found = language.identify(docs, model, carry=True).filter(F.col("lang_pred") != language.UNKNOWN)
    return found.select(*[F.coalesce("row.lang", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines, long ones from two texts on, and documents that have no others."""
    mark = "_lines_dropped"
    found = lines.line_dedup(docs, lines=mark, long_docs=2)
    found = found.filter((F.size(mark) == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return found.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: five-word shingles, similarity 0.8."""
    return minhash.one_per_group(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return found.filter("n_hit = 0").select("row.*")


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per document and sample: piece ids, scores, and the text decoded from them."""
    found = pieces.encode(docs, decoded=True)
    return found.select("doc_id", "sample", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "log_prob", "inclusion", "text")


STAGES = [
    ("language", identify_language),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("benchmark", drop_contaminated),
    ("pieces", segment),
]

#: Viterbi labels, signatures and sampled segmentations have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

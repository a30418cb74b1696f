"""Row keys, shared tables and Arrow passes used by the operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenaudit.session import shared_folder

#: Texts are handed to numpy in chunks of about this many bytes; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """One key for equal (id, text) rows, defined for nulls; 128 bits."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~"))
    return F.md5(F.concat_ws("\x1f", part(doc_id), part(text)))


def utf8(text: str = "text") -> Column:
    """Bytes of a text; null is empty."""
    return F.coalesce(F.col(text).cast("binary"), F.lit(b"").cast("binary"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes a table once into the folder all executors share and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes."""
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def release() -> None:
    """Hands memory that is no longer used back to the system: a worker outlives its tasks, and its heap would stay as large as the largest of them made it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


def map_texts(df: DataFrame, fn: Callable[[list[bytes], dict], pa.RecordBatch], schema: StructType | str, text: str = "text",
              limit: int = CHUNK_BYTES) -> DataFrame:
    """One pass over a table; ``fn`` gets the texts of a chunk and its other columns, and returns the rows to emit."""

    def run(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).to_pylist()
            for a, b in chunks(sizes, limit):
                part = batch.slice(a, b - a)
                rest = {n: part.column(i) for i, n in enumerate(part.schema.names) if n != text}
                yield fn(part.column(part.schema.get_field_index(text)).to_pylist(), rest)
            batch = part = rest = None
            release()

    return df.mapInArrow(run, schema)

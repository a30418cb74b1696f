"""Questions of blocks about names: is a name held elsewhere too?

A block sends its sorted names, a bucket being a range of names; every bucket is
sorted alone, and its answers go back to the blocks in the order of their names.
What travels are packed arrays, one row per block and bucket.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.rolling import U

STATE = -1  # bucket number of rows that keep something for the block itself
SCHEMA = "block string, bucket int, payload binary"
BUCKET_NAMES = 1 << 20


def bucket_bits(names: float) -> int:
    """Bits of the bucket number, for buckets of at most about ``BUCKET_NAMES``; 32 buckets at least."""
    return max(5, int(np.ceil(np.log2(max(names / BUCKET_NAMES, 1)))))


def entries(block: str, bits: int, names: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """One row per bucket of sorted names: block, bucket, payload (columns one after the other)."""
    bucket = (names >> U(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(names) else np.empty(0, np.int64)
    ends = np.append(cuts[1:], len(names))
    return [(block, int(bucket[a]), b"".join(c[a:z].tobytes() for c in columns)) for a, z in zip(cuts.tolist(), ends.tolist())]


def rows(rows: list[tuple]) -> pa.RecordBatch:
    block, bucket, payload = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(block, pa.string()), pa.array(bucket, pa.int32()), pa.array(payload, pa.binary())],
                                      ["block", "bucket", "payload"])


def each(table: DataFrame, fn) -> DataFrame:
    """Runs ``fn(block id, row)`` for every block; it returns rows to send."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield rows(fn(row["block"], row))

    return table.mapInArrow(run, SCHEMA)


def ask(entries: DataFrame, resolve) -> DataFrame:
    """Sorts each bucket alone and sends every block the answers to its names, in their order."""

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "payload": resolve(group["payload"].tolist())})

    answers = entries.groupBy("bucket").applyInPandas(one, SCHEMA)
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "payload"))).alias("answers"))


def runs(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which entries share all keys with another one, given a sorting order."""
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in keys:
        s = k[order]
        same &= s[1:] == s[:-1]
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def split(flags: np.ndarray, sizes: list[int]) -> list[bytes]:
    return [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])]


def shared(*widths):
    """Resolver: a bit per name, set when another entry of the bucket equals it in all its columns."""
    widths = [np.dtype(w) for w in widths]

    def resolve(payloads: list[bytes]) -> list[bytes]:
        sizes = [len(p) // sum(w.itemsize for w in widths) for p in payloads]
        keys, skip = [], 0
        for w in widths:
            keys.append(np.concatenate([np.frombuffer(p, w, n, skip * n) for p, n in zip(payloads, sizes)]))
            skip += w.itemsize
        return split(runs(np.lexsort(keys[::-1]), *keys), sizes)

    return resolve


def answered(answers, names: np.ndarray, bits: int) -> np.ndarray:
    """The answers of all buckets, in the order of the sorted names."""
    n = np.bincount((names >> U(64 - bits)).astype(np.int64), minlength=1)
    parts = [np.unpackbits(np.frombuffer(a["payload"], np.uint8), count=int(n[a["bucket"]])) for a in answers or []]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def flags_of(payload: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(payload, np.uint8), count=n).astype(bool)


def low_bits(names: np.ndarray, bits: int) -> np.ndarray:
    return ((names >> U(32 - bits)) & U(0xFFFFFFFF)).astype(np.uint32)

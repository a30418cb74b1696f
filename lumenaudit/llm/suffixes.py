"""Suffix dedup: removal of long byte strings that start anywhere else.

Blockwise suffix sorting with a difference cover.  Positions of a text whose
remainder modulo ``PERIOD`` lies in the cover are sample suffixes; for any two
positions there is one shift under ``PERIOD`` that takes both to samples, so
two equal strings of ``length`` bytes always hold a pair of samples with equal
prefixes of ``length - PERIOD + 1`` bytes.

1. Sample suffixes are sorted bucket by bucket on the name of that prefix; the
   sorted runs tell which samples have company.  The others start no repeat.
2. Samples with company are sorted on the name of their first ``length`` bytes;
   runs there are repeats, and cover most of what will be removed.
3. Windows that could still cover a byte are known by their shift from a sample
   with company.  The sample's rank joins them with the windows at that shift
   from every sample of the same run: only these can be equal to them.
4. These suffixes, and no others, are sorted bucket by bucket.

A name is a 64-bit polynomial hash: buckets are ranges of names, so the order
within the suffix array is that of names, not of bytes, which groups equal
strings just as well.  Steps 2 and 4 decide on two names of 64 and 32 bits.

Texts lie in blocks of a few MB in a table bucketed by block, written once, so
only names travel: every block sends each name once per bucket, with four bytes
in step 1, and gets back a bit per name.  No pass keeps what it sends, only answers are written.  A string that a third of all texts
share is therefore at most one entry per block.  Buckets are as many as the
number of bytes asks for; each is sorted alone.

Results in odd cases: null and empty texts have no bytes, nothing is removed;
texts shorter than ``length`` are kept; repeated rows remove each other; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.buckets import STATE, answered, ask, bucket_bits, each, entries, flags_of, low_bits, shared
from lumenaudit.llm.common import chunks, stored, utf8
from lumenaudit.llm.rolling import U, mix, powers, prefix
from lumenaudit.session import shared_folder

LENGTH = 200
PERIOD = 57
#: Every remainder modulo PERIOD is the difference of two of these, exactly one pair each (perfect difference set of order 7).
COVER = (0, 1, 3, 13, 32, 36, 43, 52)
BLOCK_BYTES = 2 << 20
FILE_BYTES = 12 << 20


def _blocks(docs: DataFrame) -> DataFrame:
    """Texts in blocks: block, doc ids, sizes, compressed bytes."""

    def pack(batches):
        part = TaskContext.get().partitionId()
        for b, batch in enumerate(batches):
            sizes = pc.binary_length(batch.column("text")).to_pylist()
            for a, z in chunks(sizes, BLOCK_BYTES):
                body = b"".join(batch.column("text").slice(a, z - a).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{part}-{b}-{a}"]), pa.array([batch.column("doc_id").slice(a, z - a).to_pylist()], pa.list_(pa.int64())),
                     pa.array([sizes[a:z]], pa.list_(pa.int64())), pa.array([zstandard.compress(body, 6)], pa.binary())],
                    ["block", "doc_ids", "sizes", "body"])

    return docs.mapInArrow(pack, "block string, doc_ids array<bigint>, sizes array<bigint>, body binary")


def _bucketed(docs: DataFrame) -> tuple[DataFrame, int]:
    """The blocks as a table bucketed by block in the shared folder, and all bytes of the texts."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(24, -(-total // FILE_BYTES))
    name = f"suffix_blocks_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    (_blocks(docs).repartition(files, "block").write.option("path", path).option("compression", "none")
     .bucketBy(files, "block").sortBy("block").saveAsTable(name))
    return spark.table(name), total


class Block:
    """A block's bytes, its texts and their sample suffixes."""

    def __init__(self, body: bytes, sizes: list[int], length: int):
        self.codes = np.frombuffer(zstandard.decompress(body), np.uint8)
        self.length, self.depth = length, length - PERIOD + 1
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        most = int(self.sizes.max(initial=0))
        pattern = (np.arange(0, most + PERIOD, PERIOD)[:, None] + np.array(COVER)).ravel()
        n = np.searchsorted(pattern, np.maximum(self.sizes - self.depth + 1, 0))
        owner = np.repeat(np.arange(len(sizes)), n)
        self.samples = pattern[np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)] + self.starts[owner]
        self.begin, self.end = self.starts[owner], self.ends[owner]  # of the samples' texts
        self.sums = prefix(self.codes)

    def names(self, at: np.ndarray, size: int, other: np.ndarray | None = None) -> np.ndarray:
        sums = self.sums if other is None else other
        return mix((sums[at + size] - sums[at]) * powers(len(sums), -1)[at])

    def covered(self, at: np.ndarray) -> np.ndarray:
        """Bytes inside the windows that start at the positions."""
        step = np.zeros(len(self.codes) + 1, np.int32)
        np.add.at(step, at, 1)
        np.add.at(step, at + self.length, -1)
        return np.cumsum(step[:-1]) > 0

    def fitting(self) -> np.ndarray:
        """Positions where a whole window stands."""
        step = np.zeros(len(self.codes) + 1, np.int32)
        full = self.sizes >= self.length
        np.add.at(step, self.starts[full], 1)
        np.add.at(step, self.ends[full] - self.length + 1, -1)
        return np.cumsum(step[:-1]) > 0


def _united(payloads: list[bytes]) -> list[bytes]:
    """Resolver: per name the union of all blocks' shift masks."""
    sizes = [len(p) // 12 for p in payloads]
    names = np.concatenate([np.frombuffer(p, np.uint32, n) for p, n in zip(payloads, sizes)])
    masks = np.concatenate([np.frombuffer(p, U, n, 4 * n) for p, n in zip(payloads, sizes)])
    order = np.argsort(names, kind="stable")
    fresh = np.flatnonzero(np.diff(names[order].astype(np.int64), prepend=-1))
    united = np.bitwise_or.reduceat(masks[order], fresh) if len(fresh) else masks
    out = np.empty_like(masks)
    out[order] = np.repeat(united, np.diff(np.append(fresh, len(order))))
    return [m.tobytes() for m in np.split(out, np.cumsum(sizes)[:-1])]


def repeated_spans(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, removed spans (start, end) and the kept bytes."""
    if length < 2 * PERIOD:
        raise ValueError(f"strings of at least {2 * PERIOD} bytes can be looked for")
    blocks, total = _bucketed(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8(text).alias("text")))
    bits = bucket_bits(total * len(COVER) / PERIOD)
    bare = blocks.select("block", "sizes", "body")

    def opened(row):
        return Block(row["body"], row["sizes"], length)

    def samples(block, row):
        b = opened(row)
        names = np.unique(b.names(b.samples, b.depth))
        return entries(block, bits, names, [low_bits(names, bits)])

    first = ask(each(bare, samples), shared(np.uint32))

    def found_company(block, row):
        b = opened(row)
        names, inverse, count = np.unique(b.names(b.samples, b.depth), return_inverse=True, return_counts=True)
        have = (answered(row["answers"], names, bits) | (count > 1))[inverse] if len(names) else np.zeros(0, bool)
        return [(block, STATE, np.packbits(have).tobytes())]

    company = stored(each(bare.join(first, "block", "left"), found_company), "suffix-company").select("block", F.col("payload").alias("company"))
    known = bare.join(company, "block")

    def paired(b, at):
        """Names of windows, 64 and 32 bits, the order of their pairs, and the first of each distinct pair."""
        one = b.names(at, length)
        two = (b.names(at, length, prefix(b.codes, other=True)) >> U(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
        order = np.lexsort((two, one))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        return one, two, order, fresh

    def asked(block, b, at):
        one, two, order, fresh = paired(b, at)
        one, two = one[order][fresh], two[order][fresh]
        return entries(block, bits, one, [one, two])

    def repeats(b, at, answers):
        """Which of the windows start anywhere else."""
        one, _, order, fresh = paired(b, at)
        if not len(at):
            return np.zeros(0, bool)
        run = np.cumsum(fresh) - 1
        out = np.empty(len(at), bool)
        out[order] = (answered(answers, one[order][fresh], bits) | (np.bincount(run) > 1))[run]
        return out

    def long_samples(b, row):
        have = flags_of(row["company"], len(b.samples))
        return b.samples[have & (b.end - b.samples >= length)]

    def step2(block, row):
        b = opened(row)
        return asked(block, b, long_samples(b, row))

    told = stored(ask(each(known, step2), shared(U, np.uint32)), "suffix-told").withColumnRenamed("answers", "told")
    known = known.join(told, "block", "left")

    def ranked(b, row):
        """Samples with company, the bounds of their texts, ordered names of their prefixes, and which name each has."""
        have = flags_of(row["company"], len(b.samples))
        at = b.samples[have]
        names, which = np.unique(b.names(at, b.depth), return_inverse=True)
        return at, b.begin[have], b.end[have], names, which

    def step3(block, row):
        b = opened(row)
        at = long_samples(b, row)
        covered = b.covered(at[repeats(b, at, row["told"])])
        bare_before = np.concatenate([[0], np.cumsum(~covered)])
        at, begin, end, names, which = ranked(b, row)
        mask = np.zeros(len(at), U)
        for shift in range(PERIOD):
            w = at - shift
            fits = np.flatnonzero((w >= begin) & (w + length <= end))
            open_ = bare_before[w[fits] + length] > bare_before[w[fits]]
            mask[fits[open_]] |= U(1 << shift)
        union = np.zeros(len(names), U)
        if len(names):
            order = np.argsort(which, kind="stable")
            union = np.bitwise_or.reduceat(mask[order], np.searchsorted(which[order], np.arange(len(names))))
        return entries(block, bits, names, [low_bits(names, bits), union])

    shifts = stored(ask(each(known, step3), _united), "suffix-shifts").withColumnRenamed("answers", "shifts")
    known = known.drop("told").join(shifts, "block", "left")

    def wanted(b, row):
        """Windows at the shifts that matter from samples with company."""
        at, begin, end, names, which = ranked(b, row)
        parts = [np.frombuffer(a["payload"], U) for a in row["shifts"] or []]
        mask = np.concatenate(parts)[which] if parts else np.zeros(len(at), U)
        marked = np.zeros(len(b.codes), bool)
        some = np.flatnonzero(mask)
        at, begin, end, mask = at[some], begin[some], end[some], mask[some]
        for shift in range(PERIOD):
            w = at - shift
            marked[w[(mask & U(1 << shift) != 0) & (w >= begin) & (w + length <= end)]] = True
        return np.flatnonzero(marked)

    def step4(block, row):
        b = opened(row)
        return asked(block, b, wanted(b, row))

    answers = ask(each(known, step4), shared(U, np.uint32))
    last = (blocks.join(company, "block").join(told, "block", "left").join(shifts, "block", "left").join(answers, "block", "left"))

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                b = opened(row)
                at, w = long_samples(b, row), wanted(b, row)
                gone = b.covered(np.concatenate([at[repeats(b, at, row["told"])], w[repeats(b, w, row["answers"])]]))
                body, spans, kept = b.codes.tobytes(), [], []
                edge = np.zeros(len(gone) + 1, bool)
                edge[1:-1] = gone[1:] != gone[:-1]
                edge[np.concatenate([b.starts, b.ends])] = True
                edge = np.flatnonzero(edge)
                runs = [(int(x), int(y)) for x, y in zip(edge[:-1], edge[1:]) if gone[x]]
                of = np.searchsorted(b.ends, [x for x, _ in runs], side="right")
                spans = [[] for _ in b.sizes]
                for d, (x, y) in zip(of.tolist(), runs):
                    spans[d].append((x - int(b.starts[d]), y - int(b.starts[d])))
                for d, (s, e) in enumerate(zip(b.starts.tolist(), b.ends.tolist())):
                    cuts = [0, *(c for span in spans[d] for c in span), e - s]
                    kept.append(b"".join(body[s + x:s + y] for x, y in zip(cuts[0::2], cuts[1::2])))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(b.sizes),
                     pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], kind), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "spans", "kept"])

    return last.mapInArrow(finish, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")

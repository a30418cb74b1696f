"""Tables of rows per key that arrive in batches and merge, kept in a folder without streaming state.

    batches/batch=N     what batch N adds, one row per key
    versions/upto=N     all batches up to N, merged

A folder counts once its success marker is there, which the writer sets last:
a batch that failed half-way is invisible, one that is repeated replaces itself,
and a version is published at once or not at all.  Batches that a version holds
are never read again, so reading costs one version and the few batches behind
it, however many there have been.  What merges must not depend on the order of
batches: minima, sums, and the like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lumenaudit.operators import endpoints
from lumenaudit.operators.findings import enrich

#: Batches behind a version before the next one is made.
EVERY = 8

KEY = ("target", "url", "category", "value")
ORDER = ("stage_ord", "detector_ord", "match_ord")


class MergedTable:
    """Rows by ``keys``; ``merge`` are aggregates that put rows of one key together and keep the columns of ``schema``."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, keys: tuple, merge: list[Column], every: int = EVERY):
        self.spark, self.folder, self.schema, self.keys, self.merge, self.every = spark, folder.rstrip("/"), schema, list(keys), merge, every

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _complete(self, kind: str, name: str) -> dict[int, str]:
        """Number and path of the folders of a kind that are complete."""
        fs, at = self._fs(f"{self.folder}/{kind}")
        if not fs.exists(at):
            return {}
        found = {}
        for status in fs.listStatus(at):
            said, _, number = status.getPath().getName().partition("=")
            path = f"{self.folder}/{kind}/{name}={number}"
            marker = self._fs(f"{path}/_SUCCESS")
            if said == name and marker[0].exists(marker[1]):
                found[int(number)] = path
        return found

    def version(self) -> int:
        """The last batch that the published version holds, -1 without one."""
        return max(self._complete("versions", "upto"), default=-1)

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.keys).agg(*self.merge).select(*self.schema.names)

    def add(self, rows: DataFrame, batch: int) -> DataFrame:
        """Merges rows within a batch, writes them, and reads them back."""
        path = f"{self.folder}/batches/batch={batch}"
        self._merged(rows).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def read(self, before: int | None = None) -> DataFrame:
        """The merged table, on demand as it was before a batch behind the last version."""
        version = self.version()
        if before is not None and before <= version:
            raise ValueError(f"batch {before} is part of the version up to {version}")
        parts = [p for n, p in self._complete("batches", "batch").items() if n > version and (before is None or n < before)]
        if version >= 0:
            parts.append(f"{self.folder}/versions/upto={version}")
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(self.spark.read.schema(self.schema).parquet(*parts))

    def compact(self, before: int) -> None:
        """Merges the batches before one into a new version, when enough have come since the last.

        Only batches that can't come again may be merged: those before the one that is being worked on.  What the new
        version replaces stays until the version after it, for those who are still reading.
        """
        version = self.version()
        batches = self._complete("batches", "batch")
        if sum(version < n < before for n in batches) < self.every:
            return
        self.read(before).write.mode("overwrite").parquet(f"{self.folder}/versions/upto={before - 1}")
        old = [p for n, p in batches.items() if n <= version] + [p for n, p in self._complete("versions", "upto").items() if n < version]
        for path in old:
            fs, at = self._fs(path)
            fs.delete(at, True)


def _struct(schema: StructType, names) -> str:
    return ", ".join(f"{schema[n].name} {schema[n].dataType.simpleString()}" for n in names)


class FindingTables:
    """First-wins findings and their counts, kept up to date batch by batch.

    The winner of a key is the least by stage, detector and position, whatever
    batch brings it; a later batch may replace it.  Counts follow by differences:
    only keys of the batch are looked up, which a broadcast of the batch finds in
    one pass over the table without a shuffle of it.
    """

    COUNTED = ("target", "category", "confidence")

    def __init__(self, spark: SparkSession, folder: str, findings: StructType, every: int = EVERY):
        self.names = findings.names
        rest = [n for n in self.names if n not in KEY and n not in ORDER]
        first = f"struct<{', '.join(f'{n}: {findings[n].dataType.simpleString()}' for n in (*ORDER, *rest))}>"
        shape = StructType.fromDDL(f"{_struct(findings, KEY)}, first {first}")
        self.first = F.struct(*ORDER, *rest).cast(first).alias("first")
        self.winners = MergedTable(spark, f"{folder}/winners", shape, KEY, [F.min("first").alias("first")], every)
        counts = StructType.fromDDL(f"{_struct(findings, self.COUNTED)}, n bigint, actionable bigint")
        self.counted = MergedTable(spark, f"{folder}/counts", counts, self.COUNTED, [F.sum("n").alias("n"), F.sum("actionable").alias("actionable")], every)

    def add(self, findings: DataFrame, batch: int) -> None:
        self.winners.compact(batch)
        self.counted.compact(batch)
        new = self.winners.add(findings.select(*KEY, self.first), batch)
        slim = lambda name: F.struct(F.col("first.stage_ord"), F.col("first.detector_ord"), F.col("first.match_ord"), F.col("first.confidence"),
                                     F.col("first.informational")).alias(name)
        whole = lambda d: F.xxhash64(*[d[k] for k in KEY])
        now = new.select(whole(new).alias("h"), *KEY, slim("now"))
        held = self.winners.read(batch)
        held = held.select(whole(held).alias("h"), *[F.col(k).alias(f"_{k}") for k in KEY], slim("before"))
        same = (F.col("h") == F.col("_h"))
        for k in KEY:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        held = held.withColumnRenamed("h", "_h").join(now.select(F.col("h").alias("_h")).distinct(), "_h", "left_semi")
        both = now.join(held, same, "left").filter(F.col("before").isNull() | (F.col("now") < F.col("before")))
        change = lambda s, n: F.struct(s["confidence"].alias("confidence"), F.lit(n).cast("bigint").alias("n"),
                                       F.when(s["informational"], 0).otherwise(n).cast("bigint").alias("actionable"))
        steps = F.array_compact(F.array(change(F.col("now"), 1), F.when(F.col("before").isNotNull(), change(F.col("before"), -1))))
        self.counted.add(both.select("target", "category", F.inline(steps)), batch)

    def findings(self) -> DataFrame:
        """The findings as ``deduplicate`` leaves them."""
        return self.winners.read().select(*[F.col(n) if n in KEY else F.col(f"first.{n}").alias(n) for n in self.names])

    def counts(self) -> DataFrame:
        """``target, category, confidence, n, actionable`` of them."""
        return self.counted.read().filter("n > 0")

    def write(self, stream: DataFrame, checkpoint: str, trigger: dict) -> StreamingQuery:
        """Adds every micro-batch of a stream of findings."""
        return _each(stream, self.add, checkpoint, trigger)


class EndpointFacts:
    """What is known of each target's endpoints, one narrow row per target, from captures in any order."""

    def __init__(self, spark: SparkSession, folder: str, captures: DataFrame, every: int = EVERY):
        shape = endpoints.endpoint_facts(captures).schema
        shape = StructType.fromDDL(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in shape.fields))
        self.table = MergedTable(spark, folder, shape, ("target",), endpoints.merged_facts(), every)

    def add(self, captures: DataFrame, batch: int) -> None:
        self.table.compact(batch)
        self.table.add(endpoints.endpoint_facts(captures), batch)

    def findings(self) -> DataFrame:
        return enrich(endpoints.facts_findings(self.table.read()))

    def write(self, captures: DataFrame, checkpoint: str, trigger: dict) -> StreamingQuery:
        return _each(captures, self.add, checkpoint, trigger)


def _each(stream: DataFrame, add, checkpoint: str, trigger: dict) -> StreamingQuery:
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()

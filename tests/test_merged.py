"""Batches in any order against one batch; failures, repeats, versions."""

import os
import random

import pytest

from lumenaudit.operators import endpoints
from lumenaudit.operators import findings as O
from lumenaudit.registry.planted import view
from lumenaudit.schemas import FINDING, FINDING_COLUMNS
from lumenaudit.sources.captures import conform
from lumenaudit.streaming import streams
from lumenaudit.streaming.merged import EndpointFacts, FindingTables, MergedTable
from pyspark.sql import functions as F

DEFAULTS = dict(target="https://t.test", source_id=None, url="https://t.test/a", category="api_keys", value="v", confidence="high", pattern="p", content_type="",
                status_code=None, evidence="", informational=False, context="", cwe_id="CWE-1", remediation="r", stage_ord=0, detector_ord=0, match_ord=0)


def findings(spark, rows):
    return spark.createDataFrame([tuple({**DEFAULTS, **r}[c] for c in FINDING_COLUMNS) for r in rows], FINDING)


def rows_of(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def some(seed, n=60):
    rng = random.Random(seed)
    return [dict(target=rng.choice(["a", "b"]), url=rng.choice(["u", "w", None]), category=rng.choice(["api_keys", "emails"]), value=rng.choice(["x", "y", "z"]),
                 confidence=rng.choice(["high", "low", "medium"]), informational=rng.random() < 0.3, stage_ord=rng.randrange(3), detector_ord=rng.randrange(5),
                 match_ord=rng.randrange(3), context=f"c{rng.randrange(9)}") for _ in range(n)]


def counts(df):
    return streams.running_counts(df)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_any_order_of_batches(spark, tmp_path, order):
    """Equal to the batch result, late replacements, repeats and versions included."""
    parts = [findings(spark, some(i)) for i in range(3)]
    expected = O.deduplicate(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    tables = FindingTables(spark, str(tmp_path), FINDING, every=1)
    for n, i in enumerate(order):
        tables.add(parts[i], n)
        tables.add(parts[i], n)  # the same batch once more
    assert rows_of(tables.findings().select(*FINDING_COLUMNS)) == rows_of(expected)
    assert rows_of(tables.counts()) == rows_of(counts(expected))
    assert rows_of(streams.verdicts(tables.counts())) == rows_of(streams.verdicts(counts(expected)))
    assert tables.winners.version() == 1


def test_cost_of_reading(spark, tmp_path):
    """However many batches have come, one version and the few behind it are read; what was replaced goes."""
    table = MergedTable(spark, str(tmp_path), spark.createDataFrame([], "k int, n bigint").schema, ("k",), [F.sum("n").alias("n")], every=3)
    for batch in range(14):
        table.compact(batch)
        table.add(spark.createDataFrame([(batch % 4, 1), (9, 1)], "k int, n bigint"), batch)
        assert sum(n > table.version() for n in table._complete("batches", "batch")) <= 3
    assert {r.k: r.n for r in table.read().collect()} == {0: 4, 1: 4, 2: 3, 3: 3, 9: 14}
    assert len(os.listdir(tmp_path / "versions")) <= 2 and len(os.listdir(tmp_path / "batches")) <= 6
    with pytest.raises(ValueError):
        table.read(before=table.version())


def test_half_written(spark, tmp_path):
    """Folders without their marker are not there; the batch comes again and replaces them."""
    table = MergedTable(spark, str(tmp_path), spark.createDataFrame([], "k int, n bigint").schema, ("k",), [F.sum("n").alias("n")], every=2)
    one = spark.createDataFrame([(1, 1)], "k int, n bigint")
    for batch in range(3):
        table.add(one, batch)
    os.remove(tmp_path / "batches" / "batch=2" / "_SUCCESS")
    assert table.read().first().n == 2
    table.add(one, 2)
    table.compact(3)
    assert table.version() == 2
    os.remove(tmp_path / "versions" / "upto=2" / "_SUCCESS")
    assert table.version() == -1 and table.read().first().n == 3


def test_empty(spark, tmp_path):
    tables = FindingTables(spark, str(tmp_path), FINDING)
    assert tables.findings().isEmpty() and tables.counts().isEmpty()
    tables.add(findings(spark, []), 0)
    assert tables.findings().isEmpty() and tables.counts().isEmpty()


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_endpoints(spark, sf, tmp_path, order):
    """Endpoint captures of one target spread over batches."""
    d = conform(view(spark, sf, "endpoint_probes"))
    expected = O.enrich(endpoints.security_txt_missing(d).unionByName(endpoints.graphql_introspection(d)))
    facts = EndpointFacts(spark, str(tmp_path), d, every=1)
    for n, i in enumerate(order):
        facts.add(d.filter(F.pmod(F.xxhash64("url"), F.lit(3)) == i), n)
    assert rows_of(facts.findings()) == rows_of(expected) and not expected.isEmpty()
    assert facts.table.read().count() == d.select("target").distinct().count()


def test_stream(spark, sf, tmp_path):
    """Micro-batches of files that land one after the other, in two runs of the query."""
    docs = view(spark, sf, "docs")
    docs.repartition(3, "url").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    tables = FindingTables(spark, str(tmp_path / "out"), FINDING, every=2)
    found = streams.stream_findings(read())
    tables.write(found, str(tmp_path / "state"), {"availableNow": True}).awaitTermination()
    docs.select(*[F.lit("again").alias(c) if c == "source_id" else c for c in docs.columns]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tables.write(streams.stream_findings(read()), str(tmp_path / "state"), {"availableNow": True}).awaitTermination()
    from lumenaudit.operators.secrets import secret_findings
    expected = O.deduplicate(O.enrich(secret_findings(docs)))
    keep = [c for c in FINDING_COLUMNS if c != "source_id"]
    assert rows_of(tables.findings().select(*keep)) == rows_of(expected.select(*keep))
    assert rows_of(tables.counts()) == rows_of(counts(expected)) and tables.winners.version() >= 1

"""Work that is spread over tasks: files of a micro-batch, row groups, splits; gated signatures."""

import re

import pytest
from pyspark.sql import functions as F

from lumenaudit import catalog as C
from lumenaudit.operators import probes
from lumenaudit.registry.queries import _arriving
from lumenaudit.session import ROW_GROUP, small_splits, written


def test_a_batch_arrives_in_a_file_per_core(spark):
    cores = spark.sparkContext.defaultParallelism
    seen = []
    stream = _arriving(spark, spark.range(300), "numbers", batches=3)
    q = stream.writeStream.foreachBatch(lambda d, n: seen.append((d.select(F.input_file_name()).distinct().count(), d.count()))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [files for files, _ in seen] == [cores] * 3 and sum(n for _, n in seen) == 300


def test_written_tables_can_be_split(spark):
    wide = spark.range(60000, numPartitions=1).select("id", F.concat_ws("", *[F.sha2(F.concat("id", F.lit(f"-{i}")), 256) for i in range(4)]).alias("text"))
    d = written(wide, "wide")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    with small_splits(spark):
        assert spark.conf.get(key) == str(ROW_GROUP)
        rows = [n for n in d.select("id").rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect() if n]
    assert spark.conf.get(key) == before and len(rows) > 1 and sum(rows) == 60000
    with pytest.raises(ValueError), small_splits(spark):
        raise ValueError
    assert spark.conf.get(key) == before


def test_gated_signatures_match_as_ungated(spark):
    texts = ["You have an ERROR in your ſQL syntax", "WARNING:  mySQLi_", "warning: none", "ORA-1234", "xora-12345x", "PG_QUERY()", "pg_query", "sqlite3.operatİonalError",
             "sqlite.OperationalError", "SQLState[HY000]", "Kdbc drivers", "odbc drivers", "Microsoft OLE DB Provider for ODBC Drivers", "ODBC SQL server driver",
             "quoted string not properly terminated ora-54321", "unıque PostgreSQL query failed", "nothing", "", "unclosed quotation mark after the character string"]
    rows = [(f"u{i}", "sqli", b, a, "p", 0, "'") for i, b in enumerate(texts) for a in (None, "", "ora-00001", "ora-1")]
    d = spark.createDataFrame(rows, "url string, check string, body string, baseline_body string, param string, param_index int, payload string").withColumns(
        {"target": F.lit("t"), "test_url": F.concat("url", F.lit("-"), F.coalesce("baseline_body", F.lit("null"))), "status_code": F.lit(500)})

    def first(text):
        found = [m.group(0) for m in (re.search(p, text) for p in C.DB_ERROR_SIGNATURES) if m]
        return found[0] if found else None

    want = {(f"{u}-{'null' if a is None else a}", first(b)) for u, _, b, a, *_ in rows if first(b) is not None and first(a or "") is None}
    got = {(r.url, re.search(r"signature: ['\"](.*)['\"]$", r.evidence, re.S).group(1)) for r in probes.database_errors(d).collect()}
    assert len(want) > 20 and {(u, e.replace(" ", "\\u2003")) for u, e in want} == {(u, e.replace(" ", "\\u2003")) for u, e in got}

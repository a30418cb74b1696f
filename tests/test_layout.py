"""Streams over tables that are one file or a folder of files."""

import pytest

from lumenaudit.registry.queries import QUERIES

_DOCS = "doc_id bigint, lang string, source string, n_chars bigint, text string"


@pytest.fixture(scope="module")
def layouts(spark, tmp_path_factory):
    """The same documents and pages as single files and as folders of several files."""
    docs = spark.createDataFrame([(i, "en", f"s{i % 2}", 4, f"text {i}") for i in range(58)], _DOCS)
    pages = spark.createDataFrame([(i, f"https://h{i % 3}.test/p{i}", f"<p>{i}</p>") for i in range(28)], "page_id bigint, url string, html string")
    top = tmp_path_factory.mktemp("layouts")
    for name, frame in (("documents", docs), ("pages", pages)):
        frame.repartition(3).write.parquet(f"{top}/many/{name}.parquet")
        frame.coalesce(1).write.parquet(f"{top}/parts/{name}.parquet")
        (top / "one").mkdir(exist_ok=True)
        (only,) = (top / "parts" / f"{name}.parquet").glob("part-*")
        (top / "one" / f"{name}.parquet").write_bytes(only.read_bytes())
    return f"{top}/one", f"{top}/many"


@pytest.mark.parametrize("name", ["stream_scan", "stream_dedup", "stream_counts", "stream_verdicts", "stream_content_scan"])
def test_streams_read_files_and_folders(spark, layouts, name):
    one, many = (sorted(map(str, QUERIES[name](spark, at).collect())) for at in layouts)
    assert one == many and one

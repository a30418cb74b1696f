"""Each stage against brute force on its own input; the registry."""

import sys

import corpus_pipeline
from lumenaudit.llm import decontaminate, language, lines, minhash
from lumenaudit.llm.common import stored

from .conftest import frame, words
from .test_decontaminate import brute as hits
from .test_lines import brute as dropped
from .test_minhash import brute as groups


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        made = stored(stage(spark, docs, sf), f"test-{name}")
        after = made.collect()
        if name == "language":
            assert {r.doc_id for r in after} == {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")}
        elif name == "lines":
            gone = dropped([(r.doc_id, r.text) for r in before], long_docs=2)
            kept = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in set(gone[r.doc_id])) for r in before}
            assert {r.doc_id: r.text for r in after} == {d: t for d, t in kept.items() if t.strip() or not gone[d]}
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "near_duplicates":
            ids = [r.doc_id for r in sorted(before, key=lambda r: r.doc_id)]
            found = groups([r.text for r in sorted(before, key=lambda r: r.doc_id)], 5, 80)
            assert sorted(r.doc_id for r in after) == [ids[i] for i, (_, c) in found.items() if i == c]
        elif name == "benchmark":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            some = {r.doc_id for r in after}
            for r in before[::9]:
                assert (r.doc_id in some) == (hits(r.text, items)[1] == 0)
        else:
            assert {r.doc_id: r.text for r in after} == {r.doc_id: r.text for r in before}
        if name != "pieces":
            assert made.columns == docs.columns
        docs, before = made, after


def test_mixed_languages_stay(spark, sf):
    """A text of three languages in equal parts is clean."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    parts = {r.lang: " ".join(r.text.split()[:60]) for r in docs.filter("length(text) > 1000").orderBy("doc_id").collect()}
    mixed = "\n".join(parts[k] for k in ("en", "de", "fr"))
    planted = spark.createDataFrame([(10 ** 9, mixed, "en", "s", len(mixed)), (10 ** 9 + 1, "12 34 -- 5", "en", "s", 10)], docs.schema.simpleString()[7:-1].replace(":", " "))
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(planted.select(docs.columns)), sf).collect()}
    assert 10 ** 9 in kept and 10 ** 9 + 1 not in kept


def test_stages_on_odd_rows(spark, odd_docs, no_docs, sf):
    for docs, n in ((odd_docs, 1), (no_docs, 0)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, sf)
            assert len(made.collect()) >= n, name
            if name != "pieces":
                assert made.columns == docs.columns


def test_registry():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names) and "corpus_pipeline" in sys.modules


def test_parameters():
    assert (lines.MIN_DOCS, decontaminate.WINDOW, minhash.bands_for(0.8)) == (3, 10, 29)
    assert frame and words

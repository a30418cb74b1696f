"""Held-out accuracy, mixed texts, and labels against plain Viterbi."""

import zlib

import numpy as np
import pytest

from lumenaudit.llm import language as L
from lumenaudit.llm.queries import QUERIES

from .conftest import frame


def plain(scores, penalty):
    """Best labels by trying every predecessor."""
    n, k = scores.shape
    best, back = scores[0].copy(), []
    for t in range(1, n):
        step = best[:, None] - penalty * (1 - np.eye(k))
        back.append(step.argmax(0))
        best = step.max(0) + scores[t]
    out = [int(best.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1], best.max()


def value(scores, labels, penalty):
    return sum(scores[i, x] for i, x in enumerate(labels)) - penalty * sum(a != b for a, b in zip(labels, labels[1:]))


def test_viterbi():
    rng = np.random.default_rng(1)
    sizes = [0, 1, 5, 3, 40, 7, 0]
    first = np.concatenate([[0], np.cumsum(sizes)])
    scores = rng.normal(size=(first[-1], 3)) * 4
    labels = L.viterbi(scores, first, 5.0)
    for a, b in zip(first, first[1:]):
        if a < b:
            best, top = plain(scores[a:b], 5.0)
            assert abs(value(scores[a:b], labels[a:b].tolist(), 5.0) - top) < 1e-9
    assert list(L.viterbi(np.zeros((0, 3)), np.array([0, 0]))) == []


@pytest.fixture(scope="module")
def model(spark, sf):
    return L.fit(spark.read.parquet(f"{sf}/documents.parquet"), ~L.held_out())


def test_accuracy(spark, sf):
    docs = {d.doc_id: d for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op9_language"](spark, sf).collect()
    assert {r.doc_id for r in rows} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.95 * len(out)


def test_mixed_texts(spark, sf, model):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("lang in ('en', 'fr') and length(text) > 400").collect()
    en, fr = (next(d.text for d in docs if d.lang == x)[:300] for x in ("en", "fr"))
    found = {r.doc_id: r for r in L.identify(frame(spark, [en + " " + fr + " " + en, en, "123 !!", None, ""]), model).collect()}
    assert found[0].lang_pred == "en" and {s.lang for s in found[0].spans} >= {"en", "fr"} and found[0].score < 0.9
    assert [found[i].lang_pred for i in (1, 2, 3, 4)] == ["en", "und", "und", "und"] and found[1].score > 0.9 and found[2].spans == []


def test_scripts_narrow(spark):
    rows = [(i, "привет мир как дела " * 3, "ru") for i in range(5)] + [(10 + i, "hello world how are you " * 3, "en") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = L.fit(docs, L.F.lit(True))
    found = L.identify(frame(spark, ["мир hello мир дела", "hello you", "日本語"]), model).collect()
    assert [r.lang_pred for r in sorted(found)][:2] == ["ru", "en"]
    assert model.scripts[model.languages.index("ru")][L.SCRIPT_NAMES.index("cyrillic")]


def test_odd_rows(spark, odd_docs, no_docs, model):
    assert len(L.identify(odd_docs, model, carry=True).collect()) == 15 and L.identify(no_docs, model).collect() == []
    empty = L.fit(no_docs, L.F.lit(True))
    assert {(r.lang_pred, r.score) for r in L.identify(odd_docs, empty).collect()} == {("und", 0.0)}


def test_thinned_fit(spark, sf, monkeypatch):
    monkeypatch.setattr(L, "FIT_ROWS", 15)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(docs, ~L.held_out())
    rows = L.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.9 * len(rows)

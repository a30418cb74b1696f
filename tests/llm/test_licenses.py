"""Phrases against a search of every place; notices with edits."""

import re

from lumenaudit.llm import licenses
from lumenaudit.llm.queries import QUERIES

from .conftest import frame, words


def tokens(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def places(text):
    ws = tokens(text)
    out = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i:i + len(p)] == p]
    return len(ws), sorted(out)


def phrases(row):
    return row.n_words, sorted((s.first_word, s.label) for s in row.spans if s.phrase)


def test_phrases(spark):
    texts = ["All rights reserved. ALL-RIGHTS\nreserved all rights", "cc by cc by, CC-BY; ccby cc bye", "General Public\tLicense general public general public license",
             "all rights reserved all rights reserved", "allé rights reserved", None, ""] + [words(50, 3) + " Cc By " + words(9, 4)]
    found = {r.doc_id: r for r in licenses.license_scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert phrases(found[i]) == places(t)


def test_notices(spark):
    label, notice = licenses.NOTICES[0]
    said = notice.split()
    edited = " ".join(said[:6] + ["really"] + said[6:12] + said[13:])
    torn = " ".join(said[:len(said) // 2])
    texts = [words(40, 1) + " " + notice + " " + words(40, 2), "x " + edited + " y", torn, " ".join(reversed(said))]
    found = {r.doc_id: {s.label for s in r.spans if not s.phrase} for r in licenses.license_scan(frame(spark, texts)).collect()}
    assert found == {0: {label}, 1: {label}, 2: set(), 3: set()}


def test_odd_rows(odd_docs, odd_texts, no_docs):
    found = licenses.license_scan(odd_docs).collect()
    assert sorted(r.n_words for r in found) == sorted([len(tokens(t)) for t in odd_texts] + [3, 1])
    assert licenses.license_scan(no_docs).collect() == []


def test_query(spark, sf):
    for r, d in [(r, d) for r in QUERIES["op2_licenses"](spark, sf).collect() for d in [r.doc_id]]:
        assert 0 <= r.score <= 1
    found = {r.doc_id: r for r in QUERIES["op2_licenses"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        n, at = places(d.text)
        r = found[d.doc_id]
        starts = [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(","))


def test_words_must_stand_in_order(spark):
    """Half the pairs in order and the other words in any order are no notice; most words in order, with edits spread over them, are."""
    label, notice = licenses.NOTICES[0]
    said = notice.split()
    half = len(said) // 2
    shuffled = " ".join(said[:half] + said[:half - 1:-1])
    edits = " ".join(w if i not in (4, 9, 14) else "other" for i, w in enumerate(said))
    twice = f"{notice} {words(30, 5)} {notice}"
    found = {r.doc_id: [(s.label, s.first_word, s.end_word) for s in r.spans if not s.phrase]
             for r in licenses.license_scan(frame(spark, [shuffled, words(7, 6) + " " + edits, twice])).collect()}
    n = len(said)
    assert found == {0: [], 1: [(label, 7, 7 + n)], 2: [(label, 0, n), (label, n + 30, 2 * n + 30)]}


def test_common_subsequence():
    assert licenses.in_order(list("xaybzcw"), list("abc")) == (3, 1, 6)
    assert licenses.in_order(list("cba"), list("abc")) == (1, 0, 1)
    assert licenses.in_order([], list("abc")) == (0, 0, 0)


def test_many_hits_in_one_long_text(spark):
    """Hits take their own words along only, so a long text of nothing but phrases is linear."""
    r = licenses.license_scan(frame(spark, ["cc by " * 200_000])).first()
    assert r.n_words == 400_000 and len(r.spans) == 200_000 and r.spans[-1].first_word == 399_998

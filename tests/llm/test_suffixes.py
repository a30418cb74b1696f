"""Removed spans against a search of every window."""

import hashlib
import random
from collections import Counter

import pytest

from lumenaudit.llm import suffixes
from lumenaudit.llm.queries import QUERIES

from .conftest import frame


def brute(blobs, length=200):
    seen = Counter(b[i:i + length] for b in blobs for i in range(len(b) - length + 1))
    out = []
    for b in blobs:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\x01" * length
        spans, at = [], 0
        while (at := gone.find(1, at)) >= 0:
            end = gone.find(0, at)
            end = len(b) if end < 0 else end
            spans.append((at, end))
            at = end
        out.append((len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def rows(found):
    return {r.doc_id: (r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in found.collect()}


def test_cover_is_complete():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


@pytest.mark.parametrize("block", [3000, 1 << 21])
def test_planted_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passages = [noise(n) for n in (199, 200, 201, 230, 256, 257, 331, 900)]
    texts = [noise(rng.randrange(900)) + rng.choice(passages) + noise(rng.randrange(700)) + rng.choice(passages[:4]) for _ in range(60)]
    texts += [passages[-1][7:800], "x" * 201, "y" * 200, "z" * 199, texts[0], texts[0], "é" * 150 + passages[3] + "ü"]
    found = rows(suffixes.repeated_spans(frame(spark, texts).repartition(3)))
    expected = brute([t.encode() for t in texts])
    assert [found[i] for i in range(len(texts))] == expected
    assert any(s for _, s, _ in expected)


def test_odd_rows(spark, odd_docs, odd_texts):
    blobs = [(t or "").encode() for t in odd_texts] + [b"no id here", b"one"]
    found = suffixes.repeated_spans(odd_docs).collect()
    got = sorted((r.n_bytes, hashlib.md5(r.kept).hexdigest()) for r in found)
    assert got == sorted((n, hashlib.md5(k).hexdigest()) for n, _, k in brute(blobs))


def test_no_rows(no_docs):
    assert suffixes.repeated_spans(no_docs).collect() == []


def test_query(spark, sf):
    found = {r.doc_id: r for r in QUERIES["op1_suffixes"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    for r, (n, spans, kept) in zip(docs, brute([(r.text or "").encode() for r in docs])):
        assert tuple(found[r.doc_id]) == (r.doc_id, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())

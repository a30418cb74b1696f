"""Ids against the tokenizer library, bytes against the texts."""

import hashlib
import random

import pytest
import tiktoken

from lumenaudit.llm import byte_bpe as B
from lumenaudit.llm.queries import QUERIES

from .conftest import frame


@pytest.fixture(scope="module")
def codec():
    return B.Codec().load()


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=B.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


PARTS = ["'", "l", "ll", "re", " ", "  ", "\n", "\t", "\x1c", "\x85", " ", "é", "日本", "1", "22", "²", "aaaa", "!", "?!", "😀", "Ab", "<|endoftext|>"]


def odd(rng, most=60):
    return "".join(rng.choice(PARTS) for _ in range(rng.randint(0, most)))


@pytest.mark.parametrize("window", [8, 64, B.WINDOW])
def test_ids(codec, library, monkeypatch, window):
    monkeypatch.setattr(B, "WINDOW", window)
    rng = random.Random(window)
    for _ in range(500):
        text = odd(rng)
        assert codec.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("few", [1, 3, 10_000])
def test_at_once_and_one_by_one(codec, library, monkeypatch, few):
    monkeypatch.setattr(B, "FEW", few)
    codec.forget()
    rng = random.Random(few)
    texts = [odd(rng) for _ in range(300)] + [c * n for c in "a =é" for n in (2, 3, 7, 8, 33, 500)] + ["abab" * 99, "aab" * 99]
    ids, counts = codec.encode_all(texts)
    spelled, sizes = codec.decode_all(ids, counts)
    assert counts.tolist() == [len(library.encode_ordinary(t)) for t in texts]
    assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)]
    assert spelled.tobytes() == "".join(texts).encode() and sizes.tolist() == [len(t.encode()) for t in texts]
    codec.forget()


def naive(piece, ranks):
    """The lowest rank first, then the leftmost."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("few", [1, 10_000])
def test_any_vocabulary(monkeypatch, few):
    """Also one that ranks tokens before their parts."""
    monkeypatch.setattr(B, "FEW", few)
    rng = random.Random(5)
    for _ in range(60):
        words = list({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))).encode() for _ in range(30)})
        rng.shuffle(words)
        tokens = words + [bytes([b]) for b in range(256)]
        codec = B.Codec("", r"\S+|\s+", {t: r for r, t in enumerate(tokens)}).load()
        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) for _ in range(30)]
        ids, _ = codec.encode_all(texts)
        assert ids.tolist() == [i for t in texts for i in naive(t.encode(), codec.ranks)]


def test_queue():
    queue = B.RankQueue(300_000)
    rng = random.Random(2)
    pushed = [(rng.randrange(300_000), i) for i in range(2000)]
    for rank, place in pushed:
        queue.push(rank, place)
    got = []
    while (low := queue.pop()) is not None:
        got += [(low[0], p) for p in low[1]]
    assert got == sorted(pushed)


def test_forgetting(codec, library, monkeypatch):
    monkeypatch.setattr(B, "MOST", 3)
    for text in ("one two three four", "five six seven", "one two eight"):
        assert codec.encode(text) == library.encode_ordinary(text)
    codec.forget()


def test_documents(spark, odd_texts, odd_docs, no_docs, library):
    texts = [*odd_texts, "x" * 300_000, "日本語" * 20_000, "".join(random.Random(1).choice("abcdefgh") for _ in range(100_000))]
    found = {r.doc_id: r for r in B.encode(frame(spark, texts), decoded=True).collect()}
    assert {i: list(r.ids) for i, r in found.items()} == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert {i: bytes(r.decoded) for i, r in found.items()} == {i: (t or "").encode() for i, t in enumerate(texts)}
    again = {r.doc_id: bytes(r.decoded) for r in B.decode(B.encode(frame(spark, texts))).collect()}
    assert again == {i: (t or "").encode() for i, t in enumerate(texts)}
    rows = B.encode(odd_docs).collect()
    assert len(rows) == 15 and [list(r.ids) for r in rows if r.doc_id == 3] == [library.encode_ordinary("one")] * 2
    assert B.encode(no_docs).collect() == [] and B.decode(B.encode(no_docs)).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [(r.doc_id, bytes(r.decoded)) for r in B.decode(nothing).orderBy("doc_id").collect()] == [(1, b""), (2, b"")]


def test_query(spark, sf, library):
    found = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode_ordinary(d.text or "")
        assert tuple(found.pop(d.doc_id)) == (d.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(d.text or ""))
    assert not found

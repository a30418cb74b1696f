"""Components against all pairs of full sets."""

import random
import re

import numpy as np

from lumenaudit.llm import minhash as M
from lumenaudit.llm.graph import _stars, components

from .conftest import frame, words


def shingles(text, k):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)) if len(ws) >= k else frozenset([tuple(ws)] if ws else [])


def brute(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def edited(text, n, rng):
    ws = text.split()
    for _ in range(n):
        ws[rng.randrange(len(ws))] = f"e{rng.randrange(10_000)}"
    return " ".join(ws)


def test_groups(spark):
    rng = random.Random(9)
    bases = [words(220, 50 + i, 3000) for i in range(6)]
    texts = [edited(b, rng.choice([0, 1, 2, 4, 6, 9, 14]), rng) for b in bases for _ in range(25)]
    texts += [bases[0].upper(), bases[1].replace(" ", " \n\t"), "two words", "Two  Words", "one", "", None, " ", "two words", "words two"]
    rng.shuffle(texts)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(frame(spark, texts), 3, 85).collect()}
    assert found == brute(texts, 3, 85)
    kept = M.one_per_group(frame(spark, texts), 3, 85).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in found.values()}) and kept[0].n_words == "mine"


def test_chain(spark):
    """Links in a row: hubs alone don't see both ends."""
    ws = words(400, 77, 5000).split()
    texts = [" ".join(ws[20 * i:20 * i + 300]) for i in range(6)]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(frame(spark, texts), 3, 85).collect()} == brute(texts, 3, 85)


def test_pruning():
    least = M.least_matches(100, 0.85)
    assert list(least) == [20, 40, 60, 80, 100] and least[100] < 85 and all(a < b for a, b in zip(least.values(), list(least.values())[1:]))
    assert M.bands_for(0.85) == 20 and (1 - 0.85 ** M.ROWS) ** 20 <= M.MISS


def test_odd_rows(odd_docs, no_docs):
    found = M.near_duplicates(odd_docs, 3, 85).collect()
    assert len(found) == 15
    by = {}
    for r in found:
        by.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert by[0] == {(0, 0)} and by[1] == {(0, 1)} and by[3] == {(1, 3)} and by[4] == {(1, 3)} and by[None] == {(1, None)} and by[11] == {(298, 10)}
    assert M.near_duplicates(no_docs).collect() == [] and M.one_per_group(no_docs).collect() == []
    kept = M.one_per_group(odd_docs).collect()
    assert sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id == 3 for r in kept) == 1


def test_components(spark):
    rng = random.Random(4)
    edges = [(f"{a:03d}", f"{b:03d}") for a, b in ((rng.randrange(120), rng.randrange(120)) for _ in range(90))]
    edges += [("hub", f"{i:03d}x") for i in range(50)] + [(f"p{i:02d}", f"p{i + 1:02d}") for i in range(40)] + [("a", "a"), (None, "b")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert found == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "u string, v string")).collect() == []


def test_held_bits():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 300):
        a, b = (np.sort(rng.choice(1000, n, replace=False)).astype(np.uint64) for _ in range(2))
        bits = M.held_bits(a, b)
        assert len(bits) == -(-n // 64) and np.unpackbits(bits.view(np.uint8), bitorder="little")[:n].astype(bool).tolist() == [x in set(b) for x in a]
    assert len(M.held_bits(np.empty(0, np.uint64), np.empty(0, np.uint64))) == 0


def test_hot_bucket(spark, monkeypatch):
    """Many copies of one text with few to many edits, spread over tasks: some stand alone, none of their links is lost."""
    monkeypatch.setattr(M, "HOT", 16)
    rng = random.Random(4)
    base = words(150, 61, 3000)
    shared = edited(base, 5, rng)
    texts = [edited(rng.choice([base, shared]), rng.choice([0, 1, 3, 5, 6, 7, 8, 12]), rng) for _ in range(90)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(frame(spark, texts), 3, 85).collect()}
    expected = brute(texts, 3, 85)
    assert found == expected and 1 < len({c for _, c in expected.values()}) < 90


def test_rounds(spark, monkeypatch):
    """After the first hubs a round takes all that are left, unless that meets too many members or leaves too many pairs; the result is the same."""
    monkeypatch.setattr(M, "GROWTH", 1)
    rng = random.Random(4)
    base = words(150, 61, 3000)
    texts = [edited(base, rng.choice([0, 1, 3, 5, 6, 7, 8, 12]), rng) for _ in range(60)]
    expected = brute(texts, 3, 85)
    made, rounds = [], []
    monkeypatch.setattr(M, "stored", lambda df, label, write=M.stored: made.append(label) or write(df, label))
    for meets, pairs in ((M.MEETS, M.PAIRS), (0, M.PAIRS), (M.MEETS, -1)):
        monkeypatch.setattr(M, "MEETS", meets)
        monkeypatch.setattr(M, "PAIRS", pairs)
        made.clear()
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(frame(spark, texts), 3, 85).collect()}
        assert found == expected
        rounds.append(made.count("open"))
    assert rounds[0] == 3 < min(rounds[1:])


def test_stars(spark):
    edges = lambda *rows: spark.createDataFrame(rows, "u string, v string")
    assert _stars(edges(("c", "a"), ("d", "a"), ("f", "e"))) and _stars(spark.createDataFrame([], "u string, v string"))
    assert not _stars(edges(("c", "a"), ("c", "b"))) and not _stars(edges(("c", "b"), ("b", "a")))

"""Distinct segmentations, their probabilities, and exact decoding."""

from collections import Counter

import numpy as np
import pytest

from lumenaudit.llm import pieces as P
from lumenaudit.llm.queries import QUERIES
from lumenaudit.llm.rolling import U, mix

from .conftest import frame


@pytest.fixture(scope="module")
def vocabulary():
    return P.Vocabulary(P.MODEL).load()


def sampled(vocabulary, unit, n, k):
    """``n`` draws of up to ``k`` segmentations of one word."""
    lattice = P.Lattice(vocabulary, [unit])
    seeds = mix(np.arange(n).astype(U))
    drawn = [lattice.paths(np.zeros(n, np.int64), mix(seeds + U(s + 1))) for s in range(k)]
    return lattice, P.segmentations(lattice, drawn, np.arange(n + 1), seeds, k)


def every(lattice, node):
    """All paths from a node with their log-probabilities."""
    out = []
    for e in range(lattice.begin[node], lattice.begin[node] + lattice.degree[node]):
        rest = [((), 0.0)] if lattice.closes[e] else every(lattice, lattice.target[e])
        out += [((int(e), *p), lattice.log_prob[e] + q) for p, q in rest]
    return out


def test_probabilities(vocabulary):
    lattice, found = sampled(vocabulary, b" then", 6000, 3)
    exact = {p: np.exp(q) for p, q in every(lattice, 0)}
    assert abs(sum(exact.values()) - 1) < 1e-9
    first = Counter(tuple(f[0][0].tolist()) for f in found)
    for path, p in exact.items():
        assert abs(first[path] / 6000 - p) < 4 * np.sqrt(p * (1 - p) / 6000) + 1e-3
    assert all(len({tuple(p.tolist()) for p, *_ in f}) == len(f) == 3 for f in found)
    # Horvitz-Thompson: weights p / inclusion of the samples are unbiased for any sum, here the number of pieces
    truth = sum(p * len(path) for path, p in exact.items())
    lattice, found = sampled(vocabulary, b" then", 6000, 2)
    estimate = np.mean([sum(np.exp(q) / i * len(p) for p, q, _, i in f) for f in found])
    assert abs(estimate - truth) < 0.15
    assert all(f[0][2] >= f[1][2] for f in found)


def test_few_segmentations(vocabulary):
    lattice, found = sampled(vocabulary, b" a", 50, 8)
    exact = every(lattice, 0)
    assert all(len(f) == min(8, len(exact)) and all(i == 1.0 for *_, i in f) for f in found)


def test_round_trip(spark, odd_docs, odd_texts):
    texts = [t or "" for t in odd_texts] + ["  two  spaces ", "\r\n\t", "▁▁ ▁", "a" * 500, "日本" * 100, "﻿x"]
    rows = P.decode(P.encode(frame(spark, texts), k=3)).collect()
    by = {}
    for r in rows:
        assert r.text == texts[r.doc_id]
        by.setdefault(r.doc_id, []).append(tuple(r.ids))
    assert set(by) == set(range(len(texts))) and all(len(set(x)) == len(x) for x in by.values())
    assert len(by[10]) == 3 and len({r.perturbed for r in rows}) > len(texts)


def test_seeded_by_key(spark):
    text = "the same text again and again, with several words"
    a, b = (sorted(map(tuple, P.encode(frame(spark, [text] * 9).repartition(n), k=2).select("doc_id", "sample", "ids", "inclusion").collect()))
            for n in (1, 3))
    assert a == b and len({tuple(x[2]) for x in a if x[1] == 1}) > 1


def test_no_rows(no_docs):
    assert P.decode(P.encode(no_docs)).collect() == []


def test_query(spark, sf):
    rows = QUERIES["op8_pieces"](spark, sf).collect()
    from hashlib import sha256

    texts = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.text_sha256 == sha256(texts[r.doc_id].encode()).hexdigest() for r in rows)


def test_long_words(vocabulary):
    """One lattice whatever the length: pieces across any byte are sampled, and the weights are those of the whole word."""
    unit = b" " + b"then" * 125
    lattice, found = sampled(vocabulary, unit, 200, 2)
    assert lattice.first.tolist() == [0] and abs(np.exp(lattice.log_prob[:1]).item()) > 0
    across = sum(any(lattice.at[e] < 64 < lattice.target[e] for e in path) for rows in found for path, *_ in rows)
    assert across > 40
    for rows in found:
        for path, log_prob, _, inclusion in rows:
            assert vocabulary.spell(lattice.piece[path], [0, len(path)])[0].encode() == unit[1:]
            assert lattice.at[path[0]] == 0 and (lattice.at[path[1:]] == lattice.target[path[:-1]]).all() and lattice.closes[path[-1]]
            assert abs(log_prob - lattice.log_prob[path].sum()) < 1e-9 and 0 <= inclusion <= 1


def test_several_words(vocabulary):
    """Samples of a chain of words against all their combinations."""
    units = [b" then", b" a", b" it"]
    lattice = P.Lattice(vocabulary, units)
    n, k = 4000, 2
    seeds = mix(np.arange(n).astype(U))
    of = np.tile(np.arange(3), n)
    drawn = [lattice.paths(of, mix(mix(np.repeat(seeds, 3) + U(s + 1)) + np.tile(np.arange(3), n).astype(U))) for s in range(k)]
    found = P.segmentations(lattice, drawn, np.arange(n + 1) * 3, seeds, k)
    exact = {(*a, *b, *c): np.exp(p + q + r) for a, p in every(lattice, lattice.first[0]) for b, q in every(lattice, lattice.first[1])
             for c, r in every(lattice, lattice.first[2])}
    assert abs(sum(exact.values()) - 1) < 1e-9
    first = Counter(tuple(f[0][0].tolist()) for f in found)
    second = Counter(tuple(f[1][0].tolist()) for f in found)
    for path, p in exact.items():
        assert abs(first[path] / n - p) < 4 * np.sqrt(p * (1 - p) / n) + 1e-3
        after = sum(q / (1 - q) * p for other, q in exact.items() if other != path)
        assert abs(second[path] / n - after) < 4 * np.sqrt(after * (1 - after) / n) + 2e-3


def test_greatest_of_each_group():
    rng = np.random.default_rng(7)
    for n in (0, 1, 5, 400):
        group = np.sort(rng.integers(0, 60, n) * 3)
        value = rng.normal(size=n)
        value[rng.random(n) < 0.1] = -np.inf
        value[rng.random(n) < 0.2] = 0.5
        for keep in (1, 2, 4):
            got = P._greatest(value, group, keep)
            assert len(set(got.tolist())) == len(got)
            for g in set(group.tolist()):
                assert sorted(value[got[group[got] == g]]) == sorted(sorted(value[group == g], reverse=True)[:keep])

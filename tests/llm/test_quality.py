"""Counts against plain Python; bands on prose, repetition and noise."""

import random
import re
from collections import Counter

from lumenaudit.llm import quality as Q
from lumenaudit.llm.queries import QUERIES

from .conftest import frame, words


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    seen = Counter(grams)
    inside = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)


def counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def test_counts(spark, odd_texts, odd_docs, no_docs):
    texts = [t for t in odd_texts] + ["a b c a b c", "a b c b c", "a b c", "x\ny\nx\n\n \nx ", "#*$ % & | < >", "a b c d " * 9]
    found = {r.doc_id: r for r in Q.quality_rules(frame(spark, texts)).collect()}
    assert {i: counts(r) for i, r in found.items()} == {i: brute(t) for i, t in enumerate(texts)}
    assert not found[0].kept and found[0].base_failed
    assert len(Q.quality_rules(odd_docs).collect()) == 15 and Q.quality_rules(no_docs).collect() == []


def test_bands(spark):
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(100))
    prose = " ".join(rng.choice("the of and to in a is that it was for on are as with his they at be this from I have or by one had not but what "
                                "all were when we there can an your which their said if do will each about how up out them".split()) + rng.choice(["", "s", "er"])
                     for _ in range(900))
    half = prose[:8192] + "word " * 2000
    found = {r.doc_id: r for r in Q.quality_rules(frame(spark, [prose, "again and again " * 400, noise, half])).collect()}
    assert [found[i].in_band for i in range(4)] == [True, False, False, False]
    assert found[3].n_odd_chunks > 0 and found[0].kept


def test_query(spark, sf):
    found = {r.doc_id: r for r in QUERIES["op7_quality"](spark, sf).collect()}
    for d in spark.read.parquet(f"{sf}/documents.parquet").collect():
        r = found[d.doc_id]
        expected = brute(d.text)
        assert counts(r) == expected
        assert r.base_failed == (expected[0] < 50 or 100 * expected[4] > 50 * expected[0]) and not (r.base_failed and r.kept)


def test_many_words():
    assert Q.repeated_words(words(3000, 8, 100_000).encode().split()) == brute(words(3000, 8, 100_000))[4]


ALPHABETS = {16: "0123456789abcdef", 36: "abcdefghijklmnopqrstuvwxyz0123456789",
             64: "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"}
#: Length in bytes from which words of characters drawn from so many letters are told from prose.
SEPARATED = {64: 384, 36: 1024, 16: 4096}


def noise(letters, n, seed, longest=9):
    rng = random.Random(seed)
    out = ""
    while len(out) < n:
        out += "".join(rng.choice(ALPHABETS[letters]) for _ in range(rng.randint(3, longest))) + " "
    return out[:n]


def test_noise_of_each_length(spark):
    cases = [(a, n, noise(a, n, 100 * n + k, longest)) for a, least in SEPARATED.items()
             for n in (384, 512, 1000, 1024, 1500, 2048, 2599, 4096, 6000, 12000, 40000) if n >= least for k in range(5) for longest in (5, 9)]
    found = {r.doc_id: r for r in Q.quality_rules(frame(spark, [t for *_, t in cases])).collect()}
    assert [(a, n, found[i].ratio) for i, (a, n, _) in enumerate(cases) if found[i].kept or found[i].in_band] == []


def test_clean_prose_stays(spark, sf):
    """No document that passes the base rules is lost to the bands, whole or cut at any length."""
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    clean = [t for t in texts if (c := brute(t))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    cut = [t[:n] for t in clean for n in (64, 130, 200, 300, 500, 800, 1000, 1030, 1600, 2100, 3100, 4200, 9000) if len(t) >= n]
    found = Q.quality_rules(frame(spark, clean + cut)).collect()
    assert len(clean) > 50 and [(r.doc_id, r.ratio, r.n_odd_chunks) for r in found if not r.in_band] == []


def test_tail(spark):
    prose = " ".join(words(1, k, 100_000).translate(str.maketrans("0123456789", "etaoinshrd")) + " the of and to in"[: k % 17] for k in range(1500))
    head = prose[:2 * Q.CHUNK]
    found = {r.doc_id: r for r in Q.quality_rules(frame(spark, [head + prose[9000:10900], head + noise(64, 1900, 1), head + noise(64, 100, 1)])).collect()}
    assert [found[i].n_chunks for i in range(3)] == [3, 3, 3]
    assert [found[i].n_odd_chunks for i in range(2)] == [0, 1] and [found[i].in_band for i in range(3)] == [True, False, True]

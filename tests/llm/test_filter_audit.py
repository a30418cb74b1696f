"""Reports against plain loops over documents and orders; duplicates against a dictionary."""

import random
import re
from itertools import permutations

import pytest

from lumenaudit.llm import filter_audit as A

DOCS = "doc_id bigint, text string, lang string, part int, mask string, n string, head int, tail int, _size int"
LABELS = "doc_id bigint, quality int, toxic int, part string, n int"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "m", "n", 2, 3, 4) for r in rows], DOCS)


def labels_of(spark, rows):
    return spark.createDataFrame([(*r, "p", 5) for r in rows], LABELS)


def fails(text, doc_id, least):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {f for f, bad in {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
        "E": doc_id is not None and text in least and least[text] < doc_id}.items() if bad}


def with_fails(rows):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    return [(doc_id, part or "", fails(text, doc_id, least)) for doc_id, text, part in rows]


def brute(rows, labels):
    good, bad = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    known, out = with_fails(rows), {}
    for part in {p for _, p, _ in known}:
        own = [(d, f) for d, p, f in known if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                out[part, order, step] = [
                    len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own),
                    sum(d in good for d, _ in gone if d is not None), sum(d in bad for d, _ in gone if d is not None)]
        for f in "ABCDE":
            at = [k for k in out if k[0] == part and k[1][k[2] - 1] == f]
            total = sum(out[k][1] for k in at)
            for k in at:
                out[k].append(total)
    return {k: tuple(v) for k, v in out.items()}


def report(docs, labels):
    found = A.audit(docs, labels).collect()
    out = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in found}
    assert len(out) == len(found)
    return out


def texts(rng, n):
    made = []
    for _ in range(n):
        words = [rng.choice(["Word", "and", "THE", "x$", "of", f"w{rng.randrange(999)}"]) if rng.random() < 0.5 else f"v{rng.randrange(10 ** 6)}"
                 for _ in range(rng.choice([0, 3, 99, 100, 101, 150]))]
        made.append("Common head of many texts, longer than a prefix. " * rng.randrange(2) + " ".join(words))
    return made + [None, "", " ", "\n", "one", "one ", "é" * 50, "A" * 20_000, "A" * 20_001, ("A" * 20_000) + "B"]


@pytest.mark.parametrize("limit, run", [(A.LIMIT, A.RUN), (200, 100), (1, 1)])
def test_report(spark, monkeypatch, limit, run):
    monkeypatch.setattr(A, "LIMIT", limit)
    monkeypatch.setattr(A, "RUN", run)
    rng = random.Random(limit)
    pool = texts(rng, 30)
    rows = [(rng.randrange(60), rng.choice(pool), rng.choice(["en", "de", None, ""])) for _ in range(120)]
    rows += [(None, pool[0], "en"), (None, pool[0], "en"), rows[0], rows[0]] + [(99, pool[1], "en")] * 40
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 60, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (99, 1, 1), (500, 1, 1)]
    assert report(docs_of(spark, rows).repartition(5), labels_of(spark, labels)) == brute(rows, labels)


def test_empty_tables(spark):
    assert report(docs_of(spark, []), labels_of(spark, [(1, 1, 1)])) == {}
    rows = [(1, "a b", "en"), (2, "a b", None)]
    assert report(docs_of(spark, rows), labels_of(spark, [])) == brute(rows, [])


def test_many_heavy_prefixes(spark, monkeypatch):
    """Beyond ``SENT`` prefixes a salted join finds the same."""
    monkeypatch.setattr(A, "SENT", 0)
    monkeypatch.setattr(A, "LIMIT", 50)
    rng = random.Random(8)
    pool = texts(rng, 20)
    rows = [(i, rng.choice(pool), "en") for i in range(60)]
    expected = sorted((d, p, sum(1 << "ABCDE".index(x) for x in f)) for d, p, f in with_fails(rows))
    assert sorted((r.doc_id, r.part, r["mask"]) for r in A.masks(docs_of(spark, rows)).collect()) == expected


def test_prefixes(spark, monkeypatch):
    """Few bytes of different texts share a prefix, unless they are equal up to a short text's end; copies of a text don't count."""
    monkeypatch.setattr(A, "LIMIT", 300)
    head = "h" * 500
    rows = [(f"{head}{i}" * 2,) for i in range(40)] + [("copied text " * 9,)] * 50
    made = A.with_prefix(spark.createDataFrame(rows, "text string").selectExpr("cast(text as binary) as text")).collect()
    groups = {}
    for r in made:
        groups.setdefault((bytes(r["head"]), r["tail"]), set()).add(bytes(r["text"]))
    assert max(map(len, groups.values())) == 1 and len(groups) == 41


def test_trie():
    rng = random.Random(3)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(9))).encode() for _ in range(400)]
    ids = [rng.choice([None, rng.randrange(50)]) for _ in words]
    trie, least = A.Trie(), {}
    for row, (w, i) in enumerate(zip(words, ids)):
        trie.insert(w, i, row)
        if i is not None:
            least[w] = min(i, least.get(w, i))
    assert trie.duplicates(len(words)) == [i is not None and least[w] < i for w, i in zip(words, ids)]

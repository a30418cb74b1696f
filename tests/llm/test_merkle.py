"""Manifests against a plain tree, at several block sizes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lumenaudit.llm import merkle as M

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, pos string, `group` int, node string, tampered int"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    return sha("".join(map(field, (doc_id, source, lang, None if n_chars is None else n_chars + more, text))))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def touched(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0


def brute(rows):
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in groups:
        own = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, levels([leaf(r) for r in own])))
    top = levels([t[-1][0] for _, t in trees])
    for k, (own, tree) in enumerate(trees):
        for i, row in enumerate(own):
            node, proof = leaf(row, int(touched(row[0]))), []
            for nodes, at in [(n, i >> lv) for lv, n in enumerate(tree[:-1])] + [(n, k >> lv) for lv, n in enumerate(top[:-1])]:
                if at ^ 1 < len(nodes):
                    proof.append(nodes[at ^ 1])
                    node = sha(nodes[at ^ 1] + node if at & 1 else node + nodes[at ^ 1])
                else:
                    node = sha(node)
            yield row[0], tree[0][i], tree[-1][0], top[-1][0], "".join(proof), node, node == top[-1][0]


def found(docs):
    where = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    made = M.manifest(docs, {"n_chars": F.col("n_chars") + 1}, where)
    shown = [F.lower(F.hex(c)) for c in ("leaf", "subroot", "root")]
    return [tuple(r) for r in made.select("doc_id", *shown, F.lower(F.array_join(F.transform("proof", F.hex), "")),
                                          F.lower(F.hex("folded_root")), "verified").collect()]


def by_row(rows):
    return sorted(rows, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "n", 2) for r in rows], DOCS)


def documents(n, seed, langs):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", None]), rng.choice(langs), rng.choice([None, len(str(i)), i]), rng.choice([None, "", f"text {i} é", "日本" * 9]))
            for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("bits, n", [(1, 23), (2, 150), (10, 90)])
def test_trees(spark, monkeypatch, bits, n):
    monkeypatch.setattr(M, "BITS", bits)
    monkeypatch.setattr(M, "BLOCK", 1 << bits)
    rows = documents(n, n, ["en", "de", None, "", "Ü", "zz", "é"][: 3 + bits])
    # Null ids, ties of ids, and rows that stand again.
    rows += [(None, None, None, None, None), (None, "a", "en", 3, "x"), rows[0], rows[0], (rows[1][0], "other", rows[1][2], 1, "y"), (7, "a", "one leaf", None, "z")]
    assert by_row(found(frame(spark, rows))) == by_row(brute(rows))


def test_one_leaf_and_none(spark):
    for rows in ([(14, "a", "en", 5, "x")], [(21, None, None, None, None)]):
        assert found(frame(spark, rows)) == list(brute(rows))
    assert found(frame(spark, [])) == []


def test_most_rows_equal(spark, monkeypatch):
    """One row that makes up a third of the table, over many partitions."""
    monkeypatch.setattr(M, "BITS", 3)
    monkeypatch.setattr(M, "BLOCK", 8)
    rows = documents(60, 4, ["en"]) + [(5, "a", "en", 1, "copy")] * 30
    assert by_row(found(frame(spark, rows).repartition(7))) == by_row(brute(rows))


def test_versions_share_nodes():
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(13)]
    tree = M.Tree(leaves, 4)
    before = list(tree.nodes)
    for place in range(13):
        size = len(tree.nodes)
        other = hashlib.sha256(b"other").digest()
        root = tree.version(place, other)
        assert len(tree.nodes) == size + 1 + tree.height and tree.nodes[:len(before)] == before
        fresh = M.Tree(leaves[:place] + [other] + leaves[place + 1:], 4)
        assert tree.nodes[root][0] == fresh.nodes[fresh.root][0] == M.continued(other, tree.siblings(place))

"""Hit words and items against a search of every window."""

import pytest

from lumenaudit.llm import decontaminate as D

from .conftest import frame, words

ITEMS = "item_id bigint, text string, grams string"


def brute(text, items, window=10):
    ws = [w.decode() for w in D.word_list((text or "").encode())]
    hit, names = set(), set()
    for name, said in items:
        said = [w.decode() for w in D.word_list((said or "").encode())]
        n = min(window, len(said))
        for a in range(len(said) - n + 1 if n else 0):
            for i in range(len(ws) - n + 1):
                if ws[i:i + n] == said[a:a + n]:
                    hit.update(range(i, i + n))
                    names.add("" if name is None else str(name))
    return len(ws), len(hit), sorted(names)


@pytest.mark.parametrize("limit", [D.SENT_SHINGLES, 0])
def test_planted(spark, limit):
    items = [(1, words(40, 11)), (2, words(12, 12)), (3, "just three words"), (4, "solo"), (5, None), (6, "--"), (7, words(12, 12)), (None, "Two Words"),
             (10, "a a a a a a a a a a a a")]
    said = [t for _, t in items]
    texts = [words(30, 1) + " " + said[0] + " " + words(9, 2), " ".join(said[0].split()[5:15]), " ".join(said[0].split()[5:14]), said[1].upper() + "!",
             "JUST three, words", "solo so lo", "two-words", "a " * 25, words(500, 3), None, "", said[0] + " " + said[0]]
    table = spark.createDataFrame([(i, t, "g") for i, t in items], ITEMS)
    found = {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in D.decontaminate(frame(spark, texts), table, sent_limit=limit).collect()}
    assert found == {i: brute(t, items) for i, t in enumerate(texts)}
    assert found[1][1] == 10 and found[2][1] == 0


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two", "g"), (1, "one two", "g")], ITEMS)
    found = D.decontaminate(odd_docs, items, carry=True).collect()
    assert len(found) == 15 and sorted(r.n_hit for r in found)[-2:] == [0, 2] and found[0].row.n_words == "mine"
    assert D.decontaminate(no_docs, items).collect() == []
    none = spark.createDataFrame([], ITEMS)
    assert {r.n_hit for r in D.decontaminate(odd_docs, none).collect()} == {0}

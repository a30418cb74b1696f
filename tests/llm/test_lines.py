"""Line dedup against a plain dictionary of templates."""

from collections import defaultdict

from lumenaudit.llm import lines

from .conftest import frame, words as numbered


def words(n, seed):
    return numbered(n, seed).translate(str.maketrans("0123456789", "abcdefghij"))


def brute(docs, min_docs=3, long_docs=None):
    """Dropped line numbers of (id, text) rows; with ``long_docs`` long lines recur from that many texts on."""
    texts, at = defaultdict(set), defaultdict(set)
    for d, t in docs:
        for i, line in enumerate((t or "").encode().split(b"\n")):
            tokens = line.split()
            for leaf in lines.templates(line) + ([b" ".join(tokens)] if long_docs and len(tokens) >= lines.LONG_TOKENS else []):
                texts[leaf].add(t)
                at[leaf].add((d, i))
    gone = defaultdict(set)
    for leaf, found in texts.items():
        if len(found) >= (min_docs if isinstance(leaf, int) else long_docs):
            for d, i in sorted(at[leaf])[1:]:
                gone[d].add(i)
    return {d: sorted(gone[d]) for d, _ in docs}


def test_templates():
    same = lambda a, b: bool(set(lines.templates(a)) & set(lines.templates(b)))
    assert same(b"user 17 logged in", b"user 9999 logged in")
    assert same(b"GET the page now x y z w from a@b", b"GET the page now x y z w from c@d")
    assert same(b"a b c d e f g h i j k l", b"a b c d e f g h X Y k l")          # one stretch differs
    assert not same(b"a b c d e f g h i j k l", b"a b X d e f g h Y j k l")      # two do
    assert not same(b"a b c d e f g h i j k l", b"X b c d e f g h i j k l")      # a leading token does
    assert not same(b"1 2 3 4 5 6 7 8", b"9 8 7 6 5 4 3 2")
    assert lines.templates(b"too short now") == [] and lines.templates(b"") == []


def test_dropped(spark):
    footer = "Copyright notice of the %d site shown here"
    texts = [words(8, i) + "\n" + footer % i + "\n" + words(30, 100 + i) for i in range(12)]
    texts += [texts[0]] * 4 + ["same words in this line\n" * 5, None, "", "short"]
    docs = list(enumerate(texts))
    found = {r.doc_id: r for r in lines.line_dedup(frame(spark, texts)).collect()}
    expected = brute(docs)
    assert {d: r.dropped_lines for d, r in found.items()} == expected
    assert expected[0] == [] and expected[1] == [1]
    for d, t in docs:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in expected[d])
        assert found[d].text == kept and found[d].n_words == "mine"


def test_odd_rows(odd_docs, no_docs):
    found = lines.line_dedup(odd_docs, min_docs=2).collect()
    assert len(found) == 15 and set(odd_docs.columns) < set(found[0].asDict())
    assert lines.line_dedup(no_docs).collect() == []


def test_long_lines_of_two_texts(spark):
    """A long line of two otherwise different texts goes with ``long_docs``, however often one of them is copied; others need three."""
    passage = words(24, 50) + " on page 17"
    near = passage.split()
    near[8] = "changed"
    short = words(lines.LONG_TOKENS - 1, 51)
    one, two = (words(30, s) + "\n" + passage + "\n" + short + "\n" + words(30, s + 1) for s in (60, 70))
    third = words(30, 80) + "\n" + " ".join(near) + "\n" + words(12, 81)
    fourth = words(30, 90) + "\n" + passage.replace("17", "18")[:-1] + "8x\n" + words(12, 91)
    texts = [one, two, two, two, two]
    found = {r.doc_id: r for r in lines.line_dedup(frame(spark, texts), long_docs=2).collect()}
    assert [found[i].dropped_lines for i in range(5)] == [[], [1], [1], [1], [1]]
    assert passage in found[0].text and all(passage not in found[i].text and short in found[i].text for i in range(1, 5))
    assert all(r.dropped_lines == [] for r in lines.line_dedup(frame(spark, texts)).collect())
    for extra in (third, fourth):
        assert all(r.dropped_lines == [] for r in lines.line_dedup(frame(spark, [one, extra]), long_docs=2).collect())


def test_long_lines_against_brute(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = {d: set(x) for d, x in brute(docs).items()}
    texts, at = defaultdict(set), defaultdict(set)
    for d, t in docs:
        for i, line in enumerate((t or "").encode().split(b"\n")):
            if len(line.split()) >= lines.LONG_TOKENS:
                texts[b" ".join(line.split())].add(t)
                at[b" ".join(line.split())].add((d, i))
    for line, of in texts.items():
        if len(of) >= 2:
            for d, i in sorted(at[line])[1:]:
                expected[d].add(i)
    found = lines.line_dedup(spark.read.parquet(f"{sf}/documents.parquet"), long_docs=2).collect()
    assert {r.doc_id: r.dropped_lines for r in found} == {d: sorted(x) for d, x in expected.items()}
    assert expected != {d: set(x) for d, x in brute(docs).items()}


def test_clashing_names(spark):
    """Columns named like those the operator uses come back as they were; one named like the result is replaced, whatever its case."""
    line = "the same old line of many words here"
    rows = [(i, f"{line}\n{words(8, i)}", 1, 2, 3, 4) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row_id int, _row_text int, _dropped int, DROPPED_LINES int")
    found = lines.line_dedup(docs)
    assert found.columns == ["doc_id", "text", "_row_id", "_row_text", "_dropped", "dropped_lines"]
    assert sorted((r.doc_id, len(r.dropped_lines), r._row_id, r._dropped) for r in found.collect()) == [(0, 0, 1, 3), (1, 1, 1, 3), (2, 1, 1, 3), (3, 1, 1, 3)]


def test_one_pass_over_the_texts(spark):
    """A filter on the text that is left costs no second Python pass; null texts stay null, and other columns as they are."""
    line = "the same old line of many words here"
    docs = frame(spark, [f"{line}\nown é {i}" for i in range(4)] + [None, ""])
    found = lines.line_dedup(docs).filter("text IS NULL OR text RLIKE '.*'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1
    got = {r.doc_id: r.text for r in found.collect()}
    assert got == {0: f"{line}\nown é 0", 1: "own é 1", 2: "own é 2", 3: "own é 3", 4: None, 5: ""}
    assert found.columns == [*docs.columns, "dropped_lines"] and found.drop("dropped_lines").schema == docs.schema

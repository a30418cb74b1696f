"""The bound of page similarity in column expressions, and what is left to the comparison in order."""

import difflib
import random

from lumenaudit import catalog as C
from lumenaudit.functions.similarity import may_be_similar
from lumenaudit.operators import soft404
from lumenaudit.sources.captures import conform

PAGES, BASE = "target string, url string, status_code int, body string", "target string, url string, probe string, status_code int, body string"


def texts(seed, n=300):
    rnd = random.Random(seed)
    letters = "ab c<é語😀\n'$^\\."
    out = ["", "a", "ab", "😀" * 9, "." * 12, "(" * 10 + "a", "\u0000x"]
    for _ in range(n):
        t = "".join(rnd.choices(letters, k=rnd.choice((8, 11, 40, 45))))
        out += [t, t[::-1], t[:-1] + rnd.choice(letters), t + "ab"]
    return out


def test_bound_is_that_of_the_comparison(spark):
    rnd, pool = random.Random(3), texts(3)
    pairs = [(a, rnd.choice(pool)) for a in pool] + [(a, b) for a, b in zip(pool, pool[1:])]
    d = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.ok for r in d.select("a", "b", may_be_similar("a", "b").alias("ok")).collect()}
    for (a, b), ok in got.items():
        want = bool(a and b) and difflib.SequenceMatcher(None, a, b).quick_ratio() >= C.SIMILARITY_MIN
        assert ok == want, (a, b)
    assert 50 < sum(got.values()) < len(got) - 50


def test_equal_texts_are_similar_by_the_rule():
    for t in texts(5) + ["ab" * 400, "a" * 900, "x y " * 240]:
        assert difflib.SequenceMatcher(None, t, t).ratio() == 1.0


def frames(spark, pages, base):
    return conform(spark.createDataFrame(pages, PAGES)), conform(spark.createDataFrame(base, BASE))


def test_most_pairs_are_decided_without_python(spark):
    rnd = random.Random(7)
    words = [f"w{''.join(rnd.choices('abcdefgh', k=6))}" for _ in range(300)]
    catch_all = "<p>not here: " + " ".join(rnd.choices(words, k=60))[:150] + " 0123456789 " + "QRSTUVWXYZ" * 25
    pages = [("t", f"same{i}", 200, catch_all) for i in range(400)]
    pages += [("t", f"near{i}", 200, catch_all + f" {i}") for i in range(5)]
    pages += [("t", f"other{i}", 200, " ".join(rnd.choices(words, k=60))[:480]) for i in range(200)] + [("t", "none", 200, None)]
    p, b = frames(spark, pages, [("t", "b", "baseline", 200, catch_all)])
    pairs = soft404.head_pairs(soft404._signed(p), soft404.baseline_signatures(b))
    left = pairs.filter("_head <> _bhead").count()
    assert left == 5 and pairs.count() == 405  # of 606 pages
    near = {u for _, u, _, x in pages if x and difflib.SequenceMatcher(None, x, catch_all).ratio() >= C.SIMILARITY_MIN}
    assert {r.url for r in soft404.similar_matches(p, soft404.baseline_signatures(b)).collect()} == near
    assert len(near) == 405


def test_whole_bodies_tell_tails_apart(spark):
    head, tail, other = "<li>item</li>" * 100, "0123456789" * 60, "ZYXWVUTSRQ" * 60
    pages = [("t", "same", 200, head + tail), ("t", "near", 200, head + tail + "x"), ("t", "tail", 200, head + other), ("t", "empty", 200, "")]
    p, b = frames(spark, pages, [("t", "b", "baseline", 200, head + tail)])
    found = lambda chars: {r.url for r in soft404.similar_matches(p, soft404.baseline_signatures(b, chars), chars).collect()}
    assert found(C.SIMILARITY_CHARS) == {"same", "near", "tail"}
    assert found(None) == {"same", "near"}


def test_no_pages_no_baselines(spark):
    p, b = frames(spark, [("t", "u", 200, "x" * 50)], [("t", "b", "baseline", 200, "x" * 50)])
    none = soft404.baseline_signatures(b).limit(0)
    assert soft404.similar_matches(p, none).count() == 0
    assert soft404.similar_matches(p.limit(0), soft404.baseline_signatures(b)).count() == 0

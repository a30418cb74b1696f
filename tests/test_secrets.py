import re

import pytest
from pyspark.sql import functions as F

import model
from lumenaudit import catalog as C
from lumenaudit.operators import secrets
from lumenaudit.registry.planted import view

_HEX = "0123456789abcdef0123456789abcdef"
_AKIA = "AK" + "IA" + "ABCDEFGHIJKLMNOP"


def edge_texts():
    t = [
        None, "", "   \n", f'token = "{_HEX}"', f'"{_HEX}" token: "{_HEX}"token:"{_HEX}x"', _AKIA, f"x{_AKIA}y{_AKIA}",
        f"line one\r\n  {_AKIA}  \r\nline three", f"{_AKIA}\n", f"\n\n{_AKIA}", "a" * 200 + " " + _AKIA + " " + "b" * 300,
        "  lead " + _AKIA + " " * 300 + "end\n", _AKIA + " tail " + "y" * 100, _AKIA + " " * 90, _AKIA + " " * 200 + "far\n",
        "password = 'hunter22'", "paſſword = 'kelvin12'", "toKen = '" + _HEX + "'", "password\u001c=\u001fabcdef\u0085g",
        "\U0001f511 token: \"" + "\U0001f511" * 14 + "\" \U0001f511", "host 10.٣.4.5 and 10.1.1.1, 910.1.1.1 192.168.1.1x 172.16.0.1",
        "me@x.test you@y.example.com a@b.png logo@2x.png é@ü.test x_y+z@q-r.co.uk",
        "api_key = 'has\nbreak inside' and token = 'other\nbreak here' tail",
        "password" + " " * 100 + "= 'farapart'", "passwd" + "\n" * 70 + ":\n\n'faraway1'", "pwd='abcd'pwd='efgh'pwd='ijkl'",
        "DB_PASSWORD: \"ab'cd\" config = 'x.yaml' settings='a/b.ini'", "connection-string = 'Server=x;Pwd=y'",
        "PAYPAL_token\" : \"0123456789ab\"", "-----BEGIN " + "PRIVATE KEY-----\n-----BEGIN PGP " + "PRIVATE KEY-----",
        "mongodb" + "://u:p@h/db redis" + "://h", " ".join(f"u{i}@many.test" for i in range(400)),
        "\n".join(f"u{i}@lines.test  " for i in range(200)), "İ token='" + _HEX + "' apı_key='" + _HEX + "'",
        "x" * 70 + "secret_key" + "　" * 45 + "='" + _HEX + "'",
    ]
    return t


@pytest.fixture(scope="module")
def texts(spark, sf):
    real = [r.text for r in view(spark, sf, "docs").select("text").collect()]
    real += [r.text for r in view(spark, sf, "context_docs").select("text").collect()]
    return edge_texts() + real


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "url string, text string").repartition(4)


def test_matches_and_context_equal_the_model(frame, texts):
    want = {(f"u{i}", *m) for i, t in enumerate(texts) if t for m in model.matches(t)}
    got = secrets.secret_matches(frame, context=True)
    got = {(r.url, r.detector_ord, r.match_ord, r.value, r.context) for r in got.collect()}
    assert got == want


def test_offsets(frame, texts):
    rows = secrets.secret_matches(frame, context=True).filter(F.col("detector_ord") == 4).collect()
    assert rows
    for r in rows:
        assert texts[int(r.url[1:])][r.match_start:].startswith(r.value)


def test_gate_loses_nothing(frame):
    cols = ["url", "detector_ord", "match_ord", "value"]
    gated = secrets.secret_matches(frame).select(*cols)
    full = secrets.secret_matches(frame, gate=False).select(*cols)
    assert gated.exceptAll(full).isEmpty() and full.exceptAll(gated).isEmpty()


def test_validity_equals_the_model(frame):
    m = secrets.secret_matches(frame)
    ok = secrets.is_valid(F.col("category"), F.col("value"), F.col("url"))
    for r in m.withColumn("ok", ok).collect():
        assert r.ok == model.real(r.category, r.value, r.url), r


@pytest.mark.parametrize("category,value,url,want", [
    ("api_keys", "changeme", "u", False), ("api_keys", "your_key_1234", "u", False), ("api_keys", "abababab", "u", False),
    ("api_keys", "a1b2c3d4", "u", True), ("tokens", "eyJ", "u", True), ("tokens", "short", "u", False), ("passwords", "ab", "u", False),
    ("passwords", "abc", "u", True), ("passwords", "x" * 65, "u", False), ("passwords", " Password ", "u", False), ("emails", "a@b.png", "u", False),
    ("emails", "a@b.test", "https://x/LOGO.PNG", False), ("emails", "a@b.test", "u", True), ("emails", "a@example.com", "u", False),
    ("internal_ips", "10.0.0.1", "u", True), ("database", "{{url}}", "u", False), ("private_keys", "   ", "u", False), ("api_keys", None, "u", False),
    ("custom", "z", "u", True), ("api_keys", "aabbcdef", "u", True), ("financial", "0000000001", "u", False),
])
def test_validity_cases(spark, category, value, url, want):
    d = spark.createDataFrame([(category, value, url)], "c string, v string, u string")
    assert d.select(secrets.is_valid(F.col("c"), F.col("v"), F.col("u"))).first()[0] is want


def test_needles_cover_their_patterns():
    samples = {3: "sk_" + "test_" + "a" * 16, 4: _AKIA, 5: "ya29" + ".x", 6: "AI" + "za" + "b" * 35, 10: "S" + "G." + "a" * 16 + "." + "b" * 16}
    for i, s in samples.items():
        assert re.search(C.DETECTORS[i].pattern, s) and any(n in s for n in C.DETECTORS[i].needles)


def test_sanitise_keeps_long_values(spark):
    d = spark.createDataFrame([(" " + "v" * 150 + " ",), (" short ",)], "v string")
    assert [r[0] for r in d.select(secrets.sanitise(F.col("v"))).collect()] == ["v" * 150, "short"]


def test_window_and_custom_detectors(spark):
    d = spark.createDataFrame([("u", "aaaa CUSTOM-42 bbbb CUSTOM-43")], "url string, text string")
    mine = (C.Detector("custom", r"CUSTOM-(\d+)", 1, "high"),)
    assert [r.value for r in secrets.secret_matches(d, detectors=mine).collect()] == ["42", "43"]
    assert [r.value for r in secrets.secret_matches(d, detectors=mine, window=16).collect()] == ["42"]


def test_long_text_is_scanned_whole(spark):
    d = spark.createDataFrame([("u", "word " * 450_000 + _AKIA)], "url string, text string")
    assert [r.value for r in secrets.secret_findings(d).collect()] == [_AKIA]


def test_many_matches_in_one_text(spark):
    for sep in (" ", "\n"):
        text = sep.join(f"u{i}@many{i}.test and words" for i in range(3000))
        got = secrets.secret_matches(spark.createDataFrame([("u", text)], "url string, text string"), context=True)
        want = [(o, i, v, c) for o, i, v, c in model.matches(text)]
        assert sorted((r.detector_ord, r.match_ord, r.value, r.context) for r in got.collect()) == want

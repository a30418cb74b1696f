"""Table schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenaudit.functions.text import sql_text

HEADERS = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("value", T.StringType()),
]))

RESPONSE = T.StructType([
    T.StructField("target", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("final_url", T.StringType()),
    T.StructField("redirected", T.BooleanType()),
    T.StructField("method", T.StringType()),
    T.StructField("probe", T.StringType()),
    T.StructField("request_origin", T.StringType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("headers", HEADERS),
    T.StructField("body", T.StringType()),
    T.StructField("body_bytes", T.LongType()),
    T.StructField("fetched_at", T.TimestampType()),
])

TLS_OBSERVATION = "target string, host string, port int, protocol string, not_after string, verify_error string"
DNS_OBSERVATION = "domain string, host string, resolves boolean, is_canary boolean"
CT_ENTRY = "domain string, name_value string"
PORT_OBSERVATION = "host string, port int, open boolean, is_canary boolean, banner_raw string"
PROBE_RESULT = (
    "target string, url string, test_url string, param_index int, param string, original string, "
    "check string, attempt int, payload string, a int, b int, status_code int, body string, baseline_body string"
)

# (column, type, default expression)
_FINDING = (
    ("target", "string", None),
    ("source_id", "string", None),
    ("url", "string", None),
    ("category", "string", None),
    ("value", "string", None),
    ("confidence", "string", None),
    ("pattern", "string", ""),
    ("content_type", "string", ""),
    ("status_code", "int", None),
    ("evidence", "string", ""),
    ("informational", "boolean", False),
    ("context", "string", ""),
    ("cwe_id", "string", None),
    ("remediation", "string", None),
    ("stage_ord", "int", 0),
    ("detector_ord", "int", 0),
    ("match_ord", "int", 0),
)
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType()}
FINDING = T.StructType([T.StructField(n, _TYPES[t]) for n, t, _ in _FINDING])
FINDING_COLUMNS = tuple(n for n, _, _ in _FINDING)
_ROW = ("target", "source_id")          # taken from the row, not from the detection
_NONE = "cast(array() AS array<struct<" + ",".join(f"{n}:{t}" for n, t, _ in _FINDING if n not in _ROW) + ">>)"


def _constant(value, dtype: str) -> str:
    if value is None:
        return f"cast(NULL AS {dtype})"
    if dtype == "string":
        return sql_text(str(value))
    return str(value).lower()


def _filled(fields: dict, skip: tuple = ()) -> list[Column]:
    """All finding columns in order; constants as SQL text, which is cheap to build."""
    unknown = set(fields) - set(FINDING_COLUMNS)
    if unknown:
        raise ValueError(f"not finding columns: {sorted(unknown)}")
    out = []
    for name, dtype, default in _FINDING:
        if name not in skip:
            v = fields.get(name, default)
            out.append(v.alias(name) if isinstance(v, Column) else F.expr(f"{_constant(v, dtype)} AS {name}"))
    return out


def finding(df: DataFrame, carry: tuple = (), **fields) -> DataFrame:
    """Project ``df`` to the finding schema.

    ``fields`` maps finding columns to Columns or plain values; whatever is not
    given gets the schema's default, except ``target`` which is taken over from
    the input when present.  Columns named in ``carry`` are added unchanged.
    """
    if "target" not in fields and "target" in df.columns:
        fields["target"] = F.col("target")
    d = df.select(*_filled(fields), *carry)
    types = dict(d.dtypes)
    wrong = {n: F.col(n).cast(t) for n, t, _ in _FINDING if types[n] != t}
    return d.withColumns(wrong) if wrong else d


def found(**fields) -> Column:
    """One detection within a row, as a struct; arrays of these go to ``detect``."""
    return F.struct(*_filled(fields, _ROW))


def as_detection(**fields) -> Column:
    """The same with every field of its type."""
    return found(**fields).cast(T.StructType([f for f in FINDING.fields if f.name not in _ROW]))


def gathered(*detections: Column) -> Column:
    """All detections of all given arrays, which may be null, as one array."""
    arrays = [F.coalesce(a, F.expr(_NONE)) for a in detections]
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0]


def detect(df: DataFrame, *detections: Column) -> DataFrame:
    """All detections of all given arrays as findings, in one pass over the rows."""
    source = [F.col("source_id") if "source_id" in df.columns else F.lit(None).cast("string").alias("source_id")]
    d = df.select("target", *source, F.inline(gathered(*detections)))
    return d.select(*FINDING_COLUMNS)

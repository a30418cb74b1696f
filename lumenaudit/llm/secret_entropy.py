"""Secret scan with sliding-window entropy; column expressions only.

Named assignments, access keys and long hexadecimal runs are matched by
pattern.  Beyond these, every run of token characters is a candidate: a window
slides over it, the entropy of its characters follows from incremental counts
(the character that enters, the one that leaves), and the stretch of windows
above the threshold of the window's own character class is reported, unless an
allow-list pattern covers the candidate.  Runs of letters of one case are never
reported: words reach the entropy of random letters.

Positions are code points, ends exclusive.  Results in odd cases: a null or
empty text has no spans; equal rows give equal rows; other columns are ignored;
an empty table gives an empty result.  Texts are read whole and nothing is
shuffled; running positions are summed in blocks, so the work grows by the
power 1.5 of a text's matches at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    gate: str            # cheap condition without which the pattern can't match
    least: int           # length that the tail group (or the match) must have
    tail: str = ""       # pattern of the measured end of the match


# Patterns of the base kinds.
KINDS = (
    Kind("assign", r"""(?:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9+/_.=-]+""",
         r"(?i:passw|secret|token|api)", 6, r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
    Kind("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", 20),
    Kind("hex", r"[0-9a-f]{24,}", r"[0-9a-f]{24}", 24),
)
ENTROPY = "entropy"
WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
#: Bits per character a window of the class needs; about 1 % of random windows of the class lie below.  Hexadecimal digits, digits with
#: letters of one case, base64 with digits and both cases (or letters with ``BOTH_CASES`` of each); what fits no class (with separators
#: such as hyphens) needs more, and a digit in its candidate.
HEX_BITS, ONE_CASE_BITS, TOKEN_BITS, OTHER_BITS = 2.9, 3.38, 3.64, 3.85
BOTH_CASES = 5
# Allow list: whole candidates that are no secrets: digits, plain, numbered or hyphenated words, UUIDs, alphabets, rulers.  Repeated
# groups are possessive, so that a long candidate neither backtracks nor fills the stack.
_ALPHABET = "abcdefghij" + "".join(f"(?:{c}" for c in "klmnopqrstuvwxyz") + ")?" * 16
ALLOWED = (
    r"^[0-9+=/_-]+$",
    r"^(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}$",
    r"^[A-Za-z]{1,15}+(?:[/_+=-]++[A-Za-z]{0,15}+)*+$",
    r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    rf"^(?i:(?:{_ALPHABET}|0123456789abcdef(?!ghij)|0?123456789(?:0(?!123456789abcdef))?|qwertyuiop|asdfghjkl|zxcvbnm|[+/=_-])++)$",
    r"^(.)\1+$",
)


def running(steps: Column) -> Column:
    """Running totals of an array of numbers, in blocks of about its root."""
    n = F.size(steps)
    block = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    empty = F.array().cast("array<bigint>")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), block)
    sums = F.transform(starts, lambda k: F.aggregate(F.slice(steps, k + 1, block), F.lit(0).cast("bigint"), lambda a, x: a + x))
    before = F.aggregate(sums, F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    inner = F.transform(F.arrays_zip(starts.alias("k"), before.alias("b")), lambda z: F.when(z["k"].isNotNull(), F.slice(F.aggregate(
        F.slice(steps, z["k"] + 1, block), F.array(z["b"]), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), F.lit(2), block)).otherwise(empty))
    return F.when(n > 0, F.flatten(inner)).otherwise(empty)


def _pieces(text: str, pattern: str, gate: Column) -> Column:
    """Each match with all text between it and the one before."""
    none = F.array().cast("array<string>")
    return F.when(gate, F.regexp_extract_all(text, F.lit(rf"(?s)\G.*?(?-s:{pattern})"), F.lit(0))).otherwise(none)


def _matched(pieces: Column, pattern: str) -> Column:
    return F.transform(pieces, lambda p: F.regexp_extract(p, rf"(?s)\A.*?((?-s:{pattern}))\z", 1))


def _located(df: DataFrame, name: str, pattern: str, gate: Column) -> DataFrame:
    """Adds column ``name``: matches of the pattern with their ends."""
    df = df.withColumn("_pieces", _pieces("text", pattern, gate))
    df = df.withColumn("_ends", running(F.transform("_pieces", lambda p: F.length(p).cast("bigint"))))
    df = df.withColumn("_said", _matched(F.col("_pieces"), pattern))
    zipped = F.arrays_zip(F.col("_said").alias("said"), F.col("_ends").alias("end"))
    return df.withColumn(name, zipped).drop("_pieces", "_ends", "_said")


def _spans(found: Column, order: int, least: int, tail: str) -> Column:
    """Start, order and end of the matches that are long enough."""
    measured = (lambda m: F.length(F.regexp_replace(m["said"], tail, ""))) if tail else (lambda m: F.length(m["said"]))
    good = F.filter(found, lambda m: measured(m) >= least)
    return F.transform(good, lambda m: F.struct((m["end"] - F.length(m["said"])).alias("start"), F.lit(order).alias("kind"), m["end"].alias("end")))


def _weight(n: Column) -> Column:
    n = n.cast("double")
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def window_bits(chars: Column) -> Column:
    """Entropy of the window that ends at each character, from the first full one on.

    The sum of n log2 n over the window's counts changes by the terms of the
    character that enters and the one that leaves.
    """
    count = lambda part, c: F.size(F.filter(part, lambda x: x == c))
    step = lambda i: F.struct(
        (_weight(count(F.slice(chars, F.greatest(i - (WINDOW - 1), F.lit(0)) + 1, F.least(i, F.lit(WINDOW - 1))), chars[i]) + 1)
         - _weight(count(F.slice(chars, F.greatest(i - (WINDOW - 1), F.lit(0)) + 1, F.least(i, F.lit(WINDOW - 1))), chars[i]))).alias("enter"),
        F.when(i >= WINDOW, _weight(count(F.slice(chars, i - WINDOW + 1, F.lit(WINDOW)), chars[i - WINDOW]))
               - _weight(count(F.slice(chars, i - WINDOW + 1, F.lit(WINDOW)), chars[i - WINDOW]) - 1)).otherwise(F.lit(0.0)).alias("leave"))
    return F.transform(F.sequence(F.lit(0), F.size(chars) - 1), step)


def _class_bits(w: Column, pure_hex: Column, digits: Column) -> Column:
    """Entropy that a window needs by its characters; no window reaches the last one."""
    both = rf"^(?=(?:[^A-Z]*[A-Z]){{{BOTH_CASES}}})(?=(?:[^a-z]*[a-z]){{{BOTH_CASES}}})[A-Za-z]+$"
    return (F.when(w.rlike("^[0-9a-fA-F]+$") & (pure_hex | w.rlike("[a-fA-F]")), HEX_BITS)
            .when(w.rlike("^(?=.*[0-9])(?=.*[A-Za-z])(?:[a-z0-9]+|[A-Z0-9]+)$"), ONE_CASE_BITS)
            .when(w.rlike("^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+$") | w.rlike(both), TOKEN_BITS)
            .when(digits, OTHER_BITS).otherwise(float(WINDOW)))


def _entropy_span(found: Column, order: int) -> Column:
    """Stretch of windows above the threshold of their class in each candidate, if any."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(-1).alias("low"), F.lit(-1).alias("high"))

    def fold(c):
        """Sum of n log2 n at most its limit: entropy at least the threshold."""
        window = lambda i: F.array_join(F.slice(c["chars"], i - (WINDOW - 2), F.lit(WINDOW)), "")
        limit = lambda i: float(WINDOW) * (F.log2(F.lit(float(WINDOW))) - _class_bits(window(i), c["hex"], c["digits"]))

        def add(acc, d):
            total = acc["sum"] + d["enter"] - d["leave"]
            over = F.when(acc["at"] >= WINDOW - 1, total <= limit(acc["at"]) + 1e-9).otherwise(F.lit(False))
            return F.struct(total.alias("sum"), (acc["at"] + 1).alias("at"),
                            F.when(over & (acc["low"] < 0), acc["at"] - (WINDOW - 1)).otherwise(acc["low"]).alias("low"),
                            F.when(over, acc["at"] + 1).otherwise(acc["high"]).alias("high"))

        return F.aggregate(window_bits(c["chars"]), start, add)

    def scored(s):
        # an array of one: its element is split and looked at once, not at every step
        once = F.struct(F.split(s, "").alias("chars"), s.rlike("^[0-9a-fA-F]+$").alias("hex"), s.rlike("[0-9]").alias("digits"))
        return F.element_at(F.transform(F.array(once), fold), 1)

    likely = F.filter(found, lambda m: ~m["said"].rlike("|".join(f"(?:{p})" for p in ALLOWED)))
    spans = F.transform(likely, lambda m: F.struct((m["end"] - F.length(m["said"])).alias("start"), scored(m["said"]).alias("w")))
    good = F.filter(spans, lambda c: c["w"]["low"] >= 0)
    return F.transform(good, lambda c: F.struct((c["start"] + c["w"]["low"]).alias("start"), F.lit(order).alias("kind"),
                                                (c["start"] + c["w"]["high"]).alias("end")))


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``spans`` (kind, start, end), ordered by start, then kind as listed."""
    df = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for k in KINDS:
        df = _located(df, k.name, k.pattern, F.col("text").rlike(k.gate))
    df = _located(df, ENTROPY, CANDIDATE, F.col("text").rlike(rf"[A-Za-z0-9+/=_-]{{{WINDOW}}}"))
    df = df.drop("text")
    for i, k in enumerate(KINDS):
        df = df.withColumn(k.name, _spans(F.col(k.name), i, k.least, k.tail))
    df = df.withColumn(ENTROPY, _entropy_span(F.col(ENTROPY), len(KINDS)))
    names = [k.name for k in KINDS] + [ENTROPY]
    every = F.array_sort(F.concat(*names))
    label = F.array(*[F.lit(n) for n in names])
    return df.select("doc_id", F.transform(every, lambda s: F.struct(
        F.element_at(label, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

"""Secret detection in texts: matches, validity rules, context lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit import catalog as C
from lumenaudit.functions import text as X
from lumenaudit.functions.text import sql_text as q
from lumenaudit.schemas import finding

_HEAD_BLANKS = 40     # blanks and quotes behind a name that a short piece has room for


def _scan_pattern(det: C.Detector) -> str:
    """The detector's pattern for scanning.

    An optional quote in front of a name changes neither value nor line, but
    costs an attempt at every position; it is left out.
    """
    return X.java_pattern(det.pattern.replace("""(?i)["\\']?""", "(?i)", 1))


def _heads(detectors) -> str:
    """What stands before each equals sign or colon, case-folded, as one short text.

    Pieces have room for the longest name of the detectors; one that ends in a
    long run of blanks is taken whole, so that no name is missed.
    """
    longest = max((len(h) for det in detectors for h in det.heads), default=0) + 4
    chars = longest + _HEAD_BLANKS
    piece = (f"CASE WHEN length(p) > {chars} AND length(rtrim({q(X.SPACES)}, right(p, {chars}))) < {longest} "
             f"THEN p ELSE right(p, {chars}) END")
    folded = f"array_join(transform(split(_t, '[=:]'), p -> {piece}), '\\n')"
    for special, plain in X.FOLDS:
        folded = f"replace({folded}, '{special}', '{plain}')"
    return f"CASE WHEN contains(_t, '=') OR contains(_t, ':') THEN lower({folded}) END"


def _gate(det: C.Detector) -> str:
    if det.heads:
        return " OR ".join(f"contains(_heads, {q(h)})" for h in det.heads)
    any_needle = " OR ".join(f"contains(_t, {q(n)})" for n in det.needles)
    for common in ("_", "://"):
        if len(det.needles) > 1 and all(common in n for n in det.needles):
            first = "_low_line" if common == "_" else f"contains(_t, {q(common)})"
            return f"{first} AND ({any_needle})"
    return any_needle or "true"


def _constant(values, key: str) -> Column:
    """An entry of a constant array, by detector."""
    return F.expr(f"element_at(array({', '.join(map(str, values))}), {key} + 1)")


def secret_matches(df: DataFrame, text: str = "text", detectors=C.DETECTORS,
                   gate: bool = True, context: bool = False, window: int | None = None, last_only: str | None = None) -> DataFrame:
    """Every non-overlapping match of every detector, one row each.

    Keeps the other columns of ``df`` and adds ``category``, ``detector_ord``,
    ``match_ord``, ``value``, ``confidence`` and ``pattern``; with ``context``
    also ``match_start`` and ``context``.  A text is matched against a detector
    only if it passes the detector's gate.  No shuffle: texts are scanned where
    they are read.  The gate conditions are written as SQL text, which keeps the
    driver's share of the work small.  The column ``last_only`` is kept in the rows
    of the last detector only, before matches multiply them.
    """
    keep = [c for c in df.columns if c != text]
    src = F.left(F.col(text), F.lit(window)) if window else F.col(text)
    d = df.filter(F.col(text).isNotNull()).select(*keep, src.alias("_t"))
    if gate:
        d = d.select(*keep, "_t", F.expr(_heads(detectors)).alias("_heads"), F.expr("contains(_t, '_')").alias("_low_line"))
    hits = []
    for i, det in enumerate(detectors):
        hit = (f"named_struct('detector_ord', {i}, "
               f"'_m', regexp_extract_all(_t, {q(_scan_pattern(det))}, 0))")
        hits.append(f"CASE WHEN {_gate(det)} THEN {hit} END" if gate else hit)
    carried = [*keep, "_t"] if context else keep
    d = d.select(*carried, F.expr(f"explode(array_compact(array({', '.join(hits)})))").alias("_hit"))
    d = d.select(*carried, "_hit.detector_ord", "_hit._m")
    if last_only is not None:
        d = d.withColumn(last_only, F.when(F.col("detector_ord") == len(detectors) - 1, F.col(last_only)))
    pattern = _constant([q(_scan_pattern(x)) for x in detectors], "detector_ord")
    group = _constant([x.group for x in detectors], "detector_ord")
    extra = []
    if context:
        d = _with_context(d.filter(F.size("_m") > 0), keep, pattern)
        extra = [F.col("_m.start").alias("match_start"), F.col("_m.line").alias("context")]
        whole = F.col("_m.m")
    else:
        d = d.select(*keep, "detector_ord", F.posexplode("_m").alias("match_ord", "_m"))
        whole = F.col("_m")
    # a match taken by itself has the same groups: no assignment pattern looks around it
    value = F.when(group == 0, whole).otherwise(F.call_function("regexp_extract", whole, pattern, group))
    return d.select(
        *keep, "detector_ord", "match_ord", value.alias("value"), *extra,
        _constant([q(x.category) for x in detectors], "detector_ord").alias("category"),
        _constant([q(x.confidence) for x in detectors], "detector_ord").alias("confidence"),
        _constant([q(x.pattern) for x in detectors], "detector_ord").alias("pattern"),
    )


def _running(items: str, start: dict, out_type: str, step: dict, out: str, chunk: int = 128) -> str:
    """SQL for a running fold: the array of ``out`` at every item, state ``a``, item ``x``.

    Appending to an array copies it, so items are folded in chunks, and the
    chunks in an outer fold; the copying stays small for many thousand items.
    """
    def struct(fields):
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    state = {k: f"b.{k}" for k in start}
    empty, none = f"cast(array() AS array<{out_type}>)", f"cast(array() AS array<array<{out_type}>>)"
    inner = (f"aggregate(c, {struct({**state, 'out': empty})}, "
             f"(a, x) -> {struct({**step, 'out': f'array_append(a.out, {out})'})}, "
             f"r -> {struct({**{k: f'r.{k}' for k in start}, 'out': 'array_append(b.out, r.out)'})})")
    chunks = (f"transform(sequence(0, (size({items}) - 1) div {chunk}), "
              f"i -> slice({items}, cast(i * {chunk} + 1 AS int), {chunk}))")
    return f"flatten(aggregate({chunks}, {struct({**start, 'out': none})}, (b, c) -> {inner}, b -> b.out))"


def _with_context(d: DataFrame, keep: list[str], pattern: Column) -> DataFrame:
    """One row per match with ``_m.m`` (text), ``_m.start`` (offset) and ``_m.line`` (context).

    The context is the line around the match, stripped, cut to a width; on a
    last line without a break only some characters behind the match count.

    A second extraction, each match anchored at the end of the one before,
    yields the matches with the gaps in front of them.  A fold forward over
    these spans gives offsets and the part of the line in front, a fold
    backward the part behind; both keep no more than is shown, so long lines
    with many matches stay linear.
    """
    w = C.CONTEXT_WIDTH
    spans = F.regexp_extract_all(
        F.col("_t"), F.concat(F.lit(r"(?s)\G.*?(?-s:"), pattern, F.lit(")")), F.lit(0))
    d = d.withColumn("_z", F.arrays_zip(spans.alias("span"), F.col("_m").alias("m")))
    blank = q(X.SPACES)
    # what the folds need of a gap: whether it breaks the line, its first and its last line
    d = d.withColumn("_z", F.expr("""transform(
        transform(_z, z -> named_struct('n', length(z.span), 'k', length(z.m), 'm', z.m,
                                        'gap', left(z.span, length(z.span) - length(z.m)))),
        z -> named_struct('n', z.n, 'k', z.k, 'm', z.m, 'cut', contains(z.gap, '\n'),
                          'head', substring_index(z.gap, '\n', 1), 'last', substring_index(z.gap, '\n', -1)))"""))
    shown = f"left(ltrim({blank}, CASE WHEN x.cut THEN x.last ELSE concat(a.line, x.last) END), {w})"
    fronts = F.expr(_running(
        "_z", {"pos": "0", "line": "''"}, "struct<start:int,front:string>",
        {"pos": "a.pos + x.n",
         "line": f"CASE WHEN contains(x.m, '\\n') THEN substring_index(x.m, '\\n', -1) ELSE concat({shown}, x.m) END"},
        f"named_struct('start', a.pos + x.n - x.k, 'front', {shown})"))
    rest = "substring(_t, aggregate(_z, 0, (n, x) -> n + x.n) + 1)"
    behind = f"""CASE
        WHEN x.cut THEN rtrim({blank}, x.head)
        WHEN contains(x.m, '\\n') THEN concat(x.head, rtrim({blank}, substring_index(x.m, '\\n', 1)))
        ELSE concat(x.head, x.m, a.tail) END"""
    tails = F.reverse(F.expr(_running(
        "reverse(_z)", {"tail": f"left(rtrim({blank}, substring_index({rest}, '\\n', 1)), {w})"}, "string",
        {"tail": f"left({behind}, {w})"}, "a.tail")))
    last_break = F.expr("length(_t) - length(substring_index(_t, '\\n', -1))")
    # The break is computed per text, before the text is multiplied by its matches.  The
    # generator gets an expression, not a column: for a column the optimizer would add a
    # filter on its size and push copies of all of the above down with it.
    d = d.withColumn("_break", last_break)
    d = d.select(*keep, "detector_ord", "_break", F.posexplode(F.arrays_zip(
        F.col("_m").alias("m"), fronts.alias("f"), tails.alias("tail"))).alias("match_ord", "_x"))
    line = F.expr(f"""left(concat(_x.f.front, _x.m,
        CASE WHEN _break > _x.f.start + length(_x.m) THEN _x.tail
             ELSE rtrim({blank}, left(_x.tail, {C.CONTEXT_TAIL})) END), {w})""")
    return d.select(*keep, "detector_ord", "match_ord", F.struct(
        F.col("_x.m").alias("m"), F.col("_x.f.start").alias("start"), line.alias("line")).alias("_m"))


def is_valid(category: Column, value: Column, url: Column) -> Column:
    """Whether a match is likely real: placeholders, look-alikes and noise are not."""
    def rule(v, low):
        placeholder = X.equals_any(low, C.PLACEHOLDER_VALUES) | X.contains_any(low, C.PLACEHOLDER_PARTS)
        tld = F.substring_index(F.substring_index(low, "@", -1), ".", -1)
        email = ~(F.coalesce(X.ends_with_any(F.lower(url), C.ASSET_URL_SUFFIXES), F.lit(False))
                  | X.equals_any(tld, C.FILE_LIKE_TLDS) | X.contains_any(low, C.RETINA_MARKS))
        # rounded so that exact ties at the bound do not hang on the last bit
        random_looking = (F.length(v) >= C.MIN_SECRET_LENGTH) & \
            (F.round(X.entropy(v), 12) >= C.MIN_SECRET_ENTROPY)
        return (v != "") & (
            F.when(placeholder, F.lit(False))
            .when(category == "emails", email)
            .when(category.isin(*C.KEEP_CATEGORIES), F.lit(True))
            .when(category.isin(*C.ENTROPY_CATEGORIES),
                  F.when(X.starts_with_any(low, C.KNOWN_PREFIXES), F.lit(True)).otherwise(random_looking))
            .when(category == "passwords", F.length(v).between(*C.PASSWORD_LENGTH))
            .otherwise(F.lit(True)))

    judged = X.bind(X.strip(value), lambda v: X.bind(F.lower(v), lambda low: rule(v, low)))
    return value.isNotNull() & judged


def sanitise(value: Column) -> Column:
    return X.strip(value)


def secret_findings(df: DataFrame, text: str = "text", url: str = "url", detectors=C.DETECTORS,
                    gate: bool = True, context: bool = True, window: int | None = None,
                    carry: tuple = ()) -> DataFrame:
    """Valid secret matches as findings.

    ``df`` needs the text and URL columns and may have ``target``,
    ``source_id`` and ``content_type``; columns in ``carry`` are kept as well.
    """
    keep = [c for c in ("target", "source_id", url, "content_type") if c in df.columns]
    m = secret_matches(df.select(*keep, *carry, text), text, detectors, gate, context, window)
    m = m.filter(is_valid(F.col("category"), F.col("value"), F.col(url)))
    extra = {c: F.col(c) for c in ("source_id", "content_type") if c in keep}
    return finding(
        m, carry, url=F.col(url), category=F.col("category"), value=sanitise(F.col("value")),
        confidence=F.col("confidence"), pattern=F.col("pattern"),
        context=F.col("context") if context else F.lit(""),
        stage_ord=C.STAGE_CRAWL, detector_ord=F.col("detector_ord"), match_ord=F.col("match_ord"), **extra)

"""Line dedup by a log-template tree.

A line's path in the tree is its number of tokens, then its leading tokens;
below that stand the remaining tokens.  Tokens that hold digits, at signs or
``://`` are variable and become ``<*>``, unless most of a line's tokens are.  A leaf is a template: the line as it
is after that, or with one of ``FIELDS`` consecutive stretches of its remaining
tokens generalised to ``<*>`` as well, so lines that differ in one stretch meet.
A template found in ``MIN_DOCS`` different texts recurs; its first occurrence
(smallest id, then line) stays and the others are dropped.  With ``long_docs``
a line of ``LONG_TOKENS`` tokens or more that stands as it is in that many
different texts recurs as well, so a passage of two texts can go.

Exact copies of a whole text count as one text, so that copied documents are
left to document-level dedup.  Results in odd cases: a null text stays null and
has no lines; lines with fewer than ``MIN_TOKENS`` tokens are never dropped;
equal rows (same id and text) are treated alike; a null id stands before all
others; an empty table stays empty.  Lines are split at ``\\n``, texts are read
whole, and a template that holds a third of all lines is counted on the map
side; only the narrow rows (id, line, template) are shuffled, never the lines.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumenaudit.llm.common import map_texts, stored, utf8

MIN_DOCS = 3
MIN_TOKENS = 4
LONG_TOKENS = 20
LEADING = 2
FIELDS = 5
STAR = b"<*>"
_VARIABLE = re.compile(rb"[0-9@]|://")


def templates(line: bytes) -> list[int]:
    """Hashes of the leaves a line belongs to; empty for a line too short."""
    tokens = line.split()
    n = len(tokens)
    if n < MIN_TOKENS:
        return []
    if _VARIABLE.search(line):
        masked = [STAR if _VARIABLE.search(t) else t for t in tokens]
        if 2 * masked.count(STAR) <= n:
            tokens = masked
    head = b"%d|" % n + b" ".join(tokens[:LEADING])
    rest = tokens[LEADING:]
    m = len(rest)
    out = [xxhash.xxh3_64_intdigest(b"0|" + head + b"|" + b" ".join(rest))]
    if m >= FIELDS:
        cuts = [m * g // FIELDS for g in range(FIELDS + 1)]
        parts = [b" ".join(rest[a:b]) for a, b in zip(cuts, cuts[1:])]
        for g in range(FIELDS):
            leaf = b"|".join([b"%d" % (g + 1), head, *parts[:g], STAR, *parts[g + 1:]])
            out.append(xxhash.xxh3_64_intdigest(leaf))
    return out


def whole_line(line: bytes) -> list[int]:
    """Hash of a long line as it is, digits included; empty for others.  Its lowest bit is set."""
    tokens = line.split()
    return [xxhash.xxh3_64_intdigest(b"whole|" + b" ".join(tokens)) | 1] if len(tokens) >= LONG_TOKENS else []


def _identity(doc_id: str, text: str) -> list[Column]:
    """Tells rows apart: the id (nulls first) and a digest of the text."""
    return [F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("row_id"), F.xxhash64(text).alias("row_text")]


def line_templates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """One row per line and template: row_id, row_text, line, template; with ``whole`` long lines too, told apart by the lowest bit."""

    def emit(texts, rest):
        of, at, leaf = [], [], []
        for d, t in enumerate(texts):
            for i, line in enumerate(t.split(b"\n")):
                found = templates(line)
                if whole:
                    found = [leaf_id & ~1 for leaf_id in found] + whole_line(line)
                of += [d] * len(found)
                at += [i] * len(found)
                leaf += found
        of = pa.array(np.array(of, np.int64))
        return pa.RecordBatch.from_arrays(
            [rest["row_id"].take(of), rest["row_text"].take(of), pa.array(np.array(at, np.int32)),
             pa.array(np.array(leaf, np.uint64).view(np.int64))], ["row_id", "row_text", "line", "template"])

    return map_texts(docs.select(*_identity(doc_id, text), utf8(text).alias("text")), emit,
                     "row_id bigint, row_text bigint, line int, template bigint")


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS,
                  long_docs: int | None = None) -> DataFrame:
    """Per document with any: row_id, row_text and the numbers of the lines to drop."""
    leaves = stored(line_templates(docs, doc_id, text, long_docs is not None), "line-templates")
    # a row per template and text: no more than a count is needed of them
    recurring = leaves.select("template", "row_text").distinct().groupBy("template").agg(F.count("*").alias("texts"))
    least = F.lit(min_docs) if long_docs is None else F.when(F.col("template").bitwiseAND(1) == 1, long_docs).otherwise(min_docs)
    recurring = recurring.filter(F.col("texts") >= least).select("template")
    hits = stored(leaves.join(recurring, "template"), "recurring-lines")
    # the first occurrence: smallest id, then line; ids that repeat are told apart by their text's digest
    place = F.struct("row_id", "row_text", "line")
    later = hits.join(hits.groupBy("template").agg(F.min(place).alias("first")), "template").filter(place != F.col("first"))
    return later.groupBy("row_id", "row_text").agg(F.sort_array(F.collect_set("line")).alias("dropped"))


def _without(texts: list[bytes], rest: dict) -> pa.RecordBatch:
    """The rows with the lines numbered in ``_dropped`` taken out of their texts; null texts stay."""
    out = []
    for text, absent, dropped in zip(texts, rest["_absent"].to_pylist(), rest["_dropped"].to_pylist()):
        gone = set(dropped)
        cut = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in gone) if gone else text
        out.append(None if absent else cut)
    columns = {n: c for n, c in rest.items() if n != "_absent"}
    return pa.RecordBatch.from_arrays([*columns.values(), pa.array(out, pa.string())], [*columns, "_text"])


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lines: str = "dropped_lines",
               min_docs: int = MIN_DOCS, long_docs: int | None = None) -> DataFrame:
    """The documents with recurring lines taken out of ``text``; ``lines`` holds the numbers of those dropped."""
    found = dropped_lines(docs, doc_id, text, min_docs, long_docs).select(
        F.col("row_id").alias("_row_id"), F.col("row_text").alias("_row_text"), F.col("dropped").alias("_dropped"))
    whole = docs.select(F.struct("*").alias("row"))  # so that no name of the table meets one of these
    row_id, row_text = _identity(f"row.`{doc_id}`", f"row.`{text}`")
    both = whole.join(found, (row_id == F.col("_row_id")) & (row_text == F.col("_row_text")), "left")
    kept = [c for c in docs.columns if c.lower() != lines.lower()]
    others = {c: f"_{i}" for i, c in enumerate(kept) if c != text}
    rows = both.select(*[F.col(f"row.`{c}`").alias(n) for c, n in others.items()], F.col(f"row.`{text}`").isNull().alias("_absent"),
                       F.coalesce("_dropped", F.array().cast("array<int>")).alias("_dropped"), utf8(f"row.`{text}`").alias("_text"))
    # an Arrow pass, as a column function would run once for the text and once more for each filter on it
    schema = StructType([f for f in rows.schema if f.name not in ("_absent", "_text")] + [StructField("_text", StringType())])
    cut = map_texts(rows, _without, schema, "_text")
    return cut.select(*[F.col(others.get(c, "_text")).alias(c) for c in kept], F.col("_dropped").alias(lines))

"""Quality rules from compression bands.

Whole documents and fixed chunks, the tail included, are compressed with
zstandard; a ratio outside the band of its length marks the text as repetitive
or incompressible.  Counts
of words, symbols, repeated lines and repeated word windows come from the same
pass.

Results in odd cases: a null or empty text has no words, ratio 0 and is not
kept.  Texts under ``MIN_BYTES`` have no band.  Equal rows give equal rows;
an empty table gives an empty table; other columns of the input are ignored.
Nothing is shuffled, every text is read whole, and a long text is worked on
alone, so memory follows the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import map_texts, utf8

LEVEL = 3
CHUNK = 2048
MIN_BYTES = 64
#: (length in bytes below which it holds, smallest ratio, largest ratio).  The smallest ratios lie 0.02 to 0.15 below the lowest one of
#: clean prose at the start of the range (measured: 0.88 at 64 bytes, 1.22 at 256, 1.39 at 512, 1.66 at 1 KB, 1.88 at 2 KB, 2.06 at 4 KB,
#: 2.29 at 16 KB), since short texts compress less.  Words of characters drawn evenly reach 1.4 (64 letters), 1.6 (36) and 1.9 (16).
BANDS = ((96, 0.8, 3.0), (128, 0.87, 3.0), (192, 0.95, 3.0), (256, 1.07, 3.0), (320, 1.19, 3.2), (384, 1.22, 3.2), (512, 1.28, 3.2),
         (768, 1.36, 3.2), (896, 1.48, 3.2), (1024, 1.55, 3.2), (1536, 1.6, 3.5), (2048, 1.7, 3.5), (3072, 1.82, 3.5), (4096, 1.93, 3.5),
         (8192, 2.0, 4.0), (16384, 2.1, 4.0), (1 << 62, 2.15, 5.0))
CHUNK_BAND = (1.82, 3.5)
#: Share of a document's bytes that may stand in chunks outside their band.
ODD_CHUNKS = 0.25
MIN_WORDS = 50
MAX_REPEAT_SHARE = 50

SCHEMA = ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "ratio double, n_chunks bigint, n_odd_chunks bigint, in_band boolean")
_SYMBOLS = b"#*$%&|<>"
_BLANK = bytes([0x20, *range(0x09, 0x0E)])
_CONTINUED = bytes(range(0x80, 0xC0))


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    pair = seq[:-1] * len(ids) + seq[1:]
    if len(ids) > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * len(ids) + seq[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order[1:]] == triple[order[:-1]]
    if not same.any():
        return 0
    first = np.zeros(n - 2, bool)
    first[order[1:][same]] = True
    first[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k:n - 2 + k] |= first
    return int(inside.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def band(n: int) -> tuple[float, float]:
    return next((low, high) for below, low, high in BANDS if n < below)


def compression(z: zstandard.ZstdCompressor, text: bytes) -> tuple[float, int, int, bool]:
    """Ratio of the whole, chunks, those outside their band, and the verdict.

    The tail behind the full chunks is a chunk with the band of its length, unless it is too short for one.
    """
    n = len(text)
    if not n:
        return 0.0, 0, 0, False
    ratio = n / len(z.compress(text))
    n_chunks = odd = judged = odd_bytes = 0
    for at in range(0, n if n >= CHUNK else 0, CHUNK):
        part = text[at:at + CHUNK]
        size = len(part)
        if size < MIN_BYTES:
            break
        low, high = CHUNK_BAND if size == CHUNK else band(size)
        n_chunks += 1
        judged += size
        if not low <= size / len(z.compress(part)) <= high:
            odd += 1
            odd_bytes += size
    low, high = band(n)
    good = n < MIN_BYTES or (low <= ratio <= high and odd_bytes <= ODD_CHUNKS * judged)
    return ratio, n_chunks, odd, good


def _measure(texts: list[bytes], rest: dict) -> pa.RecordBatch:
    z = zstandard.ZstdCompressor(level=LEVEL)
    rows = []
    for t in texts:
        words = t.split()
        chars = len(t.translate(None, _BLANK + _CONTINUED))
        rows.append((len(words), chars, len(t) - len(t.translate(None, _SYMBOLS)), repeated_lines(t), repeated_words(words),
                     *compression(z, t)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio", "n_chunks", "n_odd_chunks", "in_band"]
    types = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
    columns = [pa.array([r[i] for r in rows], types[i]) for i in range(len(names))]
    return pa.RecordBatch.from_arrays([rest["doc_id"], *columns], ["doc_id", *names])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_SHARE * F.col("n_words"))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, ratios, ``base_failed`` and ``kept``."""
    found = map_texts(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8(text).alias("text")), _measure, SCHEMA)
    found = found.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & F.col("in_band"))
    own = ["ratio", "n_chunks", "n_odd_chunks", "in_band"]
    return found.select(*[c for c in found.columns if c not in own], *own)

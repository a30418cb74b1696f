"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of consecutive words, a window into word
shingles.  The corpus frequency of every benchmark shingle gives the order of
rarity.  A window is wholly contained in a document only if its rarest shingle
is, so that prefix of one shingle is joined with the documents' shingles; the
offset in the window then fixes where it would stand, start and end must lie
within the document, and the words there are compared one by one.

Results in odd cases: null texts have no words and are never hit; an item
without words has no window, one shorter than a window is one window; items
with equal windows are all reported; a null item id is reported as an empty
string.  Equal rows (same id and text) give equal rows, an empty table of
documents an empty result, and an empty benchmark no hits.  Other columns are
ignored.  Texts are read whole and long ones worked on alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenaudit.llm.common import map_texts, row_key, stored, utf8
from lumenaudit.llm.rolling import LETTERS, Words

WINDOW = 10
SHINGLE = 3
#: Up to so many distinct benchmark shingles (8 bytes each) are sent to the tasks to thin out the documents' shingles
#: there; beyond it the join alone does it.
SENT_SHINGLES = 4_000_000

_SPLIT = bytes(LETTERS[i] or 0x20 for i in range(256))


def word_list(text: bytes) -> list[bytes]:
    return text.translate(_SPLIT).split()


def item_windows(items: DataFrame, window: int, shingle: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row per distinct window: its words, the items it comes from, and its shingles by offset."""

    def cut(texts, rest):
        names, said, grams = [], [], []
        for t, name in zip(texts, rest["item"].to_pylist()):
            words = word_list(t)
            size = min(window, len(words))
            if not size:
                continue
            k = min(shingle, size)
            at, h = Words([t]).grams(k)
            for i in range(len(words) - size + 1):
                names.append(name)
                said.append(b" ".join(words[i:i + size]).decode("utf-8", "replace"))
                grams.append(h[i:i + size - k + 1].view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(said, pa.string()), pa.array(grams, pa.list_(pa.int64()))],
                                          ["item", "words", "grams"])

    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), utf8(text).alias("text"))
    cut_up = map_texts(rows, cut, "item string, words string, grams array<bigint>")
    return cut_up.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"), F.first("grams").alias("grams"))


def shingle_hits(docs: DataFrame, sizes: list[int], wanted: np.ndarray | None) -> DataFrame:
    """Shingles of the documents: key, words of the text, position and hash; only ``wanted`` ones if given."""
    sent = None if wanted is None else docs.sparkSession.sparkContext.broadcast(wanted)

    def emit(texts, rest):
        words = Words(texts)
        keep, hashes = [], []
        for k in sizes:
            at, h = words.grams(k)
            if sent is not None:
                slot = np.minimum(np.searchsorted(sent.value, h), len(sent.value) - 1)
                found = np.flatnonzero(sent.value[slot] == h) if len(sent.value) else np.empty(0, np.int64)
                at, h = at[found], h[found]
            keep.append(at)
            hashes.append(h)
        at, h = np.concatenate(keep), np.concatenate(hashes)
        owner = words.owner[at]
        return pa.RecordBatch.from_arrays(
            [rest["key"].take(pa.array(owner)), pa.array(words.counts[owner].astype(np.int64)),
             pa.array(words.position[at].astype(np.int64)), pa.array(h.view(np.int64))], ["key", "n_words", "position", "gram"])

    return map_texts(docs.select(row_key("doc_id", "text").alias("key"), utf8("text").alias("text")), emit,
                     "key string, n_words bigint, position bigint, gram bigint")


def candidates(docs: DataFrame, windows: DataFrame, sent_limit: int = SENT_SHINGLES) -> DataFrame:
    """Places where a window's rarest shingle stands, within the bounds of the document."""
    at = windows.select("words", "items", F.size("grams").alias("n_grams"), F.posexplode("grams").alias("offset", "gram"))
    grams = at.select("gram").distinct()
    sizes = sorted({r["k"] for r in windows.select((F.size(F.split("words", " ")) - F.size("grams") + 1).alias("k")).distinct().collect()})
    if not sizes:
        sizes = [SHINGLE]
    sample = grams.limit(sent_limit + 1).count()
    wanted = None
    if sample <= sent_limit:  # checked: at most 8 bytes x sent_limit, in Arrow batches
        wanted = np.sort(grams.toArrow().column("gram").to_numpy().view(np.uint64))
    hits = shingle_hits(docs, sizes, wanted)
    if wanted is None:
        hits = hits.join(grams, "gram", "left_semi")
    hits = stored(hits, "shingle-hits")
    rarity = hits.groupBy("gram").agg(F.count("*").alias("seen"))
    ranked = at.join(rarity, "gram", "left").fillna(0, ["seen"])
    prefix = ranked.groupBy("words").agg(F.min(F.struct("seen", "gram", "offset")).alias("rarest"), F.first("items").alias("items"))
    prefix = prefix.filter("rarest.seen > 0").select("words", "items", "rarest.gram", "rarest.offset")
    found = hits.join(prefix, "gram").withColumn("start", F.col("position") - F.col("offset"))
    inside = (F.col("start") >= 0) & (F.col("start") + F.size(F.split("words", " ")) <= F.col("n_words"))
    found = found.filter(inside)
    return found.groupBy("key").agg(F.collect_set(F.struct("start", "words", "items")).alias("found"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, doc_id: str = "doc_id",
                  text: str = "text", sent_limit: int = SENT_SHINGLES, carry: bool = False) -> DataFrame:
    """One row per document: words, hit words, hit spans and the items whose windows occur.

    With ``carry`` the whole input row stands in a column ``row`` in place of ``doc_id``.
    """
    first = F.struct("*").alias("row") if carry else F.col(doc_id).cast("bigint").alias("doc_id")
    rows = docs.select(first, row_key(doc_id, text).alias("key"), utf8(text).alias("text"))
    name = rows.columns[0]
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    windows = stored(item_windows(items, window, shingle), "item-windows")
    found = candidates(docs, windows, sent_limit)
    added = "n_words bigint, n_hit bigint, spans array<struct<first_word:bigint,end_word:bigint>>, items array<string>"
    schema = StructType([rows.schema[0], *StructType.fromDDL(added)])
    rows = rows.join(found, "key", "left").select(name, "found", "text")

    def verify(texts, rest):
        n_words, n_hit, spans, hit_items = [], [], [], []
        for t, places in zip(texts, rest["found"]):
            words = word_list(t)
            n_words.append(len(words))
            places = places.as_py() if places.is_valid else []
            hit, names = np.zeros(len(words) + 1, np.int32), set()
            for p in places:
                expected = p["words"].encode().split(b" ")
                a = p["start"]
                if words[a:a + len(expected)] == expected:
                    hit[a] += 1
                    hit[a + len(expected)] -= 1
                    names.update(p["items"])
            inside = np.cumsum(hit[:-1]) > 0 if names else np.zeros(0, bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))) if names else []
            n_hit.append(int(inside.sum()))
            spans.append([{"first_word": int(a), "end_word": int(b)} for a, b in zip(edge[0::2], edge[1::2])])
            hit_items.append(sorted(names))
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [rest[name], pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(spans, kind),
             pa.array(hit_items, pa.list_(pa.string()))], [name, "n_words", "n_hit", "spans", "items"])

    return map_texts(rows, verify, schema)

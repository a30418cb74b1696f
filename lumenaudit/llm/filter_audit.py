"""Audit of how filters interact, with duplicates found in radix tries of whole texts.

Each document gets a mask of the filters it fails; all the numbers of the report
follow from the counts of masks per part, whatever the order of the filters.
Whether a text equals that of a smaller id is the one filter that crosses
documents:

1. Prefixes are measured: a prefix that holds more than ``LIMIT`` bytes of
   different texts is made four times as long, until it is light or a whole text.
2. Every chunk of documents inserts its texts into a compressed trie, whose
   terminals hold the smallest id.  Rows above it are duplicates for sure and
   travel without their text; of equal texts one goes on, however many there are.
3. The rest is range-partitioned by prefix.  Runs of prefixes of about ``RUN``
   bytes go into one trie each, which is traversed for the flags and dropped.

Results in odd cases: a null text is empty; a null id is smaller than no other
and has no smaller one, so its row never fails by it, nor do rows of equal id
and text by each other; repeated rows count as often as they stand; labels of
one document that differ count as 1 if any is; a document without labels or with
a null in them has neither; a null part is the empty string; other columns are
ignored; an empty table gives an empty report.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenaudit.functions.skew import salted_join
from lumenaudit.llm.common import map_texts, stored, utf8

FILTERS = "ABCDE"
SAME = 1 << FILTERS.index("E")
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 100, 80, 10

#: First length of a prefix, and how much longer the next one is.
FIRST, LONGER = 8, 4
#: Bytes of different texts that may share a prefix, and bytes of texts put into a trie.
LIMIT, RUN = 8 << 20, 8 << 20
#: Bytes of a prefix that order the ranges; a digest of all of it tells longer ones apart.
HEAD = 32
#: Heavy prefixes (8 bytes each) that are sent to all executors; more of them are joined.
SENT = 200_000

_CAPITALS = bytes(range(0x41, 0x5B))
_CONTINUED = bytes(range(0x80, 0xC0))
_MARKS = b"#$%&*|"


def failures(text: bytes) -> int:
    """The mask of the filters that look at one text only."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _CONTINUED))
    return ((n < MIN_WORDS) | (100 * len(set(words)) < MIN_DISTINCT * n) << 1 | (100 * capitals > MAX_CAPITALS * points) << 2
            | (len(text.translate(None, _MARKS)) < len(text)) << 3)


def common(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes of ``a`` equal those of ``b`` from ``at`` on."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) >> 1
        if a[low:mid] == b[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Node:
    """``edges``: first byte to [label, node]; ``rows`` end here, ``least`` is the smallest id among them."""

    __slots__ = ("edges", "rows", "least")

    def __init__(self):
        self.edges, self.rows, self.least = {}, None, None


class Trie:
    """A compressed trie of byte strings."""

    def __init__(self):
        self.top, self.size = Node(), 0

    def insert(self, text: bytes, number: int | None, row: int) -> None:
        node, at, n = self.top, 0, len(text)
        self.size += n
        while at < n:
            edge = node.edges.get(text[at])
            if edge is None:
                node.edges[text[at]] = [text[at:], made := Node()]
                node, at = made, n
            elif text.startswith(edge[0], at):
                node = edge[1]
                at += len(edge[0])
            else:
                k = common(edge[0], text, at)
                between = Node()
                between.edges[edge[0][k]] = [edge[0][k:], edge[1]]
                edge[0], edge[1] = edge[0][:k], between
                node = between
                at += k
        if node.rows is None:
            node.rows = []
        node.rows.append((number, row))
        if number is not None and (node.least is None or number < node.least):
            node.least = number

    def duplicates(self, n: int) -> list[bool]:
        """For each of ``n`` inserted rows, whether an equal text has a smaller id."""
        out, todo = [False] * n, [self.top]
        while todo:
            node = todo.pop()
            for number, row in node.rows or ():
                out[row] = number is not None and number > node.least
            todo += [edge[1] for edge in node.edges.values()]
        return out


def _first(length: int | Column) -> Column:
    return F.substring(F.col("text"), F.lit(1), length if isinstance(length, Column) else F.lit(length))


def with_prefix(texts: DataFrame) -> DataFrame:
    """Adds ``head`` and ``tail``, which stand for a prefix of ``text`` long enough for few bytes of different texts to share it."""
    k, size = FIRST, F.when(F.length("text") < FIRST, F.length("text")).otherwise(FIRST)
    out = texts.withColumn("_size", size.cast("int"))
    while True:
        reached = out.filter(F.col("_size") == k).select(F.xxhash64(_first(k)).alias("heavy"), F.xxhash64("text").alias("same"), F.length("text").alias("n"))
        once = reached.groupBy("heavy", "same").agg(F.max("n").alias("n"))
        heavy = stored(once.groupBy("heavy").agg(F.sum("n").alias("bytes"), F.max("n").alias("longest"))
                       .filter((F.col("bytes") > LIMIT) & (F.col("longest") > k)).select("heavy"), "heavy-prefixes")
        many = heavy.count()
        if not many:
            break
        heavy = heavy.withColumn("_longer", F.lit(True))
        out = out.withColumn("heavy", F.when(F.col("_size") == k, F.xxhash64(_first(k))))
        out = out.join(F.broadcast(heavy), "heavy", "left") if many <= SENT else salted_join(out, heavy, ["heavy"], "left", F.col("text"))
        k *= LONGER
        longer = F.least(F.length("text"), F.lit(k)).cast("int")
        out = out.withColumn("_size", F.when(F.col("_longer"), longer).otherwise(F.col("_size"))).drop("heavy", "_longer")
    return (out.withColumn("head", _first(F.least(F.col("_size"), F.lit(HEAD)))).withColumn("tail", F.xxhash64(_first(F.col("_size")))).drop("_size"))


_KINDS = {"doc_id": pa.int64(), "part": pa.string(), "head": pa.binary(), "tail": pa.int64(), "text": pa.binary(), "mask": pa.int32(), "n": pa.int64(),
          "open": pa.bool_()}
MARKED = "doc_id bigint, part string, head binary, tail bigint, text binary, mask int, n bigint, open boolean"


def _of_chunk(texts: list[bytes], rest: dict) -> pa.RecordBatch:
    """Masks, and duplicates within the chunk; rows that may still have a smaller equal elsewhere stay open and keep their text."""
    trie, ids = Trie(), rest["doc_id"].to_pylist()
    for row, (text, number) in enumerate(zip(texts, ids)):
        trie.insert(text, number, row)
    same = trie.duplicates(len(texts))
    rows: dict[tuple, int] = {}
    for text, number, part, head, tail, dup in zip(texts, ids, *(rest[c].to_pylist() for c in ("part", "head", "tail")), same):
        mask = failures(text) | dup * SAME
        undecided = not dup and number is not None
        row = (number, part, head, tail, text, mask, undecided) if undecided else (number, part, None, None, None, mask, undecided)
        rows[row] = rows.get(row, 0) + 1
    columns = [[r[i] for r in rows] for i in range(6)] + [list(rows.values()), [r[6] for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS.values())], list(_KINDS))


def _of_ranges(batches):
    """Duplicates among open rows, which come ordered by prefix: a trie for each run of prefixes."""
    trie, held, last = Trie(), [], None

    def flush():
        flags = trie.duplicates(len(held))
        columns = [[r[i] for r in held] for i in range(2)] + [[r[2] | same * SAME for r, same in zip(held, flags)], [r[3] for r in held]]
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, ("doc_id", "part", "mask", "n"))], ["doc_id", "part", "mask", "n"])

    for batch in batches:
        for i in range(batch.num_rows):
            number, part, head, tail, text, mask, n = (batch.column(c)[i].as_py() for c in ("doc_id", "part", "head", "tail", "text", "mask", "n"))
            if trie.size >= RUN and (head, tail) != last:
                yield flush()
                trie, held = Trie(), []
            last = head, tail
            trie.insert(text, number, len(held))
            held.append((number, part, mask, n))
    if held:
        yield flush()


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Documents by id, part and mask of the filters they fail: ``doc_id``, ``part``, ``mask``, ``n``."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                        utf8(text).alias("text"))
    marked = stored(map_texts(with_prefix(plain), _of_chunk, MARKED), "audit-marked")
    ranged = marked.filter("open").drop("open").repartitionByRange("head", "tail").sortWithinPartitions("head", "tail")
    found = ranged.mapInArrow(_of_ranges, "doc_id bigint, part string, mask int, n bigint")
    return marked.filter("not open").select("doc_id", "part", "mask", "n").unionByName(found).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def by_part(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones among them, per part and mask."""
    has = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.select("doc_id", "quality", "toxic").groupBy("doc_id").agg(has("quality").alias("good"), has("toxic").alias("bad"))
    count = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0))
    return found.join(known, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), count("good").alias("good"), count("bad").alias("bad"))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step of it."""
    orders = ["".join(o) for o in permutations(filters)]
    bit = {f: 1 << i for i, f in enumerate(filters)}
    seen = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "bad")).alias("seen"))
    steps = seen.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    bits = [F.coalesce(*[F.when(F.substring("filter_order", i + 1, 1) == f, b) for f, b in bit.items()]) for i in range(len(filters))]
    here = sum((F.when(F.col("step") == i + 1, b).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    before = sum((F.when(F.col("step") > i + 1, b).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
    steps = steps.withColumn("here", here).withColumn("before", before)
    fails = lambda m: m["mask"].bitwiseAND(F.col("here")) > 0
    left = lambda m: m["mask"].bitwiseAND(F.col("before")) == 0

    def total(test, value=lambda m: m["n"]):
        return F.aggregate("seen", F.lit(0).cast("bigint"), lambda sum_, m: sum_ + F.when(test(m), value(m)).otherwise(0))

    removed = lambda m: fails(m) & left(m)
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total(lambda m: ~fails(m) & left(m)).alias("kept"), total(removed).alias("removed"), total(lambda m: fails(m) & ~left(m)).alias("redundant"),
        total(lambda m: m["mask"] == F.col("here")).alias("unique_fails"), total(removed, lambda m: m["good"]).alias("good_lost"),
        total(removed, lambda m: m["bad"]).alias("toxic_lost"),
        # A filter comes first among the k that a document fails in one of k orders.
        total(fails, lambda m: (m["n"] * F.lit(len(orders)) / F.bit_count(m["mask"])).cast("bigint")).alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    return interactions(by_part(masks(docs, **columns), labels))

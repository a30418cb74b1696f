"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

A document is the set of its word shingles; documents with one set form a
class, and the work goes on with one text per class.  Classes that share a band
of their signature meet in a bucket.  Buckets never give all pairs: in each
round a few hubs of a bucket, those with the fewest shingles of their own first,
are compared with its members that are not connected with them yet, and 32
times as many in the next round, until the members that have not been hubs are
connected or have all been compared; a round takes all hubs that are left once
the bounds below leave few pairs of them.  Before that, every class learns how many
of its shingles no other class in a bucket holds: these bound its similarity
with any other text from above, and so does, for two members of a large bucket,
which of the shingles of the bucket's first hub each holds; classes and pairs
whose bound lies below the threshold are not compared.  A pair's signatures are compared batch by batch and
the pair is dropped once the posterior probability that its similarity reaches
the threshold is below ``PRUNE``; survivors are decided on their full sets.

Results in odd cases: documents without words (null, empty) have an empty set,
are linked with nothing and form their own component; fewer words than a
shingle make one shingle of all words.  A null id is ignored when the smallest
id of a component is taken.  Equal rows fall into one component and share its
id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.functions.skew import SALTS, first_per_key
from lumenaudit.llm.buckets import answered, ask, bucket_bits, each, entries, low_bits, shared
from lumenaudit.llm.common import map_texts, row_key, stored, utf8
from lumenaudit.llm.graph import components
from lumenaudit.llm.rolling import SOLID, U, Words, mix

ROWS = 5              # of a band
MISS = 1e-5           # chance that two documents just at the threshold share no band
PRUNE = 1e-6          # chance at which a pair is given up early
BATCH = 20            # signature places compared at a time
GROWTH = 31           # hubs per bucket grow by this factor, and one, from round to round
CROWD = 8             # in larger buckets the first hub is compared in full with every member
MEETS = 1024          # hubs that a member meets on average at most, in memory, for a round to take all that are left
PAIRS = 4             # pairs per member that such a round leaves at most
HOT = 256             # members of larger buckets meet its hubs in several tasks


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log(1 - threshold ** rows)))


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, in one array, and where each text's begin."""
    words = Words(texts, SOLID)
    at, h = words.grams(k)
    owner = words.owner[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        whole = []
        for d in short:
            h0 = words.hashes[words.first[d]:words.first[d + 1]]
            total = h0[:1].copy()
            for x in h0[1:]:
                total = total * U(0x9E3779B97F4A7C15) + x
            whole.append(mix(total + U(len(h0)))[0])
        owner, h = np.concatenate([owner, short]), np.concatenate([h, np.array(whole, U)])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    owner, h = owner[fresh], h[fresh]
    return h, np.searchsorted(owner, np.arange(len(texts) + 1))


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeded = np.random.default_rng(7_654_321)
    return seeded.integers(0, 2**62, n, dtype=np.uint64) * U(2) + U(1), seeded.integers(0, 2**63, n, dtype=np.uint64)


def signatures(shingles: np.ndarray, first: np.ndarray, places: int) -> np.ndarray:
    """Smallest value of each text's set under each permutation; empty sets get zeros."""
    a, b = _permutations(places)
    out = np.zeros((len(first) - 1, places), np.uint32)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    starts = first[:-1][full]
    value = np.empty_like(shingles)
    for p in range(places):
        np.multiply(shingles, a[p], out=value)
        value += b[p]
        out[full, p] = np.minimum.reduceat(value, starts) >> U(32)
    return out


def shingled(docs: DataFrame, k: int, places: int) -> DataFrame:
    """Row key, id, size of the set, digest of the set (null when empty), signature."""

    def emit(texts, rest):
        h, first = shingle_sets(texts, k)
        sizes = np.diff(first)
        digest = [hashlib.md5(h[a:b].tobytes()).hexdigest() if b > a else None for a, b in zip(first[:-1], first[1:])]
        signed = signatures(h, first, places)
        return pa.RecordBatch.from_arrays(
            [rest["key"], rest["doc_id"], pa.array(sizes.astype(np.int64)), pa.array(digest, pa.string()),
             pa.array([row.tobytes() for row in signed], pa.binary())], ["key", "doc_id", "n_shingles", "node", "signature"])

    return map_texts(docs.select(row_key("doc_id", "text").alias("key"), "doc_id", utf8("text").alias("text")), emit,
                     "key string, doc_id bigint, n_shingles bigint, node string, signature binary")


def banded(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """One row per class and band: a hash of the band's number and places."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            signed = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, -1)
            parts = signed[:, :bands * rows].reshape(n, bands, rows).astype(U)
            total = np.broadcast_to(np.arange(bands, dtype=U), (n, bands)).copy()
            for r in range(rows):
                total = mix(total * U(0x9E3779B97F4A7C15) + parts[:, :, r])
            node = batch.column("node").take(pa.array(np.repeat(np.arange(n), bands)))
            yield pa.RecordBatch.from_arrays([node, pa.array(total.ravel().view(np.int64))], ["node", "bucket"])

    return classes.select("node", "signature").mapInArrow(run, "node string, bucket bigint")


def least_matches(places: int, threshold: float, prune: float = PRUNE, batch: int = BATCH) -> dict[int, int]:
    """By places compared: the fewest matches with which a pair may still reach the threshold.

    With a uniform prior the similarity has a Beta(m + 1, n - m + 1) posterior;
    its mass above the threshold is summed on a grid.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    above = grid >= threshold
    out = {}
    for n in [*range(batch, places, batch), places]:
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(logs - logs.max())
            if mass[above].sum() >= prune * mass.sum():
                out[n] = m
                break
    return out


def similar_signatures(pairs: DataFrame, places: int, threshold: float) -> DataFrame:
    """Drops pairs (u, v with signatures su, sv) whose posterior falls below the bound, but for those marked ``crowded``."""
    least = least_matches(places, threshold)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            u = np.frombuffer(b"".join(batch.column("su").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            v = np.frombuffer(b"".join(batch.column("sv").to_pylist()), np.uint32).reshape(batch.num_rows, -1)
            left = np.arange(batch.num_rows)
            matches, done = np.zeros(batch.num_rows, np.int32), 0
            for n, need in least.items():
                matches[left] += (u[left, done:n] == v[left, done:n]).sum(1)
                left, done = left[matches[left] >= need], n
            kept = batch.take(pa.array(np.union1d(left, np.flatnonzero(np.array(batch.column("crowded").to_pylist(), bool)))))
            yield pa.RecordBatch.from_arrays([kept.column(c) for c in ("u", "v", "crowded")], ["u", "v", "crowded"])

    return pairs.mapInArrow(run, "u string, v string, crowded boolean")


def held_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which values of ``a`` (distinct, sorted) stand in ``b``: a bit each, in 64-bit words."""
    bits = np.zeros(-(-len(a) // 64) * 64, bool)
    bits[:len(a)] = np.isin(a, b, assume_unique=True)
    return np.packbits(bits, bitorder="little").view(np.int64)


def compared_sets(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Shingles that pairs (u, v with texts tu, tv) have in common, and whether 100 * intersection >= percent * union.

    For crowded pairs also which of u's shingles v holds (``of_u``), and the other way round.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                n = part.num_rows
                h, first = shingle_sets(part.column("tu").to_pylist() + part.column("tv").to_pylist(), k)
                both, good, of_u, of_v = [], [], [], []
                for i, crowded in enumerate(part.column("crowded").to_pylist()):
                    a, b = h[first[i]:first[i + 1]], h[first[n + i]:first[n + i + 1]]
                    common = len(a) + len(b) - len(np.unique(np.concatenate([a, b])))
                    both.append(common)
                    good.append(100 * common >= percent * (len(a) + len(b) - common))
                    of_u.append(held_bits(a, b) if crowded else None)
                    of_v.append(held_bits(b, a) if crowded else None)
                words = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("u"), part.column("v"), pa.array(both, pa.int64()), pa.array(good, pa.bool_()), pa.array(of_u, words), pa.array(of_v, words)],
                    ["u", "v", "common", "linked", "of_u", "of_v"])

    return pairs.mapInArrow(run, "u string, v string, common bigint, linked boolean, of_u array<bigint>, of_v array<bigint>")


def own_shingles(texts: DataFrame, k: int) -> DataFrame:
    """Per class: ``n`` shingles, and how many of them (``own``) no other class of the table holds.

    Four bytes of a name beyond its bucket travel; two names that agree in them only make ``own`` smaller.
    """

    def pack(said, rest):
        nodes = rest["node"].to_pylist()
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{nodes[0]}-{len(nodes)}"]), pa.array([nodes], pa.list_(pa.string())), pa.array([said], pa.list_(pa.binary())),
             pa.array([sum(map(len, said))], pa.int64())], ["block", "nodes", "said", "size"])

    blocks = stored(map_texts(texts.select("node", "text"), pack, "block string, nodes array<string>, said array<binary>, size bigint"),
                    "class-blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    bits = bucket_bits(total / 5)

    def send(block, row):
        h, _ = shingle_sets(row["said"], k)
        names = np.unique(h)
        return entries(block, bits, names, [low_bits(names, bits)])

    answers = ask(each(blocks, send), shared(np.uint32))

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, first = shingle_sets(row["said"], k)
                names, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
                alone = ~(answered(row["answers"], names, bits) | (times > 1))[inverse] if len(h) else np.zeros(0, bool)
                upto = np.concatenate([[0], np.cumsum(alone)])
                yield pa.RecordBatch.from_arrays([pa.array(row["nodes"]), pa.array(np.diff(first)), pa.array(np.diff(upto[first]))],
                                                 ["node", "n", "own"])

    return blocks.join(answers, "block", "left").mapInArrow(count, "node string, n bigint, own bigint")


def _at_most(n, own, pivot, n2, own2, pivot2):
    """Bound on the shingles two classes have in common.

    Those no other class holds are never in common.  When both were compared
    with the same hub, they have in common what each has in common with the hub
    at most, and beyond it at most what each holds outside it and not alone.
    """
    plain = F.least(n - own, n2 - own2)
    through = F.least(pivot, pivot2) + F.least(n - pivot - own, n2 - pivot2 - own2)
    known = pivot.isNotNull() & pivot2.isNotNull()
    return F.when(known, F.least(plain, through)).otherwise(plain)


def _at_most_held(n, own, pivot, held, n2, own2, pivot2, held2):
    """A closer bound for two classes of which is known which shingles of one hub they hold.

    In common are those of the hub that both hold, counted exactly, and beyond
    the hub at most what each holds outside it and not alone.
    """
    met = F.aggregate(F.zip_with(held, held2, lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda total, x: total + x)
    return met + F.least(n - pivot - own, n2 - pivot2 - own2)


def _met(members: DataFrame, hubs: DataFrame, most: int) -> DataFrame:
    """Members with the hubs of their buckets, ``most`` of each bucket.

    The members of a hot bucket are spread and its hubs repeated, as often as
    leaves no more hubs than members.
    """
    salts = lambda size: F.when(size > HOT, F.least(F.lit(SALTS), F.greatest(F.lit(1), F.floor(size / most)))).otherwise(F.lit(1)).cast("int")
    left = members.withColumn("_salt", F.pmod(F.xxhash64("node"), salts(F.col("size"))).cast("int"))
    right = hubs.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts(F.col("h_size")) - 1)))
    return left.join(right, ["bucket", "_salt"])


def _pairs(members: DataFrame, hubs: DataFrame, most: int, percent: int) -> DataFrame:
    """Distinct pairs of members and hubs of their buckets that are not connected and whose bounds allow for the threshold."""
    c = F.col
    both = _at_most(c("n"), c("own"), c("pivot"), c("h_n"), c("h_own"), c("h_pivot"))
    first = F.coalesce(F.array_min(F.array_intersect("places", "h_places")) == c("bucket"), F.lit(True))
    close = lambda common: 100 * common >= percent * (c("n") + c("h_n") - common)
    closer = F.coalesce(close(_at_most_held(c("n"), c("own"), c("pivot"), c("held"), c("h_n"), c("h_own"), c("h_pivot"), c("h_held"))), F.lit(True))
    pairs = _met(members, hubs, most).filter((c("root") != c("h_root")) & close(both) & first & closer)
    return pairs.groupBy(F.least("node", "h_node").alias("u"), F.greatest("node", "h_node").alias("v")).agg(
        F.max((c("size") > CROWD) & c("pivot").isNull()).alias("crowded"))


def _candidates(pairs: DataFrame, signed: DataFrame, places: int, threshold: float) -> DataFrame:
    """Pairs that may be similar enough by their signatures."""
    c = F.col
    pairs = (pairs.join(signed.select(c("node").alias("u"), c("signature").alias("su")), "u")
             .join(signed.select(c("node").alias("v"), c("signature").alias("sv")), "v"))
    return stored(similar_signatures(pairs, places, threshold), "candidates")


def _with_texts(pairs: DataFrame, said: DataFrame) -> DataFrame:
    return (pairs.join(said.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u")
            .join(said.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v"))


def _pivoted(members: DataFrame, hubs: DataFrame, found: DataFrame) -> DataFrame:
    """Members with how many and which shingles they have in common with their bucket's first hub, where that was counted."""
    c = F.col
    with_hub = members.drop("pivot", "held").join(hubs.select("bucket", "h_node", "h_n"), "bucket", "left")
    common = found.select(c("u").alias("_u"), c("v").alias("_v"), "common", "of_u", "of_v")
    known = with_hub.join(common, (F.least("node", "h_node") == c("_u")) & (F.greatest("node", "h_node") == c("_v")), "left")
    pivot = F.when(c("node") == c("h_node"), c("h_n")).otherwise(c("common"))
    held = F.when(c("node") != c("h_node"), F.when(c("h_node") == c("_u"), c("of_u")).otherwise(c("of_v")))
    return known.select(*[x for x in members.columns if x not in ("pivot", "held")], pivot.alias("pivot"), held.alias("held"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: size of its set, smallest id of its component, the set's digest, and whether it stays.

    Of a component, rows with the smallest id stay; where several texts share that id, those of one set.
    """
    threshold = percent / 100
    bands = bands_for(threshold)
    places = bands * ROWS
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(shingled(docs, k, places), "shingled")
    classes = rows.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("key").alias("key"), F.min("doc_id").alias("label"), F.first("signature").alias("signature"))
    classes = stored(classes, "classes")

    members = stored(banded(classes, bands, ROWS), "bands")
    crowded = lambda m: m.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    members = members.join(crowded(members), "bucket").select("bucket", "node")
    keys = classes.join(members.select("node").distinct(), "node").select("key", "node", "signature")
    texts = docs.select(row_key("doc_id", "text").alias("key"), utf8("text").alias("text")).join(keys, "key").dropDuplicates(["node"])
    texts = stored(texts.select("node", "signature", "text"), "active-texts")

    able = own_shingles(texts, k).filter(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    members = stored(members.join(able, "node"), "able")
    members = members.join(crowded(members), "bucket").withColumn("company", F.sum("size").over(Window.partitionBy("node")))
    members = stored(members.withColumns({"pivot": F.lit(None).cast("bigint"), "held": F.lit(None).cast("array<bigint>"),
                                          "places": F.lit(None).cast("array<bigint>")}), "buckets")
    in_places = members.groupBy("node").agg(F.collect_list("bucket").alias("places"))

    signed, said = texts.select("node", "signature"), texts.select("node", "text")
    roots = None
    low, high = 0, 1
    while True:
        members = members.filter(F.col("size") >= low + 2)
        here = members.withColumn("root", F.col("node"))
        if roots is not None:
            here = members.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").drop("_n")
            here = here.withColumn("root", F.coalesce("root", "node"))
        open_ = here.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket")
        here = here.join(open_, "bucket", "left_semi")
        # in the first round every member meets the hub of each of its buckets; later a pair meets in one bucket only
        if low == 1:
            here = here.drop("places").join(in_places, "node")
        here = stored(here, "open")
        left, meets, largest = here.agg(F.count("*"), F.sum("size"), F.max("size")).first()
        if not left:
            break
        named = ["bucket", *[F.col(c).alias(f"h_{c}") for c in ("node", "root", "n", "own", "pivot", "held", "places", "size")]]
        pairs = None
        if low:
            members = here.drop("root")  # a bucket whose members are connected stays so
            if meets <= left * MEETS:
                pairs = stored(_pairs(here, here.select(named), largest, percent), "pairs")
                pairs = pairs if pairs.count() <= left * PAIRS else None
        if pairs is not None:
            high = largest
        else:
            order = [F.col("own") / F.col("n"), F.col("company").desc(), F.xxhash64("node"), F.col("node")]
            hubs = stored(first_per_key(here, ["bucket"], order, high, F.col("node")).select(named), "hubs")
            pairs = _pairs(here, hubs, high, percent)
        found = _candidates(pairs, signed, places, threshold)
        found = stored(compared_sets(_with_texts(found, said), k, percent), "compared")
        if not low:
            members = stored(_pivoted(members, hubs, found), "pivoted")
        links = found.filter("linked").select("u", "v")
        if roots is None or not links.isEmpty():
            if roots is not None:
                links = links.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
            roots = stored(components(links), "components")
        low, high = high, high * (GROWTH + 1)
    if roots is None:
        placed = classes.select("node", "label", F.col("key"), F.col("node").alias("root"))
    else:
        placed = classes.select("node", "label", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # the class with the smallest id stands for the component; without any id, the one with the smallest key
    lowest = placed.groupBy("root").agg(F.min("label").alias("component_id"), F.min(F.struct(F.col("label").isNull(), "label", "node")).alias("first"))
    label = placed.join(lowest, "root").select("node", "component_id", (F.col("node") == F.col("first.node")).alias("leads"))
    out = rows.select("doc_id", "n_shingles", "node", "key").join(label, "node", "left")
    component = F.coalesce("component_id", "doc_id")
    stays = F.when(F.col("node").isNull(), True).when(component.isNull(), F.col("leads")).otherwise(F.col("doc_id").eqNullSafe(component) & F.col("leads"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "node", "key", stays.alias("stays"))


def one_per_group(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, with one of each group of near duplicates: the one with the smallest id.

    Documents without words are kept.  Rows equal in id and text are one document.
    """
    stay = near_duplicates(docs, k, percent, doc_id, text).filter("stays").groupBy("key").agg(F.count("*").alias("times"))
    keyed = docs.select(F.struct("*").alias("row"), row_key(doc_id, text).alias("key"))
    kept = keyed.join(stay, "key").dropDuplicates(["key"])
    return kept.select("row.*")

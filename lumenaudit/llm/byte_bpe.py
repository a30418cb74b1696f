"""Byte-level BPE with a rank queue under a hierarchical bitmap.

Texts are split by the tokenizer's pattern.  Pieces that are new to the worker
and no token by themselves are merged together: the positions of all of them
form one linked list with gaps between pieces.  A pair of neighbours that some
token spells waits in the bucket of that token's rank; a bitmap of several
levels, 64 bits a word, marks the buckets that hold any.  Find-first-set gives
the lowest rank; its positions merge from left to right, a large bucket at once,
and their new pairs go into buckets again.  Entries whose pair has changed
meanwhile are stale and skipped, so nothing is searched in a bucket and long
pieces cost about as much per byte as short ones.

Results in odd cases: a null text is empty and has no ids; bytes that are not
UTF-8 count as U+FFFD; other columns are ignored; equal rows give equal rows; an
empty table gives an empty table.  Nothing is shuffled.  Texts are read whole,
in windows cut only where the pattern ends a piece whatever follows.  A worker
remembers pieces up to ``REMEMBERED`` bytes; the vocabulary is loaded once per
worker, as a broadcast object that carries its path only.
"""

from __future__ import annotations

import base64
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import map_texts, utf8

TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN

#: Bytes of pieces that a worker remembers, and the most pieces.
REMEMBERED, MOST = 1 << 23, 1 << 19
#: Characters of a text that are split at once.
WINDOW = 1 << 18
#: A piece's end depends on less than this many characters behind it.
LOOKAHEAD = 4
#: Bits of an id in the key of a pair.
ID_BITS = 24
#: Buckets with fewer positions are merged one by one.
FEW = 200
#: Bytes of texts that are encoded together.
TOGETHER = 1 << 21
#: Texts of characters below this one are split by a pattern with all classes spelled out, which finds the same pieces in less time.
PLAIN = 0x250


def spelled_out(pattern: str, below: int = PLAIN) -> str:
    """The pattern with its classes as lists of the characters under ``below``."""
    def listed(test):
        return "".join(f"\\u{c:04x}" for c in range(below) if test(chr(c)))

    classes = {c: listed(regex.compile(c).match) for c in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside = [], False
    for part in regex.findall(r"\\p\{\w\}|\\[sS]|\\.|.", pattern, regex.DOTALL):
        if part in classes:
            part = classes[part] if inside else f"[{classes[part]}]"
        elif part == r"\S":
            part = f"[^{classes[chr(92) + 's']}]"
        elif part in "[]":
            inside = part == "["
        out.append(part)
    return "".join(out)


class RankQueue:
    """Buckets of positions per rank; the lowest rank in use is found through a bitmap of bitmaps."""

    def __init__(self, n_ranks: int):
        self.levels = []
        while True:
            n_ranks = (n_ranks + 63) >> 6
            self.levels.append([0] * n_ranks)
            if n_ranks <= 1:
                break
        self.buckets: dict[int, array] = {}

    def bucket(self, rank: int) -> array:
        bucket = self.buckets.get(rank)
        if bucket is None:
            bucket = self.buckets[rank] = array("i")
            for level in self.levels:
                word = level[rank >> 6]
                level[rank >> 6] = word | 1 << (rank & 63)
                if word:
                    break
                rank >>= 6
        return bucket

    def push(self, rank: int, place: int) -> None:
        self.bucket(rank).append(place)

    def push_all(self, ranks: np.ndarray, places: np.ndarray) -> None:
        if len(ranks) < 32:
            for rank, place in zip(ranks.tolist(), places.tolist()):
                self.bucket(rank).append(place)
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order].astype(np.int32)
        edges = np.flatnonzero(np.diff(ranks, prepend=-1))
        for rank, a, b in zip(ranks[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(ranks)]):
            self.bucket(rank).frombytes(places[a:b].tobytes())

    def pop(self) -> tuple[int, array] | None:
        """The lowest rank and its positions."""
        if not self.buckets:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        return rank, self.buckets.pop(rank)


class Merge:
    """Merging of some pieces, laid out one behind the other."""

    def __init__(self, codec: Codec, pieces: list[bytes]):
        self.codec, self.n = codec, sum(map(len, pieces))
        self.ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        n, starts = self.n, np.concatenate([[0], self.ends[:-1]])
        #: The lists: one by one as arrays, at once as views of the same memory.
        self.ids = array("i", codec.single[np.frombuffer(b"".join(pieces), np.uint8)].tobytes())
        self.after, self.before = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes()), array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        self.all_ids, self.all_after, self.all_before = (np.frombuffer(x, np.int32) for x in (self.ids, self.after, self.before))
        self.all_after[self.ends - 1], self.all_before[starts] = n, -1
        self.queue = RankQueue(len(codec.tokens))
        places = np.flatnonzero(self.all_after < n)
        self.push_pairs(places, places + 1)

    def rank_of(self, left, right) -> np.ndarray:
        return self.codec.ranks_of(np.asarray(left, np.int64) << ID_BITS | right)

    def push_pairs(self, left: np.ndarray, right: np.ndarray) -> None:
        ranks = self.rank_of(self.all_ids[left], self.all_ids[right])
        known = ranks >= 0
        self.queue.push_all(ranks[known], left[known])

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        while (lowest := self.queue.pop()) is not None:
            rank, places = lowest
            if len(places) < FEW or not self.at_once(rank, np.frombuffer(places, np.int32)):
                self.one_by_one(rank, sorted(places))
        alive = self.all_ids >= 0
        return self.all_ids[alive], np.diff(np.cumsum(alive)[self.ends - 1], prepend=0)

    def one_by_one(self, rank: int, places: list[int]) -> None:
        n, ids, after, before, pairs, push = self.n, self.ids, self.after, self.before, self.codec.pairs, self.queue.push
        for k, i in enumerate(places):
            j = after[i]
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << ID_BITS | ids[j]) != rank:
                continue  # stale
            ids[i], ids[j] = rank, -1
            after[i] = behind = after[j]
            least = rank
            if behind < n:
                before[behind] = i
                made = pairs.get(rank << ID_BITS | ids[behind])
                if made is not None:
                    push(made, i)
                    least = min(least, made)
            front = before[i]
            if front >= 0:
                made = pairs.get(ids[front] << ID_BITS | rank)
                if made is not None:
                    push(made, front)
                    least = min(least, made)
            if least < rank:  # a vocabulary may rank a token before its parts
                for rest in places[k + 1:]:
                    push(rank, rest)
                break

    def at_once(self, rank: int, i: np.ndarray) -> bool:
        """The same for many positions; False, with nothing done, if a new pair might come before ``rank``."""
        n, ids, after, before = self.n, self.all_ids, self.all_after, self.all_before
        i = np.sort(i)
        i = i[(ids[i] >= 0) & (after[i] < n) & (np.diff(i, prepend=-1) > 0)]
        j = after[i]
        live = self.rank_of(ids[i], ids[j]) == rank
        i, j = i[live], j[live]
        if not len(i):
            return True
        # Of pairs that overlap in a row, every second one goes stale.
        linked = np.concatenate([[False], i[1:] == j[:-1]])
        at = np.arange(len(i))
        even = (at - np.maximum.accumulate(np.where(linked, 0, at))) % 2 == 0
        i, j = i[even], j[even]
        behind, front = after[j], before[i]
        has_behind, has_front = behind < n, front >= 0
        new = np.concatenate([self.rank_of(rank, ids[behind[has_behind]]), self.rank_of(ids[front[has_front]], rank), self.rank_of([rank], [rank])])
        if ((new >= 0) & (new < rank)).any():
            return False
        ids[i], ids[j], after[i] = rank, -1, behind
        before[behind[has_behind]] = i[has_behind]
        front = before[i]
        self.push_pairs(np.concatenate([i[has_behind], front[has_front]]), np.concatenate([behind[has_behind], i[has_front]]))
        return True


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, one behind the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Codec:
    """A vocabulary of ranked byte strings, loaded where it is first used."""

    def __init__(self, path: str = TOKENIZER, pattern: str = PATTERN, ranks: dict[bytes, int] | None = None):
        self.path, self.pattern, self.ranks, self.tokens = path, pattern, ranks, None

    def __reduce__(self):
        return Codec, (self.path, self.pattern, None if self.path else self.ranks)

    def load(self) -> Codec:
        if self.tokens is not None:
            return self
        if self.ranks is None:
            with open(self.path, "rb") as lines:
                self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        ranks = self.ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.spelled = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.single < 0).any():
            raise ValueError("the vocabulary must hold every byte")
        # Every way to put a token together from two others.
        self.pairs = {a << ID_BITS | b: rank for token, rank in ranks.items() for i in range(1, len(token))
                      if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None}
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.made = np.array([self.pairs[k] for k in self.keys.tolist()], np.int32)
        self.find = regex.compile(self.pattern).findall
        self.find_plain = re.compile(spelled_out(self.pattern)).findall
        self.odd = re.compile(f"[^\\x00-\\u{PLAIN - 1:04x}]").search
        self.forget()
        return self

    def forget(self) -> None:
        """Pieces known so far: a number for each, their ids one behind the other."""
        self.memory: dict[str, int] = {}
        self.known, self.first, self.many, self.held = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def ranks_of(self, keys: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair spells, else -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.made[at], -1)

    def split(self, text: str) -> list[str]:
        """The pieces of a text."""
        find = self.find if self.odd(text) else self.find_plain
        out, at, width = [], 0, WINDOW
        while at < len(text):
            end = min(at + width, len(text))
            found = find(text, at, end)
            if end < len(text):
                back = 0
                while found and back < LOOKAHEAD:
                    back += len(found.pop())
                if not found:
                    width *= 2
                    continue
                end -= back
            out += found
            at, width = end, WINDOW
        return out

    def learn(self, new: list[str]) -> None:
        """Finds the ids of new pieces."""
        spelled = [p.encode() for p in new]
        whole = [self.ranks.get(p, -1) for p in spelled]
        parts = [p for p, rank in zip(spelled, whole) if rank < 0]
        flat, many = Merge(self, parts).run() if parts else (np.empty(0, np.int32), np.empty(0, np.int64))
        alone = np.array(whole, np.int32) >= 0
        counts = np.ones(len(new), np.int64)
        counts[~alone] = many
        ids = np.empty(int(counts.sum()), np.int32)
        is_alone = np.repeat(alone, counts)
        ids[is_alone], ids[~is_alone] = np.array(whole, np.int32)[alone], flat
        self.first = np.concatenate([self.first, len(self.known) + np.cumsum(counts) - counts])
        self.many, self.known = np.concatenate([self.many, counts]), np.concatenate([self.known, ids])
        self.memory.update(zip(new, range(len(self.memory), len(self.memory) + len(new))))
        self.held += sum(map(len, spelled))

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one behind the other, and how many each has."""
        self.load()
        pieces, sizes = [], []
        for text in texts:
            found = self.split(text)
            pieces += found
            sizes.append(len(found))
        new = sorted(set(pieces).difference(self.memory))
        if self.held > REMEMBERED or len(self.memory) > MOST:
            self.forget()
            new = sorted(set(pieces))
        if new:
            self.learn(new)
        numbers = np.fromiter(map(self.memory.__getitem__, pieces), np.int64, len(pieces))
        many = self.many[numbers]
        before = np.concatenate([[0], np.cumsum(many)])
        return gather(self.known, self.first[numbers], many), np.diff(before[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])])

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that the ids of all texts spell, and how many each has."""
        self.load()
        sizes = self.sizes[ids]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return gather(self.spelled, self.starts[ids], sizes), np.diff(before[np.concatenate([[0], np.cumsum(counts)])])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.load().tokens.__getitem__, ids))


def _listed(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    if kind == pa.binary():
        return pa.Array.from_buffers(kind, len(counts), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(flat))])
    return pa.ListArray.from_arrays(ends, pa.array(flat, kind.value_type))


def encode(docs: DataFrame, codec: Codec | None = None, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``ids`` and, if asked for, ``decoded``: the bytes that the ids spell."""
    shared = docs.sparkSession.sparkContext.broadcast(codec or Codec())

    def run(texts, rest):
        codec = shared.value
        ids, counts = codec.encode_all([t.decode("utf-8", "replace") for t in texts])
        columns = [rest["doc_id"], _listed(ids, counts, pa.list_(pa.int32()))]
        if decoded:
            columns.append(_listed(*codec.decode_all(ids, counts), pa.binary()))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][:len(columns)])

    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), utf8(text).alias("text"))
    return map_texts(plain, run, "doc_id bigint, ids array<int>" + ", decoded binary" * decoded, limit=TOGETHER)


def decode(rows: DataFrame, codec: Codec | None = None, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of ids: ``doc_id`` and ``decoded``; null ids are none."""
    shared = rows.sparkSession.sparkContext.broadcast(codec or Codec())

    def run(batches):
        for batch in batches:
            column = batch.column("ids")
            counts = np.array([len(i) if i.is_valid else 0 for i in column], np.int64)
            spelled = shared.value.decode_all(column.flatten().to_numpy(), counts)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _listed(*spelled, pa.binary())], ["doc_id", "decoded"])

    plain = rows.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return plain.mapInArrow(run, "doc_id bigint, decoded binary")

"""SentencePiece segmentations sampled without replacement, and decoding.

A text is a lattice whose edges are the vocabulary's pieces; their weights come
from the ranks of the vocabulary (log-probability of rank r: minus log(r + 10),
normalised), so a segmentation's weight is the sum of its pieces'.  Pieces do
not cross the space in front of a word, so the lattice is a chain of small ones,
one per word.  Backward sums over the distinct words of a chunk turn edge
weights into conditional probabilities.

Gumbel top-k: the root gets a Gumbel value, the best child keeps its parent's
value and the other children get truncated ones.  A-star pops the node with the
largest value and dives to a leaf along best children, whose draws are plain
samples of the conditional probabilities; the siblings passed on the way are
the frontier.  The k-th popped leaf is the k-th sample without replacement, so
all samples of a text differ.  The value left on top of the frontier gives the
inclusion scores, 1 - exp(-exp(log_prob - top)), 1 when nothing is left.
Siblings are listed until the probability of the path falls under ``FLOOR``,
where what remains is less than the rounding error of the whole.

All draws are hashes of the row's key, sample, word and step: equal keys and
texts give equal samples wherever and how often they run.

Results in odd cases: null and empty texts are the piece of the leading space
alone; a text with fewer than k segmentations gives fewer rows, each with
inclusion 1; characters outside the vocabulary are bytes; control bytes and the
literal mark of the vocabulary's space decode to themselves.  Other columns are
ignored; an empty table gives an empty result; texts are read whole, and a word
of any length is one lattice, whose nodes take one step each.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenaudit.llm.common import map_texts, utf8
from lumenaudit.llm.rolling import U, mix, powers, prefix, ranges

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
FLOOR = -40.0
BYTE_LOG = -25.0
CHUNK = 5 << 18
_SLOTS = 1 << 21
_ALL = (1 << 64) - 1
_MARK = "▁"
_CHAR = np.ones(256, np.int64)
_CHAR[0xC0:0xE0], _CHAR[0xE0:0xF0], _CHAR[0xF0:] = 2, 3, 4


class Vocabulary:
    """Pieces, weights and a hash table of their prefixes, loaded where first used."""

    def __init__(self, path: str):
        self.path, self.ready = path, False

    def __reduce__(self):
        return Vocabulary, (self.path,)

    def load(self) -> Vocabulary:
        if self.ready:
            return self
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=self.path)
        n = model.get_piece_size()
        self.bytes_of = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        rank = np.full(n, np.inf)
        by_text: dict[bytes, int] = {}
        for i in range(n):
            said = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(said[3:-1], 16)
                self.byte_id[value], self.bytes_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes_of[i] = said.replace(_MARK, " ").encode()
                by_text[self.bytes_of[i]] = i
                rank[i] = min(-model.get_score(i), 1e6)
        weight = -np.log(rank + 10)
        known = np.isfinite(rank)
        self.weight = np.where(known, weight - np.log(np.exp(weight[known]).sum()), BYTE_LOG)
        self.sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.joined = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.longest = max(map(len, by_text))
        heads = {p[:k]: -1 for p in by_text for k in range(1, len(p))} | by_text
        keys = list(heads)
        buffer = np.frombuffer(b"".join(keys), np.uint8)
        ends = np.cumsum([len(k) for k in keys])
        h = ranges(prefix(buffer), np.concatenate([[0], ends[:-1]]), ends)
        values = np.array([heads[k] for k in keys], np.int32)
        slot = (h & U(_SLOTS - 1)).astype(np.int64)
        _, first = np.unique(slot, return_index=True)
        self.slot_hash, self.slot_value = np.zeros(_SLOTS, U), np.full(_SLOTS, -2, np.int32)
        self.slot_hash[slot[first]], self.slot_value[slot[first]] = h[first], values[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(h[rest])]
        self.more_hash, self.more_value = h[rest], values[rest]
        self.ready = True
        return self

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 for a mere beginning of pieces, -2 for neither."""
        slot = (h & U(_SLOTS - 1)).astype(np.int64)
        out = np.where(self.slot_hash[slot] == h, self.slot_value[slot], np.int32(-2))
        if len(self.more_hash):
            odd = np.flatnonzero((out == -2) & (self.slot_value[slot] != -2))
            at = np.minimum(np.searchsorted(self.more_hash, h[odd]), len(self.more_hash) - 1)
            out[odd] = np.where(self.more_hash[at] == h[odd], self.more_value[at], -2)
        return out

    def spell(self, ids: np.ndarray, offsets) -> list[str]:
        """The texts of rows of ids laid out one behind the other, without the leading space."""
        out = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            flat = ids[a:b]
            size = self.sizes[flat]
            ends = np.cumsum(size)
            source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[flat] - ends + size, size)
            out.append(self.joined[source].tobytes()[1:].decode("utf-8", "replace"))
        return out


def split_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer of all texts with a space in front; starts and ends of units, and each text's first unit."""
    codes = np.frombuffer(b"".join(b" " + t for t in texts), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    space = codes == 0x20
    head = np.zeros(len(codes), bool)
    head[1:] = space[1:] & ~space[:-1]
    head[begin[:-1]] = True
    starts = np.flatnonzero(head)
    return codes, starts, np.append(starts[1:], len(codes)), np.searchsorted(starts, begin)


class Lattice:
    """Edges of the lattices of distinct units, with their conditional probabilities."""

    def __init__(self, vocabulary: Vocabulary, units: list[bytes]):
        codes = np.frombuffer(b"\xff".join(units) + b"\xff", np.uint8)
        sizes = np.array([len(u) for u in units], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        last = self.first + sizes
        left = np.repeat(last, sizes + 1) - np.arange(len(codes))
        sums, back = prefix(codes), powers(len(codes) + 1, -1)
        lead = ((codes & 0xC0) != 0x80) & (left > 0)
        alive, at, length, piece = np.flatnonzero(lead), [], [], []
        covered = np.zeros(len(codes), bool)
        for n in range(1, vocabulary.longest + 1):
            alive = alive[left[alive] >= n]
            if not len(alive):
                break
            found = vocabulary.find(mix((sums[alive + n] - sums[alive]) * back[alive]))
            alive, found = alive[found != -2], found[found != -2]
            here = alive[found >= 0]
            at.append(here)
            length.append(n)
            piece.append(found[found >= 0])
            covered[here[_CHAR[codes[here]] == n]] = True
        bare = np.flatnonzero(lead & ~covered)
        for k in range(4):
            here = bare[(_CHAR[codes[bare]] > k) & (left[bare] > k)] + k
            at.append(here)
            length.append(1)
            piece.append(vocabulary.byte_id[codes[here]])
        # edges are laid out node by node, nodes by their distance from the unit's end
        degree = np.zeros(len(codes), np.int32)
        for here in at:
            degree[here] += 1
        nodes = np.argsort(left.astype(np.min_scalar_type(int(left.max(initial=0)))), kind="stable")
        nodes = nodes[degree[nodes] > 0]
        ends = np.cumsum(degree[nodes])
        self.degree, self.begin = degree, np.zeros(len(codes), np.int32)
        self.begin[nodes] = ends - degree[nodes]
        total = int(ends[-1]) if len(ends) else 0
        self.at, self.target, self.piece = np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total, np.int32)
        slot = self.begin + degree  # longest pieces first
        for here, n, which in zip(at, length, piece):
            slot[here] -= 1
            e = slot[here]
            self.at[e], self.target[e], self.piece[e] = here, here + n, which
        value = vocabulary.weight[self.piece]
        beta = np.full(len(codes), -np.inf)
        beta[last] = 0.0
        bounds = np.searchsorted(left[nodes], np.arange(1, (int(left.max()) if len(left) else 0) + 2))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if a == b:
                continue
            i, j = int(ends[a] - degree[nodes[a]]), int(ends[b - 1])
            value[i:j] += beta[self.target[i:j]]
            cuts, n = self.begin[nodes[a:b]] - i, degree[nodes[a:b]]
            top = np.maximum.reduceat(value[i:j], cuts)
            beta[nodes[a:b]] = top + np.log(np.add.reduceat(np.exp(value[i:j] - np.repeat(top, n)), cuts))
        value -= beta[self.at]
        self.log_prob = value
        mass = np.exp(self.log_prob)
        np.cumsum(mass, out=mass)
        mass -= np.repeat(np.concatenate([[0.0], mass[ends[:-1] - 1]]) if len(ends) else ends, degree[nodes])
        self.upto = mass
        self.upto[ends - 1] = 2.0
        self.closes = left[self.target] == 0

    def pick(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Edge drawn at each node."""
        e = self.begin[node]
        late = np.flatnonzero(u >= self.upto[e])
        while len(late):
            e[late] += 1
            late = late[u[late] >= self.upto[e[late]]]
        return e

    def pick_one(self, node: int, u: float) -> int:
        e = int(self.begin[node])
        while u >= self.upto[e]:
            e += 1
        return e

    def paths(self, unit: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A drawn path for each unit: all edges in order, and where each unit's begin."""
        node, who, step = self.first[unit], np.arange(len(unit)), 0
        picked, owners = [], []
        while len(who):
            e = self.pick(node, uniform(seed[who] + U(step)))
            picked.append(e)
            owners.append(who)
            open_ = ~self.closes[e]
            node, who, step = self.target[e][open_], who[open_], step + 1
        count = np.zeros(len(unit) + 1, np.int64)
        for who in owners:
            count[who + 1] += 1
        offsets = np.cumsum(count)
        out = np.empty(offsets[-1], np.int64)
        for t, (e, who) in enumerate(zip(picked, owners)):
            out[offsets[who] + t] = e
        return out, offsets


def uniform(seed: np.ndarray) -> np.ndarray:
    """Draws in (0, 1) from seeds."""
    return ((mix(seed * U(0x9E3779B97F4A7C15)) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _draw(seed: int, n: int) -> float:
    """One draw in (0, 1)."""
    h = (seed + n * 0xD1B54A32D192ED03) & _ALL
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & _ALL
    return (((h ^ (h >> 31)) >> 11) + 0.5) * 2.0**-53


def _greatest(value: np.ndarray, group: np.ndarray, keep: int) -> np.ndarray:
    """Indexes of the ``keep`` greatest values of each group; equal groups stand together."""
    if not len(value):
        return np.empty(0, np.int64)
    begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    left, found = np.arange(len(value)), []
    for _ in range(keep):
        top = np.maximum.reduceat(value, begins)
        sizes = np.diff(np.append(begins, len(value)))
        hit = np.flatnonzero(value == np.repeat(top, sizes))
        _, one = np.unique(np.searchsorted(begins, hit, "right"), return_index=True)
        found.append(left[hit[one]])
        stay = np.ones(len(value), bool)
        stay[hit[one]] = False
        value, left = value[stay], left[stay]
        begins = (begins - np.arange(len(begins)))[sizes > 1]
        if not len(begins):
            break
    return np.concatenate(found)


def _siblings(lattice: Lattice, paths: list[np.ndarray], starts: list[int], phi: np.ndarray, value: np.ndarray, seeds: np.ndarray,
              keep: int, size: int = 96) -> list[list[tuple]]:
    """The ``keep`` best unexplored nodes beside each path from its start on: (value, phi, step, edge)."""
    parts = [p[s:s + size] for p, s in zip(paths, starts)]
    n = np.array([len(p) for p in parts])
    cut = np.array([len(p) - s > size for p, s in zip(paths, starts)], bool)
    out: list[list[tuple]] = [[] for _ in paths]
    steps = np.concatenate(parts) if parts else np.empty(0, np.int64)
    if len(steps):
        first = np.cumsum(n) - n
        of = np.repeat(np.arange(len(parts)), n)
        gone = np.concatenate([[0.0], np.cumsum(lattice.log_prob[steps])])
        before = phi[of] + gone[:-1] - gone[first[of]]
        full = n > 0
        cut[full] &= before[(first + n - 1)[full]] >= FLOOR  # the path is still likely where the part ends
        at = np.flatnonzero((before >= FLOOR) & ~cut[of])
        degree = lattice.degree[lattice.at[steps[at]]]
        step = np.repeat(at, degree)
        edge = np.arange(len(step)) - np.repeat(np.cumsum(degree) - degree, degree) + np.repeat(lattice.begin[lattice.at[steps[at]]], degree)
        other = edge != steps[step]
        step, edge = step[other], edge[other]
        mass = before[step] + lattice.log_prob[edge]
        whose = of[step]
        u = uniform(seeds[whose] + (step - first[whose]).astype(U) * U(1 << 20) + (edge - lattice.begin[lattice.at[edge]]).astype(U))
        limited = mass - np.log(np.exp(mass - value[whose]) - np.log(u))
        best = _greatest(limited, whose, keep)
        for d, i in zip(whose[best].tolist(), best.tolist()):
            out[d].append((float(limited[i]), float(mass[i]), starts[d] + int(step[i] - first[d]), int(edge[i])))
    again = np.flatnonzero(cut)
    if len(again):
        deeper = _siblings(lattice, [paths[d] for d in again], [starts[d] for d in again], phi[again], value[again], seeds[again], keep, size * 8)
        for d, found in zip(again.tolist(), deeper):
            out[d] = found
    return out


def segmentations(lattice: Lattice, drawn: list[tuple[np.ndarray, np.ndarray]], first: np.ndarray, seeds: np.ndarray,
                  k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Up to ``k`` distinct segmentations of each text: edges, log-probability, perturbed value, inclusion.

    All texts take their s-th sample side by side; ``first`` holds the first unit of each text, ``drawn`` a path per unit and sample.
    """
    n = len(first) - 1
    found: list[list[tuple]] = [[] for _ in range(n)]
    frontier: list[list[tuple]] = [[] for _ in range(n)]
    edges, offsets = drawn[0]
    paths = [edges[offsets[first[d]]:offsets[first[d + 1]]] for d in range(n)]
    roots = mix(seeds + U(1))
    values = (-np.log(-np.log(uniform(roots)))).tolist()
    phis, starts, live = [0.0] * n, [0] * n, list(range(n))
    for s in range(1, k + 1):
        sides = _siblings(lattice, [paths[d] for d in live], [starts[d] for d in live], np.array([phis[d] for d in live]),
                          np.array([values[d] for d in live]), mix(seeds[live] + U(s << 32)), k + 2 - s)
        still = []
        for d, side in zip(live, sides):
            path = paths[d]
            found[d].append((path, float(lattice.log_prob[path].sum()), values[d]))
            for node in side:
                heapq.heappush(frontier[d], (-node[0], s, node[2], node[3], node[1], path))
            if s == k or not frontier[d]:
                continue
            value, _, step, edge, phi, parent = heapq.heappop(frontier[d])
            new, at = [edge], edge
            while not lattice.closes[at]:
                at = lattice.pick_one(int(lattice.target[at]), _draw(int(seeds[d]), 1000 * s + len(new)))
                new.append(at)
            done = int(first[d] + lattice.closes[parent[:step]].sum() + 1)
            edges, offsets = drawn[s]
            paths[d] = np.concatenate([parent[:step], np.array(new, np.int64), edges[offsets[done]:offsets[first[d + 1]]]])
            values[d], phis[d], starts[d] = -value, phi, step + 1
            still.append(d)
        live = still
    out = []
    for d in range(n):
        top = -frontier[d][0][0] if frontier[d] else -np.inf
        out.append([(p, q, v, float(-math.expm1(-math.exp(min(q - top, 700.0))))) for p, q, v in found[d]])
    return out


def encode(docs: DataFrame, k: int = SAMPLES, model: str = MODEL, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Up to ``k`` rows per document: sample, ids, log_prob, perturbed, inclusion and, if asked for, the ``text`` that the ids spell."""
    vocabulary = Vocabulary(model)
    names = ["doc_id", "sample", "ids", "log_prob", "perturbed", "inclusion"] + ["text"] * decoded

    def run(texts, rest):
        v = vocabulary.load()
        codes, starts, ends, first = split_units(texts)
        _, where, unit = np.unique(ranges(prefix(codes), starts, ends), return_index=True, return_inverse=True)
        lattice = Lattice(v, [codes[s:e].tobytes() for s, e in zip(starts[where].tolist(), ends[where].tolist())])
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        place = (np.arange(len(starts)) - first[owner]).astype(U)
        seeds = np.array(rest["seed"].to_pylist(), np.int64).view(U)
        drawn = []
        for s in range(k):
            drawn.append(lattice.paths(unit, mix(mix(seeds[owner] + U(s + 1)) + place)))
        sampled = segmentations(lattice, drawn, first, seeds, k)
        row, sample, ids, numbers = [], [], [], []
        for d in range(len(texts)):
            for s, (path, *scores) in enumerate(sampled[d]):
                row.append(d)
                sample.append(s + 1)
                ids.append(lattice.piece[path])
                numbers.append(scores)
        offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        joined = pa.array(flat, pa.int32())
        log_prob, value, inclusion = np.array(numbers, np.float64).reshape(-1, 3).T
        return pa.RecordBatch.from_arrays(
            [rest["doc_id"].take(pa.array(row, pa.int64())), pa.array(sample, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), joined),
             pa.array(log_prob), pa.array(value), pa.array(inclusion), *([pa.array(v.spell(flat, offsets), pa.string())] * decoded)], names)

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(doc_id).alias("seed"), utf8(text).alias("text"))
    made = "doc_id bigint, sample int, ids array<int>, log_prob double, perturbed double, inclusion double" + ", text string" * decoded
    return map_texts(rows, run, made, limit=CHUNK)


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with the text of their ids in place of any column ``text``."""
    vocabulary = Vocabulary(model)
    rows = rows.drop(text)

    def run(batches):
        v = vocabulary.load()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                said = [v.spell(f := one.values.to_numpy(), [0, len(f)])[0] for one in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(said, pa.string())], [*part.schema.names, text])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, (text, "string")]))

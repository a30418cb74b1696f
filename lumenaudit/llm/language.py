"""Language identification of mixed-language texts.

A model of hashed byte trigrams is counted from labelled rows.  Script ranges
narrow the languages a word may have, words get a log-likelihood per language,
and Viterbi with a penalty for each switch labels the spans of a text.  The
language with most letters over its spans is the prediction, its share the score.

Results in odd cases: a null text, one without a letter, or a model without
languages gives ``und`` with score 0 and no spans; rows with a null or no
language teach nothing.  Equal likelihoods go to the language first in order.
Equal rows give equal rows; other columns are ignored; whole texts are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenaudit.llm.common import map_texts
from lumenaudit.llm.rolling import Words

UNKNOWN = "und"
#: Trigrams are hashed to so many buckets: the model's size per language.
BUCKETS = 1 << 16
#: About so many labelled rows of each language are fitted on, chosen by a hash of the row.
FIT_ROWS = 6000
SWITCH_PENALTY = 12.0
#: A language has a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.002

#: First bytes of UTF-8 sequences, by script (fixed values of the encoding).
SCRIPTS = (("latin", 0x61, 0x7A), ("latin", 0xC3, 0xCA), ("greek", 0xCD, 0xCF), ("cyrillic", 0xD0, 0xD4), ("hebrew", 0xD6, 0xD7),
           ("arabic", 0xD8, 0xDB), ("indic", 0xE0, 0xE0), ("other", 0xE1, 0xE2), ("kana", 0xE3, 0xE3), ("han", 0xE4, 0xE9),
           ("hangul", 0xEA, 0xED))
SCRIPT_NAMES = tuple(dict.fromkeys(name for name, _, _ in SCRIPTS))

_ALPHA = np.zeros(256, np.uint8)
_ALPHA[0x61:0x7B] = _ALPHA[0x41:0x5B] = np.arange(0x61, 0x7B)
_ALPHA[0x80:] = np.arange(0x80, 0x100)
_SCRIPT = np.zeros(256, np.int32)
for _name, _low, _high in SCRIPTS:
    _SCRIPT[_low:_high + 1] = SCRIPT_NAMES.index(_name)
_LEAD = np.zeros(256, bool)
_LEAD[0x61:0x7B] = True
_LEAD[0xC0:] = True


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    scores: np.ndarray   # language x bucket, log probabilities
    scripts: np.ndarray  # language x script, may be written in it


def _buckets(words: Words) -> np.ndarray:
    """Bucket of the trigram around each byte; blanks are zero bytes."""
    c = words.codes.astype(np.uint32)
    before, after = np.concatenate([[np.uint32(0)], c[:-1]]), np.concatenate([c[1:], [np.uint32(0)]])
    return (((before << np.uint32(16)) | (c << np.uint32(8)) | after) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _lower(text: str) -> Column:
    return F.coalesce(F.lower(F.col(text)).cast("binary"), F.lit(b"").cast("binary"))


def fit(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Counts trigrams and scripts of about ``FIT_ROWS`` rows per language.

    The share taken of each language follows from its number of rows, so large
    languages are thinned by a hash and small ones are taken whole.
    """
    rows = docs.filter(train & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), _lower(text).alias("text"), F.pmod(F.xxhash64(doc_id, text), F.lit(1 << 20)).alias("part"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model((), np.zeros((0, BUCKETS)), np.zeros((0, len(SCRIPT_NAMES)), bool))
    thinned = [(name, (1 << 20) * FIT_ROWS // n) for name, n in sorted(sizes.items()) if n > FIT_ROWS]
    for name, part in thinned:
        rows = rows.filter((F.col("lang") != F.lit(name)) | (F.col("part") < part))

    def count(texts, rest):
        words = Words(texts, _ALPHA)
        bucket, inside = _buckets(words), words.codes != 0
        script = BUCKETS + _SCRIPT[words.codes]
        owner = np.searchsorted(words.text_start[1:], np.arange(len(words.codes)), side="right")
        names, of = np.unique(np.array(rest["lang"].to_pylist(), dtype=object), return_inverse=True)
        size, out = BUCKETS + len(SCRIPT_NAMES), []
        for k, name in enumerate(names):
            mine = inside & (of[np.minimum(owner, len(of) - 1)] == k)
            n = np.bincount(bucket[mine], minlength=size) + np.bincount(script[mine & _LEAD[words.codes]], minlength=size)
            at = np.flatnonzero(n)
            out.append((pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))))
        return pa.RecordBatch.from_arrays([pa.concat_arrays([o[i] for o in out]) for i in range(3)], ["lang", "bucket", "n"])

    counted = map_texts(rows.select("lang", "text"), count, "lang string, bucket int, n bigint")
    counts = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()  # at most languages x buckets
    names = tuple(sorted(sizes))
    matrix = np.zeros((len(names), BUCKETS + len(SCRIPT_NAMES)))
    index = {n: i for i, n in enumerate(names)}
    for r in counts:
        matrix[index[r["lang"]], r["bucket"]] = r["n"]
    grams, scripts = matrix[:, :BUCKETS] + 0.5, matrix[:, BUCKETS:]
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    return Model(names, np.log(grams / grams.sum(1, keepdims=True)).astype(np.float32), share >= SCRIPT_SHARE)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Log-likelihood of each word by language; scripts a language is not written in rule it out."""
    bucket = _buckets(words)
    out = np.empty((len(words.starts), len(model.languages)))
    for k in range(len(model.languages)):
        total = np.concatenate([[0.0], np.cumsum(model.scores[k][bucket], dtype=np.float64)])
        out[:, k] = total[words.ends] - total[words.starts]
    if len(words.starts):
        letters = np.where(_LEAD[words.codes], _SCRIPT[words.codes], 0)
        edges = np.stack([words.starts, words.ends], 1).ravel()
        script = np.maximum.reduceat(np.append(letters, 0), edges)[::2]
        allowed = model.scripts.T[script]
        allowed |= ~allowed.any(1, keepdims=True)
        out[~allowed] = -1e6
    return out


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of each word, all texts side by side.

    ``first`` holds each text's first word and the end; texts are sorted by length,
    so those that still have words are a prefix at every step.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    labels = np.zeros(len(scores), np.int16)
    if not len(n) or not n[0]:
        return labels
    active = np.searchsorted(-n, -np.arange(n[0]), side="left")
    stay = np.ones(scores.shape, bool)
    came = np.zeros(len(scores), np.int16)
    state = scores[begin[:active[0]]]
    final = np.zeros(len(n), np.int16)
    for t in range(1, int(n[0]) + 1):
        k = int(active[t]) if t < n[0] else 0
        if k < len(state):
            final[k:len(state)] = state[k:].argmax(1)
            state = state[:k]
        if not k:
            break
        at = begin[:k] + t
        best = state.argmax(1)
        switch = state[np.arange(k), best] - penalty
        keep = state >= switch[:, None]
        stay[at], came[at] = keep, best
        state = np.where(keep, state, switch[:, None]) + scores[at]
    current = final.copy()
    for t in range(int(n[0]) - 1, -1, -1):
        k = int(active[t])
        at = begin[:k] + t
        now = current[:k]
        labels[at] = now
        if t:
            current[:k] = np.where(stay[at, now], now, came[at])
    return labels


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: ``lang_pred``, ``score`` and ``spans`` of words with one label.

    With ``carry`` the whole input row stands in a column ``row`` in place of ``doc_id``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.languages, model.scores, model.scripts))  # bounded: languages x BUCKETS numbers
    first = F.struct("*").alias("row") if carry else F.col(doc_id).cast("bigint").alias("doc_id")
    rows = docs.select(first, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("spoken"), _lower(text).alias("text"))
    name = rows.columns[0]
    added = "lang_pred string, score double, spans array<struct<first_word:int,end_word:int,lang:string>>"
    schema = StructType([rows.schema[0], *StructType.fromDDL(added)])

    def label(texts, rest):
        m = Model(*shared.value)
        words = Words(texts, _ALPHA)
        spoken = np.array(rest["spoken"].to_pylist(), bool)
        pred, score, spans = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        if m.languages and len(words.starts):
            labels = viterbi(word_scores(words, m), words.first)
            letters = words.ends - words.starts
            weight = np.zeros((len(texts), len(m.languages)))
            np.add.at(weight, (words.owner, labels), letters)
            total = weight.sum(1)
            change = np.flatnonzero(np.concatenate([[True], (labels[1:] != labels[:-1]) | (words.owner[1:] != words.owner[:-1])]))
            ends = np.append(change[1:], len(labels))
            for a, b in zip(change.tolist(), ends.tolist()):
                d = words.owner[a]
                spans[d].append((int(a - words.first[d]), int(b - words.first[d]), m.languages[labels[a]]))
            for d in np.flatnonzero(spoken & (total > 0)):
                k = int(weight[d].argmax())
                pred[d], score[d] = m.languages[k], float(weight[d, k] / total[d])
        spans = [s if ok else [] for s, ok in zip(spans, spoken)]
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())]))
        as_rows = [[{"first_word": a, "end_word": b, "lang": x} for a, b, x in s] for s in spans]
        return pa.RecordBatch.from_arrays([rest[name], pa.array(pred), pa.array(score), pa.array(as_rows, kind)],
                                          [name, "lang_pred", "score", "spans"])

    return map_texts(rows, label, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))

"""License scan by diagonal voting.

All rolling word k-grams of a document (pairs for phrases, longer ones for
notices) are joined by hash with the positions of known phrases and notices.
Grams on one diagonal (document position minus template position) stand in the
template's order; diagonals are counted and neighbouring ones of a notice are
merged, since a word more or less shifts what follows.  A hit takes the words
around its diagonal along, so the texts themselves never leave the task that
read them; spans are verified on these words.

Phrases must stand in full; of a notice, ``COVER`` of its words must stand in
the template's order near the span's strongest diagonal.  Results in odd cases:
null and empty texts have no words, no spans and score 0; equal rows (same id
and text) give equal rows; an empty table gives an empty one; other columns are
ignored.  Texts are read whole.  The templates are a fixed list, so the
broadcast side has a fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenaudit.llm.common import map_texts, row_key, utf8
from lumenaudit.llm.decontaminate import word_list
from lumenaudit.llm.rolling import Words

#: Words of a gram, for phrases and for notices.
K, NOTICE_K = 2, 3
#: Diagonals of a notice at most so far apart belong to one span; words beyond both ends that are verified with it.
SLACK, MARGIN = 4, 8
#: Share of a notice's grams that must vote, and of its words that must stand in the span in order.
VOTES, COVER = 0.2, 0.8
#: Bytes of text whose words are handled at a time.
GRAM_BYTES = 1 << 18

# Phrases and the labels they stand for.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Wording of public license notices.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
)


def templates() -> list[tuple[int, str, bool, list[bytes]]]:
    """Number, label, whether it is a phrase, and words of each template."""
    both = [(label, True, text) for text, label in PHRASES] + [(label, False, text) for label, text in NOTICES]
    return [(i, label, phrase, word_list(text.encode())) for i, (label, phrase, text) in enumerate(both)]


def template_positions(spark) -> DataFrame:
    rows = []
    for i, _, phrase, words in templates():
        _, h = Words([b" ".join(words)]).grams(K if phrase else NOTICE_K)
        rows += [(i, phrase, len(words), p, int(x)) for p, x in enumerate(h.view(np.int64))]
    return spark.createDataFrame(rows, "template int, phrase boolean, length int, place int, gram bigint")


def _lists(values: pa.Array, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def word_grams(docs: DataFrame) -> DataFrame:
    """Each document's words, lower-cased, and all its rolling pairs and then its longer grams, in order."""

    def emit(texts, rest):
        words = Words(texts)
        n = len(words.starts)
        sizes = np.concatenate([[0], np.cumsum(words.ends - words.starts)]).astype(np.int32)
        said = pa.StringArray.from_buffers(n, pa.py_buffer(sizes), pa.py_buffer(words.codes[words.codes != 0].tobytes()))
        found = [words.grams(k) for k in (K, NOTICE_K)]
        of = np.concatenate([words.owner[at] for at, _ in found])
        grams = np.concatenate([h for _, h in found])[np.argsort(of, kind="stable")]
        return pa.RecordBatch.from_arrays(
            [rest["key"], _lists(said, words.counts), _lists(pa.array(grams.view(np.int64)), np.bincount(of, minlength=len(texts)))],
            ["key", "words", "grams"])

    return map_texts(docs.select(row_key("doc_id", "text").alias("key"), utf8("text").alias("text")), emit,
                     "key string, words array<string>, grams array<bigint>", limit=GRAM_BYTES)


def voted_spans(docs: DataFrame) -> DataFrame:
    """Spans that got enough votes: key, template, and the words around the strongest diagonal with the number of the first."""
    c = F.col
    pairs = F.greatest(F.size("words") - (K - 1), F.lit(0))
    grams = word_grams(docs).select("key", "words", pairs.alias("pairs"), F.posexplode("grams").alias("at", "gram"))
    hits = grams.join(F.broadcast(template_positions(docs.sparkSession)), "gram")  # fixed list of templates
    hits = hits.withColumn("diagonal", F.when(c("at") < c("pairs"), c("at")).otherwise(c("at") - c("pairs")) - c("place"))
    margin = F.when(c("phrase"), F.lit(0)).otherwise(F.lit(MARGIN))
    hits = hits.withColumn("begin", F.greatest(c("diagonal") - margin, F.lit(0)))
    around = F.slice("words", c("begin") + 1, c("diagonal") + c("length") + margin - c("begin"))
    hits = hits.select("key", "template", "phrase", "length", "place", "diagonal", "begin", F.array_join(around, " ").alias("said"))
    votes = hits.groupBy("key", "template", "phrase", "length", "diagonal", "begin", "said").agg(F.countDistinct("place").alias("votes"))
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    apart = F.when(c("phrase"), F.lit(0)).otherwise(F.lit(SLACK))
    fresh = F.coalesce(c("diagonal") - F.lag("diagonal").over(order) > apart, F.lit(True))
    votes = votes.withColumn("span", F.sum(fresh.cast("int")).over(order))
    merged = votes.groupBy("key", "template", "phrase", "length", "span").agg(
        F.sum("votes").alias("votes"), F.max_by(F.struct("begin", "said"), F.struct("votes", -c("diagonal"))).alias("best"))
    need = F.when(c("phrase"), c("length") - (K - 1)).otherwise(F.ceil((c("length") - (NOTICE_K - 1)) * F.lit(VOTES)))
    return merged.filter(c("votes") >= need).select("key", "template", "best.begin", "best.said")


def in_order(said: list[bytes], expected: list[bytes]) -> tuple[int, int, int]:
    """Most words of ``expected`` that stand in ``said`` in order, the first of their places there and the place behind the last."""
    row = [(0, 0, 0)] * (len(expected) + 1)  # matches, minus the first place, minus the end: the most matches, then the earliest
    for i, word in enumerate(said):
        new = [row[0]]
        for j, want in enumerate(expected):
            best = max(row[j + 1], new[j])
            if word == want:
                n, first, _ = row[j]
                best = max(best, (n + 1, first if n else -i, -(i + 1)))
            new.append(best)
        row = new
    n, first, end = row[-1]
    return n, -first, -end


def verified_spans(spans: DataFrame) -> DataFrame:
    """The spans whose words hold enough of their template: key, and label, phrase, first word, end word, share of the template."""
    known = templates()

    def verify(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                _, label, phrase, expected = known[row["template"]]
                said = row["said"].encode().split(b" ")
                n, first, end = (len(said), 0, len(said)) if said == expected else in_order(said, expected)
                share = n / len(expected)
                if said == expected if phrase else share >= COVER:
                    out.append((row["key"], label, phrase, row["begin"] + first, row["begin"] + end, share))
            kinds = pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()
            columns = list(zip(*out)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)],
                                             ["key", "label", "phrase", "first_word", "end_word", "share"])

    return spans.mapInArrow(verify, "key string, label string, phrase boolean, first_word bigint, end_word bigint, share double")


def word_counts(docs: DataFrame) -> DataFrame:
    def emit(texts, rest):
        return pa.RecordBatch.from_arrays([rest["doc_id"], rest["key"], pa.array(Words(texts).counts.astype(np.int64))], ["doc_id", "key", "n_words"])

    return map_texts(docs.select("doc_id", row_key("doc_id", "text").alias("key"), utf8("text").alias("text")), emit,
                     "doc_id bigint, key string, n_words bigint", limit=GRAM_BYTES)


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``n_words`` and verified ``spans`` (label, phrase, first word, end word, share of the template)."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    place = F.struct("first_word", "end_word", "label", (~F.col("phrase")).alias("notice"), "share")
    spans = verified_spans(voted_spans(docs)).groupBy("key").agg(F.sort_array(F.collect_set(place)).alias("spans"))
    spans = spans.withColumn("spans", F.transform("spans", lambda s: F.struct(
        s["label"].alias("label"), (~s["notice"]).alias("phrase"), s["first_word"].alias("first_word"), s["end_word"].alias("end_word"),
        s["share"].alias("share"))))
    none = F.array().cast("array<struct<label:string,phrase:boolean,first_word:bigint,end_word:bigint,share:double>>")
    return word_counts(docs).join(spans, "key", "left").select("doc_id", "n_words", F.coalesce("spans", none).alias("spans"))

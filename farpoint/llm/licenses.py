"""License scan: diagonal voting of word k-grams against license texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.llm.steps import written
from farpoint.llm.words import ALPHANUMERIC, Slice, grams, slices

# Phrases that name a license, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices of common licenses, label and text.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
]


@dataclass(frozen=True)
class LicenseParams:
    k: int = 4  # words of a gram
    band: int = 3  # diagonals this close belong together: words put in or left out
    cover: float = 0.75  # share of a notice's words a span must hold in order


def _hash_words(text: str) -> np.ndarray:
    (s,) = slices(pa.array([text]))
    return s.words(ALPHANUMERIC)[0]


def _templates(p: LicenseParams) -> list[tuple[int, int, int]]:
    """(gram hash, notice, position) of every notice: a few hundred rows, fixed by the list."""
    out = []
    for t, (_, text) in enumerate(NOTICES):
        h = _hash_words(text)
        g, _ = grams(h, np.array([0, len(h)]), p.k)
        out += [(int(x), t, i) for i, x in enumerate(g.view(np.int64))]
    return out


def _scan(p: LicenseParams):
    known = np.unique(np.array([h for h, _, _ in _templates(p)], np.int64).view(np.uint64))
    phrases = [(_hash_words(text), label) for text, label in PHRASES.items()]

    def places(s: Slice, hashes: np.ndarray, first: np.ndarray):
        """Starts of all phrases, and the labels of each text."""
        starts, labels = [], [[] for _ in range(s.rows)]
        for words, label in phrases:
            m = len(words)
            if len(hashes) < m:
                continue
            same = np.ones(len(hashes) - m + 1, bool)
            for j, w in enumerate(words):
                same &= hashes[j : len(hashes) - m + 1 + j] == w
            at = np.flatnonzero(same)
            row = np.searchsorted(first, at, "right") - 1
            at = at[at + m <= first[row + 1]]
            row = np.searchsorted(first, at, "right") - 1
            starts.append(at)
            for r in np.unique(row):
                labels[r].append(label)
        return np.sort(np.concatenate(starts or [np.zeros(0, np.int64)])), labels

    def run(batches):
        key = TaskContext.get().partitionId() << 33
        for b in batches:
            for s in slices(b.column(1)):
                hashes, first = s.words(ALPHANUMERIC)
                starts, labels = places(s, hashes, first)
                at = np.searchsorted(starts, first)
                g, g_at = grams(hashes, first, p.k)
                found = np.searchsorted(known, g)
                hits = np.flatnonzero(known[np.minimum(found, len(known) - 1)] == g)
                h_at = np.searchsorted(hits, g_at)
                cols = {n: [] for n in ("n_base", "first_word", "last_word", "base", "at", "gram", "words")}
                for r in range(s.rows):
                    own = starts[at[r] : at[r + 1]] - first[r]
                    h = hits[h_at[r] : h_at[r + 1]]
                    cols["n_base"].append(len(own))
                    cols["first_word"].append(int(own[0]) if len(own) else None)
                    cols["last_word"].append(int(own[-1]) if len(own) else None)
                    cols["base"].append(sorted(set(labels[r])))
                    cols["at"].append((h - g_at[r]).tolist())
                    cols["gram"].append(g[h].view(np.int64).tolist())
                    cols["words"].append(hashes[first[r] : first[r + 1]].tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + s.rows)), b.column(0).slice(s.first, s.rows), pa.array(np.diff(first)),
                     pa.array(cols["n_base"], pa.int64()), pa.array(cols["first_word"], pa.int64()), pa.array(cols["last_word"], pa.int64()),
                     pa.array(cols["base"], pa.list_(pa.string())), pa.array(cols["at"], pa.list_(pa.int64())),
                     pa.array(cols["gram"], pa.list_(pa.int64())), pa.array(cols["words"], pa.binary())],
                    names=["key", "doc_id", "n_words", "n_base", "first_word", "last_word", "base", "at", "gram", "words"],
                )
                key += s.rows

    return run


def _in_order(notice: np.ndarray, span: np.ndarray) -> int:
    """Length of the longest common subsequence of words."""
    best = np.zeros(len(span) + 1, np.int64)
    for w in notice:
        kept = np.concatenate([[0], best[:-1] + (span == w)])
        best = np.maximum.accumulate(np.maximum(best, kept))
    return int(best[-1])


def _verify(p: LicenseParams):
    notices = [_hash_words(text) for _, text in NOTICES]

    def run(batches):
        for b in batches:
            score = []
            for words, t, d0, d1 in zip(b.column("words"), *(b.column(c).to_pylist() for c in ("notice", "lo", "hi")), strict=True):
                words = np.frombuffer(words.as_buffer(), np.uint64)
                span = words[max(d0 - p.band, 0) : d1 + len(notices[t]) + p.band]
                score.append(_in_order(notices[t], span) / len(notices[t]))
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("key", "notice", "lo", "hi")] + [pa.array(score, pa.float64())],
                names=["key", "notice", "lo", "hi", "cover"],
            )

    return run


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: LicenseParams | None = None) -> DataFrame:
    """License phrases and notices of every text.

    One row per input row: ``doc_id``, ``n_words``, the phrases (``n_base``, ``first_word``,
    ``last_word``, ``base_labels``), all ``labels``, ``score`` (largest share of a notice
    found, 0 if none reaches ``cover``) and ``spans`` (label, first and last word, share).

    All rolling k-grams are held against those of the notices; the hits are joined with the
    notices' positions, counted by diagonal, diagonals close to each other merged, and the
    words of each span compared in order. Null is empty text: no words, empty labels. Repeated
    rows are answered one by one, other columns are ignored.
    """
    p = params or LicenseParams()
    spark = df.sparkSession
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = written(texts.mapInArrow(_scan(p), f"key long, doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, at array<long>, gram array<long>, words binary"))
    notices = F.broadcast(spark.createDataFrame(_templates(p), "gram long, notice int, place long"))
    hits = rows.where("words is not null").select("key", F.explode(F.arrays_zip("at", "gram")).alias("h"))
    hits = hits.select("key", F.col("h.at").alias("at"), F.col("h.gram").alias("gram")).join(notices, "gram")
    votes = hits.groupBy("key", "notice", (F.col("at") - F.col("place")).alias("diagonal")).agg(F.count("*").alias("votes"))
    by_notice = Window.partitionBy("key", "notice").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_notice) > p.band, F.lit(True))
    votes = votes.withColumn("run", F.sum(fresh.cast("int")).over(by_notice))
    spans = votes.groupBy("key", "notice", "run").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("lo"), F.max("diagonal").alias("hi"))
    checked = spans.join(rows.select("key", "words"), "key").select("key", "words", "notice", "lo", "hi")
    checked = checked.mapInArrow(_verify(p), "key long, notice int, lo long, hi long, cover double").where(F.col("cover") >= p.cover)
    names = F.array(*[F.lit(label) for label, _ in NOTICES])
    lengths = F.array(*[F.lit(len(_hash_words(text))) for _, text in NOTICES])
    first = F.greatest("lo", F.lit(0))
    span = F.struct(names[F.col("notice")].alias("label"), first.alias("first"), (F.col("hi") + lengths[F.col("notice")] - 1).alias("last"), "cover")
    found = checked.groupBy("key").agg(F.collect_list(span).alias("spans"), F.max("cover").alias("score"))
    out = rows.drop("words", "at", "gram").join(found, "key", "left")
    own = F.coalesce(F.col("spans.label"), F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_distinct(F.concat("base", own))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.sort_array(F.coalesce("spans", F.array().cast("array<struct<label:string,first:bigint,last:bigint,cover:double>>"))).alias("spans"),
    )

"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.llm.words import Slice, slices


@dataclass(frozen=True)
class LangParams:
    orders: tuple[int, ...] = (1, 2, 3)
    bits: int = 15  # hashed features
    smoothing: float = 0.5
    max_langs: int = 200  # bounds the broadcast matrix


@dataclass(frozen=True)
class LangModel:
    langs: list[str]
    weights: np.ndarray  # log probability of feature by language
    prior: np.ndarray


UNKNOWN = "und"
_LETTERS = np.array([chr(b).isalpha() if b < 128 else False for b in range(256)])


def _features(s: Slice, p: LangParams) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts of a slice in text order, and where each text begins."""
    heads = (s.data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(heads)])[s.offsets]
    points = np.frombuffer(s.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    points = np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint64)
    row = np.repeat(np.arange(s.rows), np.diff(chars))
    found, owner = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(p.orders) + 1):
        m = len(points) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :] + np.uint64(1)
        if n in p.orders:
            inside = row[:m] == row[n - 1 :]
            x = (h[inside] + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
            found.append((x >> np.uint64(64 - p.bits)).astype(np.int32))
            owner.append(row[:m][inside])
    if not found:
        return np.zeros(0, np.int32), np.zeros(s.rows + 1, np.int64)
    row = np.concatenate(owner)
    order = np.argsort(row, kind="stable")
    at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=s.rows))])
    return np.concatenate(found)[order], at


def _has_letter(s: Slice) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(_LETTERS[s.data])])[s.offsets]
    out = np.diff(seen) > 0
    for r in np.flatnonzero(~out & (np.diff(s.offsets) > 0)):
        text = s.data[s.offsets[r] : s.offsets[r + 1]].tobytes().decode("utf-8", "replace")
        out[r] = any(c.isalpha() for c in text)
    return out


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", params: LangParams | None = None) -> LangModel:
    """Learn from all rows with a text and a language. Feature counts are added up by Spark;
    only one number per language and feature reaches the driver."""
    p = params or LangParams()
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for b in batches:
            lang = b.column(1).to_pylist()
            for s in slices(b.column(0)):
                x, at = _features(s, p)
                own = np.array(lang[s.first : s.first + s.rows], object)
                row = np.repeat(np.arange(s.rows), np.diff(at))
                for name in set(own):
                    hit = own == name
                    texts[name] = texts.get(name, 0) + int(hit.sum())
                    add = np.bincount(x[hit[row]], minlength=1 << p.bits)
                    counts[name] = counts[name] + add if name in counts else add
                if len(counts) > p.max_langs:
                    raise ValueError(f"more than max_langs={p.max_langs} languages")
        for name, c in counts.items():
            (used,) = np.nonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(used) + 1)), pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(c[used], texts[name]).astype(np.int64))],
                names=["lang", "feature", "n"],
            )

    sums = rows.mapInArrow(run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    # at most max_langs * (2 ** bits + 1) rows
    found = sums.toPandas()
    langs = sorted(found.lang.unique())
    if len(langs) > p.max_langs:
        raise ValueError(f"more than max_langs={p.max_langs} languages")
    counts = np.zeros((len(langs), 1 << p.bits))
    texts = np.zeros(len(langs))
    own = np.searchsorted(np.array(langs, object), found.lang.to_numpy(object)) if langs else np.zeros(0, int)
    feature, n = found.feature.to_numpy(int), found.n.to_numpy(float)
    np.add.at(counts, (own[feature >= 0], feature[feature >= 0]), n[feature >= 0])
    texts[own[feature < 0]] = n[feature < 0]
    counts += p.smoothing
    weights = np.log(counts) - np.log(counts.sum(1, keepdims=True))
    return LangModel(langs, weights.astype(np.float32), np.log(np.maximum(texts, 1) / max(texts.sum(), 1)))


def predict(df: DataFrame, model: LangModel, text_col: str = "text", keep: list[str | Column] | None = None, params: LangParams | None = None) -> DataFrame:
    """``lang_pred`` and ``score`` (posterior probability) of every row, with the ``keep``
    columns. A null text, one without a letter, or a model of no language gives ``und`` and 0."""
    p = params or LangParams()
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*(keep or []), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        m = shared.value
        for b in batches:
            names, scores = [], []
            for s in slices(b.column(b.num_columns - 1)):
                x, at = _features(s, p)
                ok = _has_letter(s) & bool(m.langs)
                if not m.langs:
                    names += [UNKNOWN] * s.rows
                    scores += [0.0] * s.rows
                    continue
                logs = np.empty((len(m.langs), s.rows))
                for i, w in enumerate(m.weights):
                    sums = np.concatenate([[0.0], np.cumsum(w[x], dtype=np.float64)])
                    logs[i] = m.prior[i] + sums[at[1:]] - sums[at[:-1]]
                logs -= logs.max(0)
                odds = np.exp(logs)
                odds /= odds.sum(0)
                best = odds.argmax(0)
                names += [m.langs[i] if k else UNKNOWN for i, k in zip(best, ok, strict=True)]
                scores += np.where(ok, odds[best, np.arange(s.rows)], 0.0).tolist()
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*b.schema.names[:-1], "lang_pred", "score"],
            )

    given = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*given, "lang_pred string", "score double"]))


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id's text, modulo; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus

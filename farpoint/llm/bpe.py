"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.steps import written
from farpoint.llm.words import NOT_WHITE, Slice, mix, slices


@dataclass(frozen=True)
class BpeParams:
    tokenizer: str  # path of a tokenizers file
    rolling_words: int = 3  # the rolling hash covers so many words
    mean_words: int = 32  # of a chunk
    max_words: int = 256
    shared_chunks: int = 16_384  # chunks encoded once for all tasks and broadcast at most
    cached_words: int = 500_000  # pieces a worker keeps


# Probes of joins at white space: a tokenizer that passes never looks across it.
_PROBES = ["a b", "it 's\tx", "x ́y", "1 2\n.", "Σ Σ", "é\r\nZ", "<|a|> b", ", ,", "a  b", "'ll 've"]

# Between words that are encoded in one call, and kept apart by it.
_MARK = b"\x01"
_BETWEEN = b" \x01 "


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """A tokenizer with the ids of known pieces in one pool; lives as long as its worker."""

    def __init__(self, p: BpeParams, shared: list[tuple[int, bytes]]) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.p = p
        self.tokenizer = Tokenizer.from_file(p.tokenizer)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.shared = np.array([h for h, _ in shared], np.uint64)
        self.fixed = np.frombuffer(b"".join(ids for _, ids in shared), np.int32)
        self.shared_len = np.array([len(ids) // 4 for _, ids in shared], np.int64)
        self.shared_at = np.cumsum(self.shared_len) - self.shared_len
        self.splits = all(self.whole(t) == [i for w in t.split() for i in self.whole(w)] for t in _PROBES[:8])
        self.joins: dict[int, bool] = {}
        self.keys = np.zeros(0, np.uint64)  # of the known pieces; where their ids are in the pool
        self.at, self.len, self.seen = (np.zeros(0, np.int64) for _ in range(3))
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self._order()
        mark = self.whole(_MARK.decode())
        self.mark = mark[0] if len(mark) == 1 else None
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [(self.tokenizer.id_to_token(i) or "").encode() + b" " for i in range(n)]
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self.name_len = np.array([len(x) for x in names], np.int64)
        self.name_at = np.cumsum(self.name_len) - self.name_len

    def _forget(self) -> None:
        """Pieces that several slices asked for stay, at most half of what a worker keeps."""
        stay = np.flatnonzero(self.seen > 1)
        most = self.p.cached_words // 2
        if len(stay) > most:
            stay = stay[np.argpartition(-self.seen[stay], most)[:most]]
        self.pool = self.pool[ragged(self.at[stay], self.len[stay])]
        self.used = len(self.pool)
        self.keys, self.len, self.seen = self.keys[stay], self.len[stay], self.seen[stay] // 2
        self.at = np.cumsum(self.len) - self.len
        self._order()

    def _order(self) -> None:
        self.order = np.argsort(self.keys, kind="stable")
        self.sorted = self.keys[self.order]

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 for those that are not known."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], -1)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def _apart(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same of words, in one call: a mark that is a token of its own stands between them."""
        text = _BETWEEN.join(words)
        if self.mark is not None and text.count(_MARK) == len(words) - 1:
            ids = np.array(self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.int32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(words) - 1:  # none comes from a word
                return ids[ids != self.mark], np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1
        return self._one_by_one([w.decode("utf-8", "replace") for w in words])

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Encode words that are not known; their hashes ascend."""
        found = [self._apart(words[i : i + 2048]) for i in range(0, len(words), 2048)]
        if not found:
            return
        sizes = np.concatenate([n for _, n in found])
        end = self.used + int(sizes.sum())
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), end - len(self.pool)), np.int32)])
        self.pool[self.used : end] = np.concatenate([ids for ids, _ in found])
        place = np.searchsorted(self.sorted, hashes)
        self.order = np.insert(self.order, place, len(self.keys) + np.arange(len(hashes)))
        self.sorted = np.insert(self.sorted, place, hashes)
        self.keys = np.concatenate([self.keys, hashes])
        self.at = np.concatenate([self.at, self.used + np.cumsum(sizes) - sizes])
        self.len = np.concatenate([self.len, sizes])
        self.seen = np.concatenate([self.seen, np.zeros(len(sizes), np.int64)])
        self.used = end

    def pieces(self, s: Slice, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and length in the pool of the ids of each piece; new ones are encoded."""
        if len(self.keys) > self.p.cached_words:
            self._forget()
        known, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(self.slots(known) < 0)
        raw, at = s.data.tobytes(), first[new]
        self._learn(known[new], [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
        slots = self.slots(known)
        self.seen[slots] += 1
        return self.at[slots][back], self.len[slots][back]

    def _hold(self, s: Slice, cut: Chunks, places: np.ndarray, keys: np.ndarray) -> None:
        """Find out of each join whether its two words encoded together give what they give one
        by one; ``places`` are the second words."""
        if len(self.joins) > self.p.cached_words:
            self.joins.clear()
        keys, first = np.unique(keys, return_index=True)
        new = np.flatnonzero([k not in self.joins for k in keys.tolist()])
        if not len(new):
            return
        raw, right = s.data.tobytes(), places[first[new]]
        both = np.stack([right - 1, right], 1).ravel()
        words = [raw[a:b] for a, b in zip(cut.starts[both].tolist(), cut.ends[both].tolist(), strict=True)]
        # words inside shared chunks have not been encoded by themselves yet
        lone, at = np.unique(cut.word_hashes[both], return_index=True)
        unknown = self.slots(lone) < 0
        self._learn(lone[unknown], [words[i] for i in at[unknown].tolist()])
        slots = self.slots(cut.word_hashes[both])
        text = [f"{a.decode('utf-8', 'replace')} {b.decode('utf-8', 'replace')}" for a, b in zip(words[::2], words[1::2], strict=True)]
        for a in range(0, len(new), 4096):
            ids, sizes = self._one_by_one(text[a : a + 4096])
            own = slots[2 * a : 2 * (a + len(sizes))]
            alike = self.len[own].reshape(-1, 2).sum(1) == sizes
            rows = np.flatnonzero(alike)
            here = ids[ragged((np.cumsum(sizes) - sizes)[rows], sizes[rows])]
            own = own.reshape(-1, 2)[rows].ravel()
            apart = here != self.pool[ragged(self.at[own], self.len[own])]
            alike[np.repeat(rows, sizes[rows])[apart]] = False
            self.joins.update(zip(keys[new[a : a + 4096]].tolist(), alike.tolist(), strict=True))

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the slice, and where those of each text begin."""
        if not self.splits:
            raw = s.data.tobytes()
            ids = [self.whole(raw[a:b].decode("utf-8", "replace")) for a, b in zip(s.offsets[:-1], s.offsets[1:], strict=True)]
            return np.array([i for x in ids for i in x], np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        cut = Chunks(s, self.p)
        # chunks that are known as a whole take the place of their words
        hit = np.zeros(len(cut.hashes), bool)
        if len(self.shared) and len(cut.hashes):
            at = np.minimum(np.searchsorted(self.shared, cut.hashes), len(self.shared) - 1)
            hit = self.shared[at] == cut.hashes
        covered = np.repeat(hit, cut.sizes)
        loose = np.flatnonzero(~covered)
        at_w, len_w = self.pieces(s, cut.starts[loose], cut.ends[loose], cut.word_hashes[loose])
        place = np.concatenate([loose, cut.first[:-1][hit]])
        order = np.argsort(place, kind="stable")
        begin = np.concatenate([at_w, self.shared_at[at[hit]] + self.used if hit.any() else np.zeros(0, np.int64)])[order]
        length = np.concatenate([len_w, self.shared_len[at[hit]] if hit.any() else np.zeros(0, np.int64)])[order]
        pool = np.concatenate([self.pool[: self.used], self.fixed])
        ids = pool[ragged(begin, length)]
        row = np.searchsorted(cut.text_first, place[order], "right") - 1
        sizes = np.bincount(row, length, s.rows).astype(np.int64)
        return self._repaired(s, cut, ids, sizes)

    def _repaired(self, s: Slice, cut: Chunks, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hold the words on both sides of every chunk join against their joint encoding; a
        text with a join that does not agree is encoded again as a whole."""
        wrong = set()
        inner = cut.first[1:-1]  # first word of every chunk but the first
        inner = inner[~np.isin(inner, cut.text_first)]
        if len(inner):
            keys = mix(cut.word_hashes[inner - 1] * np.uint64(3) + cut.word_hashes[inner])
            self._hold(s, cut, inner, keys)
            bad = inner[[not self.joins[k] for k in keys.tolist()]]
            wrong = set((np.searchsorted(cut.text_first, bad, "right") - 1).tolist())
        at = np.concatenate([[0], np.cumsum(sizes)])
        if wrong:
            raw = s.data.tobytes()
            parts = [ids[at[r] : at[r + 1]] for r in range(s.rows)]
            for r in wrong:
                parts[r] = np.array(self.whole(raw[s.offsets[r] : s.offsets[r + 1]].decode("utf-8", "replace")), np.int32)
            ids = np.concatenate(parts)
            at = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, at

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        if self.tokenizer.decoder is not None:
            return pa.array([self.tokenizer.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(at[:-1], at[1:], strict=True)], pa.string())
        length = self.name_len[ids]
        text = self.names[ragged(self.name_at[ids], length)]  # each name and one space
        ends = np.concatenate([[0], np.cumsum(length)])[at]
        full = np.diff(at) > 0
        keep = np.ones(len(text), bool)
        keep[ends[1:][full] - 1] = False  # the space after a text's last token
        offsets = np.concatenate([[0], np.cumsum(np.diff(ends) - full)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text[keep])))


class Chunks:
    """Content-defined chunks of whole words: one ends where the rolling hash of the last
    words has a given remainder, at the end of a text, or at ``max_words``."""

    def __init__(self, s: Slice, p: BpeParams) -> None:
        self.starts, self.ends, self.text_first = s.spans(NOT_WHITE)
        sums = s.prefix_hashes(fold=False)
        self.word_hashes = s.hash_spans(sums, self.starts, self.ends)
        n = len(self.starts)
        rolled = self.word_hashes.copy()
        for j in range(1, p.rolling_words):
            rolled[j:] += self.word_hashes[:-j] * np.uint64(2 * j + 1)
        begins = np.zeros(n + 1, bool)
        begins[self.text_first] = True
        begins[1:][mix(rolled) % np.uint64(p.mean_words) == 0] = True
        begins[0] = begins[n] = True
        first = np.flatnonzero(begins)
        sizes = np.diff(first)
        if len(sizes) and sizes.max() > p.max_words:  # cut long ones evenly
            parts = -(-sizes // p.max_words)
            first = np.append(np.repeat(first[:-1], parts) + ragged(np.zeros_like(parts), parts) * p.max_words, n)
            sizes = np.diff(first)
        self.first, self.sizes = (first, sizes) if n else (np.zeros(1, np.int64), np.zeros(0, np.int64))
        if n:
            self.hashes = s.hash_spans(sums, self.starts[first[:-1]], self.ends[first[1:] - 1])
        else:
            self.hashes = np.zeros(0, np.uint64)


_encoders: dict = {}


def _encoder(p: BpeParams, shared, key) -> Encoder:
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(p, shared)
    return _encoders[key]


def _chunk_counts(texts: DataFrame, p: BpeParams) -> DataFrame:
    """Chunks found more than once: hash, how often, words, and the hash of a text that holds it."""

    def run(batches):
        for b in batches:
            body = b.column(1).to_numpy()
            for s in slices(b.column(0)):
                cut = Chunks(s, p)
                h, i, n = np.unique(cut.hashes, return_index=True, return_counts=True)
                row = np.searchsorted(cut.text_first, cut.first[i], "right") - 1
                out = [h.view(np.int64), n, cut.sizes[i], body[s.first + row]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["chunk", "n", "words", "body"])

    counts = texts.mapInArrow(run, "chunk long, n long, words long, body long")
    counts = counts.groupBy("chunk").agg(F.sum("n").alias("n"), F.max("words").alias("words"), F.min("body").alias("body"))
    return counts.where("n > 1 and words > 1")


def _shared(texts: DataFrame, p: BpeParams) -> list[tuple[int, bytes]]:
    """The chunks whose reuse saves most, each encoded once. At most ``shared_chunks`` chunks
    of at most ``max_words`` words reach the driver; the others are put together from words
    where they stand, with the same ids. The chunks are taken from one text each, so the other
    texts are cut once here."""
    texts = texts.select("text", F.xxhash64("text").alias("body"))
    best = written(_chunk_counts(texts, p).orderBy(F.desc(F.col("n") * F.col("words")), "chunk").limit(p.shared_chunks))
    wanted = np.sort(best.select("chunk").toPandas().chunk.to_numpy(np.int64).view(np.uint64))
    if not len(wanted):
        return []
    known = texts.sparkSession.sparkContext.broadcast(wanted)
    holders = texts.join(F.broadcast(best.select("body").distinct()), "body", "left_semi").select("text")

    def find(batches):
        seen: set[int] = set()
        for b in batches:
            for s in slices(b.column(0)):
                cut = Chunks(s, p)
                at = np.minimum(np.searchsorted(known.value, cut.hashes), len(known.value) - 1)
                hits = [i for i in np.flatnonzero(known.value[at] == cut.hashes) if int(cut.hashes[i]) not in seen]
                hits = list({int(cut.hashes[i]): i for i in hits}.values())
                seen.update(int(cut.hashes[i]) for i in hits)
                raw = s.data.tobytes()
                text = [raw[cut.starts[cut.first[i]] : cut.ends[cut.first[i + 1] - 1]].decode("utf-8", "replace") for i in hits]
                yield pa.RecordBatch.from_arrays([pa.array(cut.hashes[hits].view(np.int64)), pa.array(text, pa.string())], names=["chunk", "text"])

    def encode(batches):
        own = _encoder(p, [], p)
        for b in batches:
            ids = [np.array(own.whole(t), np.int32).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["chunk", "ids"])

    found = holders.mapInArrow(find, "chunk long, text string").groupBy("chunk").agg(F.min("text").alias("text"))
    found = found.mapInArrow(encode, "chunk long, ids binary").toPandas()
    pairs = zip(found.chunk.to_numpy(np.int64).view(np.uint64).tolist(), found.ids, strict=True)
    return sorted((h, bytes(ids)) for h, ids in pairs)


def encode_texts(df: DataFrame, params: BpeParams, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """Token ids of every text as the tokenizer gives them, and their decoding.

    One row per input row: ``doc_id``, ``ids`` and ``decoded``. Null text is empty: no ids.
    Repeated rows are answered one by one, other columns are ignored, an empty table gives an
    empty result. Pieces are told apart by 64 bit hashes.

    Chunks shared across documents are encoded once and broadcast, other text is put together
    from words that a worker encodes once; joins of chunks are held against a joint encoding.
    A tokenizer that looks across white space gets whole texts.
    """
    p = params
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(_shared(texts.select("text"), p))

    key = uuid.uuid4().hex

    def run(batches):
        own = _encoder(p, shared.value, key)
        for b in batches:
            for s in slices(b.column(1)):
                ids, at = own.encode(s)
                out = [b.column(0).slice(s.first, s.rows), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
                yield pa.RecordBatch.from_arrays([*out, own.decode(ids, at)] if decoded else out, names=["doc_id", "ids", "decoded"][: 2 + decoded])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)

"""Ranked lexical search over bit-sliced Bloom signatures.

The index is a table of blocks. A block holds documents of similar size and

- their signatures, bit-sliced: slice ``s`` is a bitmap over the block's documents, and a term
  is a few slices chosen by its hash; the bits that all of them share overestimate the
  documents with that term. A term that occurs 2, 4 or 8 times is entered once more for each
  of these levels, so a signature bounds its occurrences, too;
- the document frequencies of its terms, and the documents' terms with their counts, by the
  number of a term in the block.

A search takes a block of items over all index blocks. The score that a term can have at most
at each level, summed over an item's terms where the slices say present, is an upper bound for
each document. A document whose bound is below the score of the ``k``-th best so far cannot
enter and is left out; all others are scored exactly from the block's counts. The ``k``-th best
of a fixed share of the blocks gives every task its first threshold, which changes the work
and never the result.

Terms are runs of digits, ASCII letters and characters beyond ASCII, A-Z lower-cased, told
apart by 64 bit hashes. Scores are whole numbers, see ``_gain`` and ``_weights``.

Defined results. A null or empty text has no term: such a document is not counted and never
found, such an item finds nothing. Each row of documents is a document and each row of items an
item, also if repeated. Equal scores go by ``doc_id``, null last; rows alike in both are
interchangeable. No documents or no items: no rows. Extra columns are not looked at, whatever
their names are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.llm.steps import written
from farpoint.llm.words import ALPHANUMERIC, mix, slices

#: Occurrences from which a term is entered at a level.
LEVELS = (1, 2, 4, 8)
HASHES = 3
#: Slices for each entry of the largest document a block may hold (a power of two).
SLICES_PER_ENTRY = 8
BLOCK_DOCS = 512
#: Entries in a block, but for a block of one document.
BLOCK_ENTRIES = 1 << 19
#: Documents of one block, times terms of a group of items, that are bounded together.
BOUND_CELLS = 1 << 21

INDEX = (
    "n_docs bigint, n_terms bigint, doc_ids array<bigint>, lengths binary, slices binary, "
    "vocab binary, df binary, first binary, term binary, tf binary"
)
_ARROW = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


@dataclass(frozen=True)
class SearchParams:
    k: int = 20
    #: Items that one pass over the index answers, and their terms; more take further passes.
    items_at_once: int = 4096
    terms_at_once: int = 1 << 20
    #: One of so many blocks gives the first thresholds.
    threshold_share: int = 16

    def __post_init__(self) -> None:
        if min(self.k, self.items_at_once, self.terms_at_once, self.threshold_share) < 1:
            raise ValueError("all parameters must be at least 1")


def _narrow(a: np.ndarray) -> bytes:
    """Smallest of the types of ``_wide`` that holds the counts, told by its first byte."""
    top = int(a.max(initial=0))
    kind = next(k for k, t in enumerate((np.uint8, np.uint16, np.uint32, np.uint64)) if top <= np.iinfo(t).max)
    return bytes([kind]) + a.astype((np.uint8, np.uint16, np.uint32, np.uint64)[kind]).tobytes()


def _wide(b: bytes) -> np.ndarray:
    return np.frombuffer(b, (np.uint8, np.uint16, np.uint32, np.uint64)[b[0]], offset=1).astype(np.int64)


def _entry_hashes(terms: np.ndarray, level: int) -> list[np.ndarray]:
    """Slice numbers of terms at a level, before they are folded to the slices there are."""
    seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))
    a = mix(terms ^ seed)
    b = mix(a) | np.uint64(1)
    return [a + np.uint64(j) * b for j in range(HASHES)]


# --- index ----------------------------------------------------------------------------------


def _terms(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """Row, distinct term hashes in order, their counts and the number of terms."""
    for part in slices(column):
        hashes, first = part.words(ALPHANUMERIC)
        for i in range(part.rows):
            own = hashes[first[i] : first[i + 1]]
            if len(own):
                terms, counts = np.unique(own, return_counts=True)
                yield part.first + i, terms, counts, len(own)


def _block(docs: list[tuple]) -> list:
    """Columns of ``INDEX`` for some documents ``(id, terms, counts, length)``."""
    ids, terms, counts, lengths = zip(*docs)
    sizes = np.array([len(t) for t in terms])
    vocab, term = np.unique(np.concatenate(terms), return_inverse=True)
    tf, doc = np.concatenate(counts), np.repeat(np.arange(len(docs)), sizes)
    entries = np.zeros(len(docs), np.int64)
    for least in LEVELS:
        entries += np.bincount(doc[tf >= least], minlength=len(docs))
    n_slices = SLICES_PER_ENTRY << int(entries.max() - 1).bit_length()
    bits = np.zeros((n_slices, -(-len(docs) // 8) * 8), np.uint8)
    all_terms = np.concatenate(terms)
    for level, least in enumerate(LEVELS):
        here = tf >= least
        for h in _entry_hashes(all_terms[here], level):
            bits[(h & np.uint64(n_slices - 1)).astype(np.int64), doc[here]] = 1
    df = np.bincount(term, minlength=len(vocab))
    first = np.concatenate([[0], np.cumsum(sizes)])
    packed = np.packbits(bits, axis=1, bitorder="little").tobytes()
    return [
        len(docs), sum(lengths), list(ids), _narrow(np.array(lengths)), packed,
        vocab.astype("<u8").tobytes(), _narrow(df), _narrow(first), _narrow(term), _narrow(tf),
    ]


def build_index(docs: DataFrame) -> DataFrame:
    """The blocks of all documents that have a term; write it before it is searched."""

    names = [c.split(" ", 1) for c in INDEX.split(", ")]
    schema = pa.schema([(n, _ARROW[t]) for n, t in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_blocks: dict[int, list[tuple]] = {}

        def batch_of(docs: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(_block(docs), schema)], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for row, terms, counts, n in _terms(batch.column(1)):
                entries = sum(int((counts >= least).sum()) for least in LEVELS)
                size = (entries - 1).bit_length()
                some = open_blocks.setdefault(size, [])
                some.append((ids[row], terms, counts, n))
                if len(some) >= min(BLOCK_DOCS, max(1, BLOCK_ENTRIES >> size)):
                    yield batch_of(open_blocks.pop(size))
        for some in open_blocks.values():
            yield batch_of(some)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, INDEX)


# --- items ----------------------------------------------------------------------------------


def _item_terms(items: DataFrame) -> DataFrame:
    """``row, item_id, terms, counts``: the distinct terms of each item that has any."""

    schema = pa.schema([("row", pa.int64()), ("item_id", pa.int64()), ("terms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, item = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            cols: list[list] = [[], [], [], []]
            for i, terms, counts, _ in _terms(batch.column(2)):
                for c, v in zip(cols, (row[i], item[i], terms.view(np.int64), counts)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("bigint"), "text")
    return rows.mapInArrow(run, "row bigint, item_id bigint, terms array<bigint>, counts array<bigint>")


def _lots(items: DataFrame, params: SearchParams) -> Iterator[list]:
    """Items in lots that one pass answers; the driver holds one partition and one lot."""
    lot: list = []
    terms = 0
    for item in items.toLocalIterator():
        if lot and (len(lot) >= params.items_at_once or terms + len(item.terms) > params.terms_at_once):
            yield lot
            lot, terms = [], 0
        lot.append(item)
        terms += len(item.terms)
    if lot:
        yield lot


class _Lot:
    """Items of one pass: their terms with weights, in groups that are bounded together."""

    def __init__(self, items: list) -> None:
        self.rows = np.array([i.row for i in items], np.int64)
        self.item_ids = [i.item_id for i in items]
        terms = [np.array(i.terms, np.int64).view(np.uint64) for i in items]
        self.vocab = np.unique(np.concatenate(terms))
        self.terms = [np.searchsorted(self.vocab, t) for t in terms]
        self.counts = [np.array(i.counts, np.int64) for i in items]
        self.weights = np.zeros(len(self.vocab), np.int64)
        self.floor = np.zeros(len(items), np.int64)
        self.n = self.length = 0
        self.groups: list[tuple[list[int], np.ndarray]] = []

    def group(self) -> None:
        """Items whose terms together fit ``BOUND_CELLS``; a larger item is a group of its own.
        Terms that no document holds weigh nothing in any score."""
        used: set[int] = set()
        members: list[int] = []
        for i, terms in enumerate(self.terms):
            live = self.weights[terms] > 0
            self.terms[i], self.counts[i] = terms[live], self.counts[i][live]
            own = set(self.terms[i].tolist())
            if members and (len(used) + len(own)) * BLOCK_DOCS > BOUND_CELLS:
                self.groups.append((members, np.array(sorted(used), np.int64)))
                used, members = set(), []
            used |= own
            members.append(i)
        self.groups.append((members, np.array(sorted(used), np.int64)))


def _weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 ln((2n + 2) / (2 df + 1))); 0 for terms that no document holds."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds with ``tf`` occurrences in a document of norm ``m``."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _document_frequencies(index: DataFrame, lot: _Lot) -> np.ndarray:
    shared = index.sparkSession.sparkContext.broadcast(lot.vocab)
    schema = pa.schema([("term", pa.int64()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for vocab, df in zip(batch.column(0), batch.column(1)):
                vocab = np.frombuffer(vocab.as_py(), "<u8")
                at = np.minimum(np.searchsorted(vocab, wanted), len(vocab) - 1)
                total += np.where(vocab[at] == wanted, _wide(df.as_py())[at], 0)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], schema=schema)

    found = index.select("vocab", "df").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    out = np.zeros(len(lot.vocab), np.int64)
    for r in found.collect():  # at most the terms of one lot
        out[r.term] = r.df
    return out


# --- search ---------------------------------------------------------------------------------


class _Block:
    """One index block, opened."""

    def __init__(self, row: dict, lot: _Lot) -> None:
        self.docs = len(row["doc_ids"])
        self.ids = np.array([i if i is not None else 0 for i in row["doc_ids"]], np.int64)
        self.null = np.array([i is None for i in row["doc_ids"]])
        # 25 * n * N stays below 2**63 for texts of 10**6 terms and 10**11 documents
        self.norm = 75 + 25 * _wide(row["lengths"]) * lot.n // lot.length
        bits = np.frombuffer(row["slices"], np.uint8)
        self.slices = bits.reshape(-1, -(-self.docs // 8))
        self.vocab = np.frombuffer(row["vocab"], "<u8")
        first, self.tf = _wide(row["first"]), _wide(row["tf"])
        self.most = np.maximum.reduceat(self.tf, first[:-1])
        self.entry = np.repeat(np.arange(self.docs), np.diff(first)) * len(self.vocab) + _wide(row["term"])

    def bounds(self, hashes: list[list[np.ndarray]]) -> np.ndarray:
        """What each term (row) of weight 1 can add at most in each document (column)."""
        mask = np.uint64(len(self.slices) - 1)
        out = np.zeros((len(hashes[0][0]), self.docs))
        below = np.zeros(self.docs, np.int64)
        live = np.arange(len(out))
        seen = None
        for level, parts in enumerate(hashes):
            top = np.full(self.docs, LEVELS[level + 1] - 1) if level + 1 < len(LEVELS) else self.most
            gain = _gain(np.minimum(top, self.most), self.norm)
            for h in parts:
                held = self.slices[(h[live] & mask).astype(np.int64)]
                seen = held if seen is None else seen & held
            some = seen.any(axis=1)
            live, seen = live[some], seen[some]
            step = (gain - np.minimum(below, gain)).astype(float)
            out[live] += np.unpackbits(seen, axis=1, count=self.docs, bitorder="little") * step
            below = np.maximum(gain, below)
        return out

    def scores(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of documents for term hashes with weights."""
        at = np.minimum(np.searchsorted(self.vocab, terms), len(self.vocab) - 1)
        known = self.vocab[at] == terms
        keys = docs[:, None] * len(self.vocab) + at[known][None, :]
        place = np.minimum(np.searchsorted(self.entry, keys), len(self.entry) - 1)
        tf = np.where(self.entry[place] == keys, self.tf[place], 0)
        return (_gain(tf, self.norm[docs][:, None]) * weights[known][None, :]).sum(axis=1)


class _Best:
    """The best documents of one item so far."""

    def __init__(self, k: int, floor: int) -> None:
        self.k, self.floor = k, max(1, floor)
        self.score, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.floor
        score, ids, null = (np.concatenate([a, b[keep]]) for a, b in ((self.score, score), (self.ids, ids), (self.null, null)))
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.ids, self.null = score[order], ids[order], null[order]
        if len(order) == self.k:
            self.floor = max(self.floor, int(self.score[-1]))


def _search_blocks(index: DataFrame, lot: _Lot, k: int) -> DataFrame:
    """``row, item_id, doc_id, score``: the best documents of each task for each item."""
    shared = index.sparkSession.sparkContext.broadcast(lot)
    schema = pa.schema([("row", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = shared.value
        best = [_Best(k, int(f)) for f in lot.floor]
        hashed = [[_entry_hashes(lot.vocab[used], level) for level in range(len(LEVELS))] for _, used in lot.groups]
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block({f.name: batch.column(j)[i].as_py() for j, f in enumerate(batch.schema)}, lot)
                for (members, used), hashes in zip(lot.groups, hashed):
                    if len(used):
                        gains = block.bounds(hashes)
                        for item in members:
                            _search_item(block, lot, item, gains, used, best[item])
        for i, b in enumerate(best):
            n = len(b.score)
            if n:
                row, item = pa.array(np.full(n, lot.rows[i])), pa.array([lot.item_ids[i]] * n, pa.int64())
                yield pa.RecordBatch.from_arrays([row, item, pa.array(b.ids, mask=b.null), pa.array(b.score)], schema=schema)

    return index.mapInArrow(run, "row bigint, item_id bigint, doc_id bigint, score bigint")


def _search_item(block: _Block, lot: _Lot, item: int, gains: np.ndarray, used: np.ndarray, best: _Best) -> None:
    terms = lot.terms[item]
    if not len(terms):
        return
    weights = lot.weights[terms] * lot.counts[item]
    # whole numbers below 2**53: exact in doubles
    bound = weights.astype(float) @ gains[np.searchsorted(used, terms)]
    left = np.flatnonzero(bound >= best.floor)
    hashes = lot.vocab[terms]
    if len(left) > best.k:  # the most promising first: they raise the threshold for the others
        order = np.argpartition(-bound[left], best.k - 1)
        lead, left = left[order[: best.k]], left[order[best.k :]]
        best.add(block.scores(lead, hashes, weights), block.ids[lead], block.null[lead])
        left = left[bound[left] >= best.floor]
    if len(left):
        best.add(block.scores(left, hashes, weights), block.ids[left], block.null[left])


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each item with their ``rank``, in two steps: no task sorts all
    that the tasks found for an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = F.pmod(F.xxhash64("doc_id", "score"), F.lit(64))
    part = F.row_number().over(Window.partitionBy("row", "part").orderBy(*order))
    found = found.withColumn("part", some).withColumn("rank", part).where(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(*order))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("part")


def search(index: DataFrame, items: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of each item, from a written index."""
    total = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("length")).first()
    out: list[DataFrame] = []
    for some in _lots(written(_item_terms(items)), params) if total.n else ():
        lot = _Lot(some)
        lot.n, lot.length = total.n, total.length
        lot.weights = _weights(_document_frequencies(index, lot), lot.n)
        lot.group()
        share = F.pmod(F.xxhash64("doc_ids"), F.lit(params.threshold_share)) == 0
        first = _top(_search_blocks(index.where(share), lot, params.k), params.k).where(F.col("rank") == params.k)
        at = {row: i for i, row in enumerate(lot.rows.tolist())}
        for r in first.select("row", "score").collect():  # one row for each item of the lot
            lot.floor[at[r.row]] = r.score
        out.append(written(_top(_search_blocks(index, lot, params.k), params.k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")))
    if not out:
        return index.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    found = out[0]
    for part in out[1:]:
        found = found.unionAll(part)
    return found


def search_documents(docs: DataFrame, items: DataFrame, params: SearchParams = SearchParams()) -> DataFrame:
    """``search`` over an index made for it."""
    return search(written(build_index(docs)), items, params)

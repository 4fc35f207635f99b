"""Packing of tokenised documents into sequences of a fixed length: best-fit, level by level.

1. Each document becomes token ids and one end id; a longer one than a sequence is cut into
   pieces, all full but the first.
2. Items go to groups of a few thousand by a hash. A group packs its items best-fit, largest
   first: each goes to the fullest bin that still has room. Bins that are nearly full are done.
3. The others move up as items of their own to groups that join ``fan_in`` groups each, where
   the same step runs again, until one group is left.

A bin travels as one row with its items, at most ``capacity`` of them. In a group at most one
bin is at most half full, so what is worth sending up is little; a group sends up its
``carry`` emptiest bins at most and closes the others as they are, which bounds every task
whatever the sizes are. Levels are tables in the shared folder.

Defined results. A null text is empty, an empty one is its end id alone. Repeated rows and
rows with null ids are items of their own. Ties of size go by the order in the group, which
changes which bin an item is in and never how many bins there are. No rows: no rows. Extra
columns are not looked at, whatever their names are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.llm.steps import written

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
_TEXTS_AT_ONCE = 1 << 22  # code points handed to the tokenizer together


@dataclass(frozen=True)
class PackParams:
    """``tokenizer`` is a file of the tokenizers library; ``ranks`` optionally the same
    byte-level vocabulary in ranks, read by a faster library; ``pattern`` its word pattern."""

    tokenizer: str
    ranks: str | None = None
    pattern: str | None = None
    end_id: int = 0
    capacity: int = 2048
    group_items: int = 4096
    fan_in: int = 16
    #: A bin with so few places left is done.
    slack: int = 8
    #: Bins that a group sends up, emptiest first.
    carry: int = 512

    def __post_init__(self) -> None:
        if self.capacity < 1 or self.group_items < 1 or self.fan_in < 2 or self.carry < 1 or not 0 <= self.slack < self.capacity:
            raise ValueError("capacity, group_items, carry >= 1, fan_in >= 2, 0 <= slack < capacity")


# --- tokens ---------------------------------------------------------------------------------


def _encoder(params: PackParams):
    """Texts to arrays of ids, as the tokenizers file says."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(params.tokenizer)
    whole.no_truncation()
    whole.no_padding()

    def by_file(texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in whole.encode_batch_fast(texts, add_special_tokens=False)]

    if params.ranks is None:
        return by_file
    import base64

    import tiktoken

    with open(params.ranks, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=params.pattern, mergeable_ranks=ranks, special_tokens=special)
    known = frozenset(special)

    def by_ranks(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            try:
                out.append(fast.encode_to_numpy(text, allowed_special=known))
            except ValueError:  # its pattern matcher gives up on a million blanks in a row
                out.append(by_file([text])[0])
        return out

    return by_ranks


def _cut(ids: np.ndarray, params: PackParams) -> tuple[np.ndarray, list[int]]:
    """Ids with the end, and where the pieces begin (and the last ends)."""
    ids = np.append(ids.astype("<u4", copy=False), np.array([params.end_id], "<u4"))
    n, cap = len(ids), params.capacity
    first = n % cap or cap
    return ids, [0, *range(first, n + 1, cap)]


def token_pieces(docs: DataFrame, params: PackParams) -> DataFrame:
    """``doc_id, piece, start, length, ids``: the ids of a piece as little-endian 32 bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(params)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            ids_in, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids_in):
                end, size = at, 0
                some = []
                while end < len(ids_in) and size < _TEXTS_AT_ONCE:
                    some.append(texts[end].as_py() or "")
                    size += len(some[-1])
                    end += 1
                cols: list[list] = [[], [], [], [], []]
                for doc, found in zip(ids_in[at:end], encode(some)):
                    ids, cuts = _cut(found, params)
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for c, v in zip(cols, (doc, k, a, b - a, ids[a:b].tobytes())):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
                at = end

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


# --- packing --------------------------------------------------------------------------------


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item, largest items first. Open bins are kept by room left, and a
    bit for each room in use finds the tightest one."""
    order = np.argsort(-sizes, kind="stable")
    bins = np.zeros(len(sizes), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, made = 0, 0
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, made = capacity, made, made + 1
        bins[i] = b
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _merge(fill: np.ndarray, items: pa.ListArray, bins: np.ndarray) -> tuple[np.ndarray, pa.ListArray]:
    """The rows of the new bins: their fill and the items of all rows in them."""
    order = np.argsort(bins, kind="stable")
    begins = np.flatnonzero(np.diff(bins[order], prepend=-1))
    merged = items.take(pa.array(order))
    offsets = merged.offsets.to_numpy()
    out = pa.ListArray.from_arrays(pa.array(np.append(offsets[begins], offsets[-1]) - offsets[0], pa.int32()), merged.flatten())
    return np.add.reduceat(fill[order], begins), out


def pack(items: DataFrame, size: str, params: PackParams) -> DataFrame:
    """All columns of ``items``, and ``sequence_id, offset``: where each item lies.

    ``size`` names a column of whole numbers from 1 to ``capacity``. ``items`` should be a
    written table: it is counted first, to fix the number of groups.
    """
    if {"sequence_id", "offset"} & {c.lower() for c in items.columns}:
        raise ValueError("items must not have columns named sequence_id or offset")
    spark = items.sparkSession
    groups = max(1, -(-items.count() // params.group_items))
    # not by a hash of the columns: repeated rows must not meet in one group
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))
    rows = items.select(
        spread.alias("g"),
        F.col(size).cast("bigint").alias("fill"),
        F.array(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(items.columns)])).alias("items"),
    )
    item = rows.schema["items"].dataType.simpleString()
    schema = f"g bigint, k bigint, fill bigint, done boolean, items {item}"
    done: list[DataFrame] = []
    level = 0
    while True:
        last = groups == 1
        rows = written(rows.groupBy("g").applyInArrow(_level(params, last), schema))
        tag = F.lit(level).cast("bigint") * F.lit(1 << 56) + F.col("g") * F.lit(1 << 24) + F.col("k")
        done.append(rows.where("done").select(tag.alias("sequence_id"), "items"))
        if last:
            break
        groups = -(-groups // params.fan_in)
        rows = rows.where("not done").select(F.expr(f"g div {params.fan_in}").alias("g"), "fill", "items")
        level += 1
    out = done[0]
    for part in done[1:]:
        out = out.unionAll(part)
    names = [f"c{i}" for i in range(len(items.columns))]
    place = F.transform("items", lambda x: x[f"c{items.columns.index(size)}"].cast("bigint"))
    # running sums of at most `capacity` sizes
    running = F.aggregate(
        place,
        F.expr("named_struct('sum', 0L, 'at', cast(array() as array<bigint>))"),
        lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["at"], F.array(s["sum"])).alias("at")),
    )["at"]
    out = out.select("sequence_id", F.inline(F.arrays_zip(F.col("items").alias("item"), running.alias("offset"))))
    return out.select(*[F.col("item")[n].alias(c) for n, c in zip(names, items.columns)], "sequence_id", "offset").select(
        *[F.col(f"`{c}`") for c in items.columns], "sequence_id", "offset"
    )


def _level(params: PackParams, last: bool):
    """Best-fit of one group's rows; what is nearly full, or not worth sending up, is done."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fill = table.column("fill").to_numpy()
        items = table.column("items").combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
        fill, items = _merge(fill, items, best_fit(fill, params.capacity))
        done = params.capacity - fill <= params.slack
        if last:
            done[:] = True
        else:
            open_bins = np.flatnonzero(~done)
            emptiest = open_bins[np.argsort(fill[open_bins], kind="stable")]
            done[emptiest[params.carry :]] = True
        g = table.column("g")[0].as_py()
        n = len(fill)
        return pa.table({"g": pa.array(np.full(n, g)), "k": pa.array(np.arange(n)), "fill": pa.array(fill), "done": pa.array(done), "items": items})

    return run


def pack_documents(docs: DataFrame, params: PackParams) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: one row for each piece.

    Only the digests of the ids travel. ``packed_ids`` gives the ids themselves.
    """
    pieces = token_pieces(docs, params)
    pieces = written(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(pieces, "length", params)


def packed_ids(docs: DataFrame, params: PackParams) -> DataFrame:
    """``sequence_id, length, ids``: the packed sequences, ids as little-endian 32 bit."""
    pieces = written(token_pieces(docs, params).withColumn("row", F.monotonically_increasing_id()))
    placed = pack(pieces.select("row", "length"), "length", params)
    joined = placed.select("row", "sequence_id", "offset").join(pieces.select("row", "length", "ids"), "row")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `capacity` of them
    out = joined.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b"").cast("binary"), lambda s, p: F.concat(s, p["ids"]))
    return out.select("sequence_id", "length", ids.alias("ids"))

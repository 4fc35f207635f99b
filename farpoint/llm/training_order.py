"""Training order: token sequences in the order of a keyed permutation, in fixed-stride shards."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.llm.words import mix, slices
from farpoint.plans.tables import shared_folder

READ_RECORDS = 1024  # records a reader fetches together
END = 0xFF  # ends a text and fills the last sequence of a partition; never a byte of UTF-8


@dataclass(frozen=True)
class OrderParams:
    length: int = 1024  # tokens of a sequence; a token is one byte
    per_shard: int = 32_768  # sequences of a shard
    key: str = "epoch-0"
    rounds: int = 4

    @property
    def stride(self) -> int:
        """Bytes from one record to the next: the tokens and one newline."""
        return self.length + 1


@dataclass(frozen=True)
class Order:
    """Bijection of ``0 .. n - 1``: a Feistel network over the next even number of bits, and
    walking its cycle until a value falls below ``n``."""

    n: int
    key: str
    rounds: int = 4

    @property
    def half(self) -> int:
        return max(1, (max(self.n - 1, 1).bit_length() + 1) // 2)

    def _keys(self) -> list[np.uint64]:
        return [np.uint64(int.from_bytes(hashlib.sha256(f"{self.key}/{i}".encode()).digest()[:8], "big")) for i in range(self.rounds)]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        bits, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for k in reversed(self._keys()) if back else self._keys():
            if back:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        return (left << bits) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = self._once(np.asarray(x, np.uint64), back)
        while (out := x >= self.n).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        return self._walk(sequences, False)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, True)


def _tokens(batches):
    """The bytes of the texts, each with an end, in lots of about a slice."""
    for b in batches:
        for s in slices(b.column(1)):
            yield s.first, b, np.insert(s.data, s.offsets[1:], END), s.offsets + np.arange(len(s.offsets))


def _counted(texts: DataFrame, p: OrderParams) -> list[tuple[int, int]]:
    """Sequences of each partition: one row per partition reaches the driver."""

    def run(batches):
        total = sum(len(t) for _, _, t, _ in _tokens(batches))
        n = -(-total // p.length)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([n])], names=["part", "n"])

    return sorted((r.part, r.n) for r in texts.mapInArrow(run, "part long, n long").collect())


def _sequences(texts: DataFrame, p: OrderParams, firsts: dict[int, tuple[int, int]], order: Order, tokens: bool) -> DataFrame:
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches):
        first, n = firsts[TaskContext.get().partitionId()]
        made, rest, owner = 0, np.zeros(0, np.uint8), None

        def out(data: np.ndarray, owners: list):
            m = len(data) // p.length
            number = np.arange(first + made, first + made + m)
            slot = order.slots(number)
            cols = [pa.array(slot), pa.array(number), pa.array(owners)]
            names = ["slot", "sequence", "first_doc"]
            if tokens:
                offsets = pa.py_buffer((np.arange(m + 1) * p.length).astype(np.int32))
                cols.append(pa.BinaryArray.from_buffers(pa.binary(), m, [None, offsets, pa.py_buffer(np.ascontiguousarray(data[: m * p.length]))]))
                names.append("tokens")
            cols[2] = cols[2].cast(arrow_kind)
            return pa.RecordBatch.from_arrays(cols, names=names)

        for at, b, data, ends in _tokens(batches):
            arrow_kind = b.column(0).type
            docs = b.column(0).slice(at, len(ends) - 1).to_pylist()
            full = np.concatenate([rest, data])
            m = len(full) // p.length
            # the document that the first token of a sequence belongs to
            own = np.searchsorted(ends, np.arange(m + 1) * p.length - len(rest), "right") - 1
            owners = [owner if i < 0 else docs[min(i, len(docs) - 1)] for i in own]
            if m:
                yield out(full, owners[:m])
            made += m
            left = full[m * p.length :]
            owner, rest = (owners[m] if len(left) else None), left
        if len(rest):
            last = np.concatenate([rest, np.full(p.length - len(rest), END, np.uint8)])
            yield out(last, [owner])
            made += 1
        if made != n:
            raise ValueError("the input gave other rows than when it was counted; write it to a table first")

    return texts.mapInArrow(run, f"slot long, sequence long, first_doc {kind}" + ", tokens binary" * tokens)


def materialise(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, params: OrderParams | None = None) -> tuple[DataFrame, str]:
    """Write all texts as token sequences in training order; returns the index and the folder.

    Tokens are the bytes of the UTF-8 text and one ``END`` after it; a partition's texts stand
    one after the other and are cut every ``length`` tokens, the last sequence is filled with
    ``END``. Sequence numbers follow the partitions of the input; slot = keyed permutation of
    the number. Shard ``i`` is the folder ``shard=i`` with one file of ``per_shard`` records of
    ``stride`` bytes (the last one shorter), record ``j`` at byte ``j * stride``, so a reader
    that stopped goes on at any slot. The manifest is written when all shards are.

    The index has one row per sequence: ``slot``, ``sequence``, ``first_doc`` (the text its
    first token is of), ``shard``, ``offset``. Null and empty texts are one ``END``; repeated
    rows are written again; other columns are ignored; an empty table writes no shard.

    ``df`` must give the same rows in the same partitions when read twice, as a scan of files
    does; otherwise an error is raised.
    """
    p = params or OrderParams()
    spark = df.sparkSession
    texts = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    firsts, total = {}, 0
    for part, n in _counted(texts, p):
        firsts[part] = (total, n)
        total += n
    order = Order(total, p.key, p.rounds)
    path = path or f"{shared_folder(spark).rstrip('/')}/training-order-{uuid.uuid4().hex}"
    shard = F.floor(F.col("slot") / p.per_shard).cast("int")
    if total:
        shards = -(-total // p.per_shard)
        rows = _sequences(texts, p, firsts, order, True).withColumn("shard", shard)
        rows = rows.select("shard", "slot", F.col("tokens").cast("string").alias("value"))
        rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "slot")
        rows.select("shard", "value").write.partitionBy("shard").option("lineSep", "\n").text(path)
    manifest = spark.createDataFrame([(total, p.length, p.per_shard, p.key, p.rounds)], _MANIFEST)
    manifest.coalesce(1).write.json(f"{path}/_manifest")  # last: it says that the shards are whole
    index = _sequences(texts, p, firsts, order, False).withColumn("shard", shard)
    return index.withColumn("offset", (F.col("slot") % p.per_shard) * p.stride), path


_MANIFEST = "sequences long, length int, per_shard int, key string, rounds int"


def read_manifest(spark: SparkSession, path: str) -> tuple[int, OrderParams]:
    """Number of sequences below ``path`` and the parameters they were written with."""
    m = spark.read.schema(_MANIFEST).json(f"{path}/_manifest").first()
    return m.sequences, OrderParams(length=m.length, per_shard=m.per_shard, key=m.key, rounds=m.rounds)


def read_from(spark: SparkSession, path: str, slot: int = 0, params: OrderParams | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Records from a slot on, shard by shard: (slot, tokens) up to the last one.

    Reading starts at the record's byte; nothing before it is fetched. The manifest says how
    many records there are: a shard that is missing or not whole is an error, and so are
    ``params`` other than those of the manifest.
    """
    total, p = read_manifest(spark, path)
    if params is not None and params != p:
        raise ValueError(f"{path} was written with {p}")
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    while slot < total:
        shard, skip = divmod(slot, p.per_shard)
        held = min(p.per_shard, total - shard * p.per_shard)
        folder = path_of(f"{path}/shard={shard}")
        store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        files = [f for f in store.listStatus(folder) if f.getPath().getName().startswith("part-")] if store.exists(folder) else []
        if len(files) != 1 or files[0].getLen() != held * p.stride:
            raise ValueError(f"shard {shard} of {path} is not whole")
        stream = store.open(files[0].getPath())
        try:
            stream.seek(skip * p.stride)
            while skip < held:
                data = bytes(stream.readNBytes(min(READ_RECORDS, held - skip) * p.stride))
                for at in range(0, len(data), p.stride):
                    yield shard * p.per_shard + skip, np.frombuffer(data, np.uint8, p.length, at)
                    skip += 1
        finally:
            stream.close()
        slot = (shard + 1) * p.per_shard

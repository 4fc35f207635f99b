"""Rows of one key put together to one row, within a task and without a shuffle."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

from farpoint.functions.grid import LAST_INDEX

# executors need not have this package installed: its functions travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS_AT_ONCE = 200_000  # rows a task holds before it puts them together
PACK_ROWS = 1_000  # of a pack at most
NO_CELL = LAST_INDEX + 1  # of the row that says how far the arrivals are


def _flat(column: pa.Array) -> list[np.ndarray]:
    """The whole numbers of a column, or of each place of a column of lists of one length."""
    if not pa.types.is_list(column.type):
        return [column.to_numpy(zero_copy_only=False)]
    return list(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).T)


def packer(by: list[str], out: str, crowd: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Function for ``mapInArrow``: rows of ``pane``, ``by``, ``arrival``, ``out`` and ``clears`` to
    rows of ``arrival`` (the latest), ``by`` and the list of ``out``.

    Groups with more than ``crowd`` rows that clear are left out. An empty list under a key of its
    own has the latest arrival of all rows, which a watermark goes by.
    """

    def packed(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        columns = {c: table[c].chunk(0) for c in table.column_names}
        keys = [columns["pane"].to_numpy(zero_copy_only=False), *[k for c in by for k in _flat(columns[c])]]
        order = np.lexsort(keys)
        begins = np.ones(len(order), bool)
        begins[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
        first = np.flatnonzero(begins)
        sizes = np.diff(first, append=len(order))
        place = np.arange(len(order)) - np.repeat(first, sizes)
        if crowd is not None:
            clears = columns["clears"].to_numpy(zero_copy_only=False).astype(np.int64)
            stays = np.repeat(np.add.reduceat(clears[order], first) <= crowd, sizes)
            order, place = order[stays], place[stays]
        first = np.flatnonzero(place % PACK_ROWS == 0)
        at = pc.cast(columns["arrival"], pa.int64()).to_numpy(zero_copy_only=False)
        latest = np.maximum.reduceat(at[order], first) if len(first) else at[:0]
        arrival = pa.array(np.append(latest, at.max())).cast(columns["arrival"].type)
        heads = order[first]
        made = [arrival]
        for c in by:
            none = [[NO_CELL] * (len(columns[c][0]))] if pa.types.is_list(columns[c].type) else [NO_CELL]
            made.append(pa.concat_arrays([columns[c].take(pa.array(heads)), pa.array(none, columns[c].type)]))
        offsets = np.append(first, [len(order), len(order)]).astype(np.int32)
        made.append(pa.ListArray.from_arrays(pa.array(offsets), columns[out].take(pa.array(order))))
        return pa.RecordBatch.from_arrays(made, names=["arrival", *by, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ROWS_AT_ONCE:
                yield packed(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield packed(pa.Table.from_batches(held))

    return run

"""Nearest members of hash buckets, for use in tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# executors need not have this package installed: its functions travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "win bigint, point_id bigint, neighbor_id bigint, distance double"
TILE = 1 << 20  # question-point pairs worked on at a time


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def finder(top: int, radius: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of two Arrow tables, questions and points, both with ``key`` and ``coords``:
    for each question the ``top`` nearest other points of its key, within the radius if there
    is one. Equal distances go by id. Squares are added in dimension order."""

    def tile(x: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        total = np.zeros((len(x), len(y)))
        for j in range(x.shape[1]):
            gap = x[:, j, None] - y[None, :, j]
            total += gap * gap
        gap = np.sqrt(total)
        met = own[:, None] != ids[None, :]
        if radius is not None:
            met &= gap <= radius
        elif len(y) > top + 1:  # itself may be among them
            met &= gap <= np.partition(gap, top, axis=1)[:, top, None]
        row, col = np.nonzero(met)
        gap = gap[row, col]
        order = np.lexsort((ids[col], gap, row))
        row, col, gap = row[order], col[order], gap[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < top
        return row[keep], ids[col[keep]], gap[keep]

    def find(questions: pa.Table, points: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if questions.num_rows and points.num_rows:
            key = points["key"].to_numpy()
            order = np.argsort(key, kind="stable")
            key, y, ids = key[order], _matrix(points["coords"])[order], points["point_id"].to_numpy()[order]
            asked = questions["key"].to_numpy()
            by_key = np.argsort(asked, kind="stable")
            asked, x = asked[by_key], _matrix(questions["coords"])[by_key]
            own, win = questions["point_id"].to_numpy()[by_key], questions["win"].to_numpy()[by_key]
            begins = np.flatnonzero(np.diff(asked, prepend=asked[0] - 1))
            for a, b in zip(begins, np.append(begins[1:], len(asked))):
                lo, hi = np.searchsorted(key, [asked[a], asked[a] + 1] if asked[a] < np.iinfo(np.int64).max else [asked[a]] * 2)
                if asked[a] == np.iinfo(np.int64).max:
                    hi = len(key)
                step = max(1, TILE // max(1, hi - lo))
                for i in range(a, b, step) if hi > lo else ():
                    j = min(i + step, b)
                    row, near, gap = tile(x[i:j], own[i:j], y[lo:hi], ids[lo:hi])
                    for c, v in zip(out, (win[i:j][row], own[i:j][row], near, gap)):
                        c.append(v)
        columns = [np.concatenate(c) for c in out]
        return pa.table(dict(zip(["win", "point_id", "neighbor_id", "distance"], columns)))

    return find

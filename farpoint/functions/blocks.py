"""Distance counts of one lot of queries against one lot of points, for use in tasks."""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# executors need not have this package installed: its functions travel with the job
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "point_id bigint, us bigint, wmin bigint, wmax bigint, pane bigint, n bigint"
TILE = 1 << 20  # query-point pairs worked on at a time
NEAR_TILE = 1 << 17  # of them in few dimensions, where a tile stays in the cache
PARTS = (9, 5, 3)  # small cells and boxes to the radius: the most parts with as many queries to a cell as follows
CROWD = 24


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1)


def counter(radius: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of two Arrow tables: per query and pane, the points within the radius.

    Squares are added in dimension order, as in the column expressions.
    """

    def count(queries: pa.Table, points: pa.Table) -> pa.Table:
        names = ["point_id", "us", "wmin", "wmax"]
        empty = {c: np.empty(0, dtype=np.int64) for c in [*names, "pane", "n"]}
        if queries.num_rows == 0 or points.num_rows == 0:
            return pa.table(empty)
        x, y = _matrix(queries["coords"]), _matrix(points["other"])
        panes, at = np.unique(points["pane"].to_numpy(), return_inverse=True)
        order = np.argsort(at, kind="stable")
        y, weight = y[order], points["n"].to_numpy()[order]
        starts = np.searchsorted(at[order], np.arange(len(panes)))
        low, high = queries["plo"].to_numpy(), queries["phi"].to_numpy()
        by_dim = np.ascontiguousarray(y.T)
        step = max(1, TILE // len(y))
        rows, cols, sums = [], [], []
        for first in range(0, len(x), step):
            part = x[first : first + step]
            total = np.zeros((len(part), len(y)))
            for j in range(x.shape[1]):
                gap = part[:, j, None] - by_dim[j]
                gap *= gap
                total += gap
            hits = np.where(np.sqrt(total) <= radius, weight, 0)
            per_pane = np.add.reduceat(hits, starts, axis=1)
            asked = (panes >= low[first : first + step, None]) & (panes <= high[first : first + step, None])
            r, c = np.nonzero((per_pane > 0) & asked)
            rows.append(r + first)
            cols.append(c)
            sums.append(per_pane[r, c])
        row = np.concatenate(rows)
        out = {c: queries[c].to_numpy()[row] for c in names}
        out["pane"] = panes[np.concatenate(cols)]
        out["n"] = np.concatenate(sums).astype(np.int64)
        return pa.table(out)

    return count


def _last_square(radius: float) -> float:
    """The largest double whose root is within the radius."""
    s = radius * radius
    while np.sqrt(s) > radius:
        s = np.nextafter(s, 0.0)
    while np.sqrt(np.nextafter(s, np.inf)) <= radius:
        s = np.nextafter(s, np.inf)
    return float(s)


def _runs(keys: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin in sorted columns, and their end."""
    begins = np.ones(len(keys[0]), bool)
    begins[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(begins), len(begins))


def _sorted(keys: list[np.ndarray]) -> list[np.ndarray]:
    order = np.lexsort(keys)
    return [k[order] for k in keys]


def _counted(hits: np.ndarray) -> np.ndarray:
    """How many are true in each row."""
    return np.bitwise_count(np.packbits(hits, axis=1)).sum(axis=1)


def _few_true(mask: np.ndarray) -> np.ndarray:
    """Places of what is true, which is little, in the rows put end to end."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64))
    places = np.concatenate([(eights[:, None] * 8 + np.arange(8)).ravel(), np.arange(whole, len(flat))])
    return places[flat[places]]


def near_counter(radius: float, dims: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """As ``counter`` for few dimensions: queries of a small cell meet boxes of points, and only
    the points of boxes that their spheres may cut are compared one by one. Rounding is monotone, so
    the bounds of a box never contradict its points. Single floats compare, relative to a corner of the
    cell and in units of the radius; only pairs too near to the sphere for them are squared in doubles."""
    limit, unsure = _last_square(radius), (dims + 4) * 2e-6
    xs = [f"x{i}" for i in range(dims)]

    def sums(gaps: list[np.ndarray]) -> np.ndarray:
        total = gaps[0] * gaps[0]
        for g in gaps[1:]:
            total += g * g
        return total

    def count(queries: pa.Table, points: pa.Table) -> pa.Table:
        names = ["point_id", "wmin", "wmax"]
        out = {c: [] for c in ["row", "pane", "n"]}
        if queries.num_rows and points.num_rows:
            x, y = ([t[c].to_numpy() for c in xs] for t in (queries, points))
            panes, at = np.unique(points["pane"].to_numpy(), return_inverse=True)
            for parts in PARTS:
                side = radius / parts
                if len(x[0]) >= CROWD * (len(_runs(_sorted([np.floor(v / side) for v in x]))) - 1):
                    break
            order = np.lexsort([*[np.floor(v / side) for v in y], at])
            y, at, weight = [v[order] for v in y], at[order], points["n"].to_numpy()[order].astype(float)
            plain = bool((weight == 1).all())
            first = _runs([at, *[np.floor(v / side) for v in y]])
            begin, length = first[:-1], np.diff(first)
            lo, hi = ([f.reduceat(v, begin) for v in y] for f in (np.minimum, np.maximum))
            held, pane = np.add.reduceat(weight, begin), at[begin]
            fine = [np.floor(v / side) for v in x]
            wide = [np.floor(v / radius) for v in x]
            rank = np.lexsort([*fine, *wide])
            x, fine, wide = ([v[rank] for v in c] for c in (x, fine, wide))
            low, high = queries["plo"].to_numpy()[rank], queries["phi"].to_numpy()[rank]
            coarse, cells = _runs(wide), _runs([*wide, *fine])

            def bounds(a: int, b: int) -> tuple[list[float], list[float]]:
                return [v[a:b].min() for v in x], [v[a:b].max() for v in x]

            def reached(ql: list[float], qh: list[float], boxes: np.ndarray) -> np.ndarray:
                gaps = [np.maximum(np.maximum(l[boxes] - b, a - h[boxes]), 0) for l, h, a, b in zip(lo, hi, ql, qh)]
                return boxes[sums(gaps) <= limit]

            every = np.arange(len(begin))
            for c, d in zip(coarse[:-1], coarse[1:]):
                around = reached(*bounds(c, d), every)
                some = cells[np.searchsorted(cells, c) : np.searchsorted(cells, d) + 1]
                for a, b in zip(some[:-1], some[1:]):
                    ql, qh = bounds(a, b)
                    near = reached(ql, qh, around)
                    far = [np.maximum(hi[i][near] - ql[i], qh[i] - lo[i][near]) for i in range(dims)]
                    inside = sums(far) <= limit
                    whole = near[inside]
                    n = np.tile(np.bincount(pane[whole], held[whole], len(panes)).astype(float), (b - a, 1))
                    cut = near[~inside]
                    ends = np.cumsum(length[cut])
                    if len(cut):
                        place = np.arange(ends[-1]) + np.repeat(begin[cut] - (ends - length[cut]), length[cut])
                        z, w = [v[place] for v in y], weight[place]
                        split = np.searchsorted(at[place], np.arange(len(panes) + 1))
                        with np.errstate(over="ignore", invalid="ignore"):  # cells of huge numbers may be wide
                            u = np.stack([(v - c0) / radius for v, c0 in zip(z, ql)])
                            v = np.stack([(v[a:b] - c0) / radius for v, c0 in zip(x, ql)], axis=1)
                            left = np.column_stack([-2 * v, (v * v).sum(axis=1), np.ones(b - a)]).astype(np.float32)
                            right = np.vstack([u, np.ones(len(place)), (u * u).sum(axis=0)]).astype(np.float32)
                            slow = not ((v * v).sum(axis=1).max() < 6 and (u * u).sum(axis=0).max() < 6)
                        step = min(b - a, 512)
                        width = NEAR_TILE // step
                        for k in np.flatnonzero(np.diff(split)):
                            for f in range(split[k], split[k + 1], width):
                                g = min(f + width, split[k + 1])
                                for i in range(a, b, step):
                                    j = min(i + step, b)
                                    if slow:
                                        hits = sums([v[i:j, None] - u[f:g] for v, u in zip(x, z)]) <= limit
                                    else:
                                        s2 = left[i - a : j - a] @ right[:, f:g]
                                        hits = s2 <= 1 - unsure
                                        r, c = divmod(_few_true(hits != (s2 <= 1 + unsure)), g - f)
                                        hits[r, c] = sums([v[i + r] - u[f + c] for v, u in zip(x, z)]) <= limit
                                    n[i - a : j - a, k] += _counted(hits) if plain else hits @ w[f:g]
                    asked = (panes >= low[a:b, None]) & (panes <= high[a:b, None])
                    r, k = np.nonzero((n > 0) & asked)
                    for name, v in zip(out, (rank[a + r], panes[k], n[r, k].astype(np.int64))):
                        out[name].append(v)
        row, at, n = (np.concatenate([np.zeros(0, np.int64), *v]) for v in out.values())
        return queries.select(names).take(pa.array(row)).append_column("pane", pa.array(at)).append_column("n", pa.array(n))

    return count


def _drawn_together(a: np.ndarray, b: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers per column with gaps beyond ``reach`` shortened to one more than it: what
    is within reach keeps its distance, what is not stays out, and squares are exact doubles."""
    both = np.concatenate([a, b])
    out = np.empty(both.shape)
    for j in range(both.shape[1]):
        values, at = np.unique(both[:, j], return_inverse=True)
        out[:, j] = np.concatenate([[0], np.cumsum(np.minimum(np.diff(values), reach + 1))])[at]
    return out[: len(a)], out[len(a) :]


def cell_adder(limits: dict[str, int], left_out: int | None = None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of two Arrow tables of cells: each cell of the first with the sums ``n`` of the
    cells of the second up to each limit (squared). The last sum leaves out cells at ``left_out``."""
    reach = math.isqrt(max(limits.values()))

    def add(cells: pa.Table, others: pa.Table) -> pa.Table:
        sums = {name: np.zeros(cells.num_rows, dtype=np.int64) for name in limits}
        out = cells.select(["win", "cell", "n"])
        if cells.num_rows and others.num_rows:
            a, b = _drawn_together(_matrix(cells["cell"]), _matrix(others["near"]), reach)
            weight = others["n"].to_numpy().astype(float)
            x = np.column_stack([-2 * a, (a * a).sum(axis=1), np.ones(len(a))])
            y = np.vstack([b.T, np.ones(len(b)), (b * b).sum(axis=1)])
            step = max(1, TILE // len(b))
            for first in range(0, len(a), step):
                s2 = x[first : first + step] @ y
                for name, limit in limits.items():
                    near = s2 <= limit
                    if left_out is not None and name == list(limits)[-1]:
                        near &= s2 != left_out
                    sums[name][first : first + step] = near @ weight
        for name, total in sums.items():
            out = out.append_column(name, pa.array(total))
        return out

    return add


def own_clearer(radius: float, min_pts: int, names: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Function of one Arrow table: the ``names`` of the points that the others of the table do not clear."""
    clear = clearer(radius, min_pts, names)
    return lambda points: clear(points, pa.table({"other": points["coords"], "n": np.ones(points.num_rows)}))


def clearer(
    radius: float, min_pts: int, names: tuple[str, ...] | list[str] = ("point_id", "us", "coords", "wmin", "wmax")
) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Function of two Arrow tables: the queries that the points do not clear. Squares come from
    a product of matrices here, so what rounding could have brought within the radius is not counted."""

    def rest(queries: pa.Table, points: pa.Table) -> pa.Table:
        out = queries.select(list(names))
        if queries.num_rows == 0 or points.num_rows == 0:
            return out
        x, y = _matrix(queries["coords"]), _matrix(points["other"])
        weight = points["n"].to_numpy().astype(float)
        unsure = 8 * (x.shape[1] + 4) * np.finfo(float).eps
        stays = np.ones(len(x), dtype=bool)
        with np.errstate(all="ignore"):
            x2, y2 = (x * x).sum(axis=1) * (1 + unsure), (y * y).sum(axis=1) * (1 + unsure)
            for first in range(0, len(x), max(1, TILE // len(y))):
                part = slice(first, first + max(1, TILE // len(y)))
                near = x2[part, None] + y2 - 2 * (x[part] @ y.T) <= radius * radius * (1 - unsure)
                stays[part] = near @ weight - 1 < min_pts
        return out.filter(pa.array(stays))

    return rest

"""The definition, in numpy, on small data."""

import numpy as np
import pandas as pd


def windows_of(us, spec):
    if spec is None:
        return [0]
    return range((us - spec.size_us) // spec.slide_us + 1, us // spec.slide_us + 1)


def within_counts(coords, us, params, spec):
    """(win, point_id) -> number of other points within the radius."""
    members = {}
    for i, t in enumerate(us):
        for w in windows_of(int(t), spec):
            members.setdefault(w, []).append(i)
    out = {}
    for w, ids in members.items():
        x = coords[ids]
        total = np.zeros((len(ids), len(ids)))
        for j in range(x.shape[1]):
            total += (x[:, None, j] - x[None, :, j]) ** 2
        with np.errstate(invalid="ignore"):
            n = (np.sqrt(total) <= params.radius).sum(axis=1) - 1
        for i, c in zip(ids, n):
            out[(w, i)] = int(c)
    return out


def outliers(coords, us, params, spec):
    return {key for key, n in within_counts(coords, us, params, spec).items() if n < params.min_pts}


def to_points(spark, coords, us):
    frame = pd.DataFrame({"point_id": range(len(coords)), "us": us, "coords": [list(map(float, c)) for c in coords]})
    df = spark.createDataFrame(frame, "point_id bigint, us bigint, coords array<double>")
    return df.selectExpr("point_id", "timestamp_micros(us) AS arrival", "coords")


def found(df, spec):
    """Collected outliers as (win, point_id)."""
    rows = df.selectExpr("unix_micros(window_start) AS s", "point_id").collect()
    pairs = [(0 if spec is None else r.s // spec.slide_us, r.point_id) for r in rows]
    assert len(pairs) == len(set(pairs)), "a point is reported twice in a window"
    return set(pairs)

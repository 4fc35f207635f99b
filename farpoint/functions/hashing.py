"""Random-projection hash columns with a seeded, reproducible set of projections."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from farpoint.params import LshParams

#: round(ln n) of the largest count there can be, 2**63 - 1.
MOST_HASHES = 44


def projections(lsh: LshParams, dims: int, radius: float) -> list[list[tuple[list[float], float]]]:
    """Per table and hash: normal direction and uniform shift, drawn from the seed."""
    rng = random.Random(lsh.seed)
    width = lsh.width_for(radius)
    return [
        [
            ([rng.gauss(0.0, 1.0) for _ in range(dims)], rng.uniform(0.0, width))
            for _ in range(lsh.hashes or MOST_HASHES)
        ]
        for _ in range(lsh.num_tables)
    ]


def hash_vector(coords: Column, table: list[tuple[list[float], float]], width: float) -> Column:
    """Array of ``floor((a.x + b) / w)`` over the hashes of one table."""
    return F.array(*[F.floor(v) for v in hash_values(coords, table, width)])


def hash_values(coords: Column, table: list[tuple[list[float], float]], width: float) -> list[Column]:
    """``(a.x + b) / w`` of each hash of one table.

    The products are added in dimension order. Up to 16 dimensions the sum is written out
    and stays inside generated code; beyond that a literal array keeps the plan small.
    """

    def one(direction: list[float], shift: float) -> Column:
        if len(direction) <= 16:
            dot = reduce(lambda a, b: a + b, [coords[i] * F.lit(a) for i, a in enumerate(direction)])
        else:
            products = F.zip_with(coords, F.array(*[F.lit(a) for a in direction]), lambda x, a: x * a)
            dot = F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)
        return (dot + F.lit(shift)) / F.lit(width)

    return [one(a, b) for a, b in table]


def probe_sequence(values: Column, probes: int) -> Column:
    """Buckets that a question looks into: its own, then the ``probes`` likeliest others.

    ``values`` are the hashes before the floor. A perturbation moves one hash to the bucket
    below or above; its score is the squared distance to that border, and of a set of two the
    sum. The sets of lowest score come first; equal scores go by hash, then down before up.
    With scores in order, the n-th best set has only the n best single moves in it, so that
    many are combined. Sets of three and more are not formed.
    """
    own = F.transform(values, lambda v: F.floor(v))
    if not probes:
        return F.array(own)

    def moves(v: Column, i: Column) -> Column:
        low = v - F.floor(v)
        return F.array(*[
            F.struct((d * d).alias("score"), i.alias("i"), F.lit(step).cast("bigint").alias("step"))
            for d, step in ((low, -1), (F.lit(1.0) - low, 1))
        ])

    single = F.slice(F.array_sort(F.flatten(F.transform(values, moves))), 1, probes)

    def pairs(first: Column, at: Column) -> Column:
        later = F.filter(single, lambda m, j: (j > at) & (m["i"] != first["i"]))
        return F.transform(later, lambda m: F.struct((first["score"] + m["score"]).alias("score"), first["i"].alias("i"), first["step"].alias("step"), m["i"].alias("j"), m["step"].alias("other")))

    nothing = F.lit(-1), F.lit(0).cast("bigint")
    alone = F.transform(single, lambda m: F.struct(m["score"].alias("score"), m["i"].alias("i"), m["step"].alias("step"), nothing[0].alias("j"), nothing[1].alias("other")))
    sets = F.slice(F.array_sort(F.concat(alone, F.flatten(F.transform(single, pairs)))), 1, probes)

    def moved(s: Column) -> Column:
        return F.transform(own, lambda h, i: h + F.when(i == s["i"], s["step"]).otherwise(0) + F.when(i == s["j"], s["other"]).otherwise(0))

    return F.concat(F.array(own), F.transform(sets, moved))


def hash_count(n: Column, lsh: LshParams) -> Column:
    """k of a model over ``n`` points: round-half-up of ln n, at least 1."""
    if lsh.hashes is not None:
        return F.lit(lsh.hashes)
    k = F.round(F.log(n)).cast("int")
    return F.greatest(k, F.lit(1))

"""Near-duplicate join: exact Jaccard similarity of word shingles by adaptive prefixes.

1. Every text becomes its set of shingle hashes (64 bits each, in numpy). Texts with equal
   sets form one class; only classes are compared.
2. Shingles are ordered by how many documents of the whole table hold them (counted in hash
   buckets, so the counts have a fixed size), rare ones first.
3. Multi-match prefixes: two sets with similarity >= t share at least l shingles within the
   first ``n - ceil(t n) + l`` of either. Each class picks the l for which the estimated cost
   of its candidates is least; a pair must share the smaller l of its two classes.
4. Candidates are verified by intersecting the sets. Links within one component add nothing
   to the answer, so large groups are first hung below hubs (one verified link per class and
   round), and then only pairs of classes in *different* components are formed. No pair is
   lost, and a group of m near copies costs about m pairs and not m squared.

The order decides only the cost: any order gives the same links. Classes are told apart by
64 bit sums of their shingle hashes, sets are compared by 64 bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farpoint.llm.steps import bitmap_of, fresh, in_bitmap, min_links, shuffled, written
from farpoint.llm.words import Slice, grams, mix, slices


MARKS = 4  # words of 64 parities of a set


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5  # words of a shingle
    percent: int = 80  # 100 * intersection >= percent * union links two texts
    max_matches: int = 6  # longest extension of a prefix
    verify_cost: float = 8.0  # of one candidate, in posting entries
    bucket_bits: int = 18  # of the table of shingle frequencies
    hub_rounds: int = 4
    hub_share: int = 25  # percent of its prefix a class shares with a hub it is held against
    pairs_per_row: float = 3.0  # hubs are used until this few cross pairs are left
    chunk: int = 500  # classes that are listed in one row
    broadcast_roots: int = 500_000  # linked classes whose components are broadcast at most; more are joined by shuffle
    listed_alone: int = 8  # components with more classes under a shingle have lists of their own


def _sets(s: Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the number of the first of each."""
    hashes, first = s.words()
    runs, at = grams(hashes, first, k)
    counts = np.diff(at)
    short = np.flatnonzero((counts == 0) & (np.diff(first) > 0))
    if len(short):  # the whole sequence is the one shingle
        whole = []
        for r in short:
            own = hashes[first[r] : first[r + 1]]
            places = mix(np.arange(1, len(own) + 1, dtype=np.uint64) + np.uint64(len(own) << 32))
            whole.append(mix((own * (places | np.uint64(1))).sum(dtype=np.uint64).reshape(1)))
        runs = np.insert(runs, at[short], np.concatenate(whole))
        counts[short] = 1
    at = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        runs[a:b].sort()
    new = np.ones(len(runs) + 1, bool)
    new[1:-1] = runs[1:] != runs[:-1]
    new[at] = True
    kept = np.concatenate([[0], np.cumsum(new[:-1])])
    return runs[new[:-1]], kept[at]


def _class_ids(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each set: sums of scrambled hashes, 0 for the empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets + np.uint64(0x5BD1E995)), dtype=np.uint64)])
    total = sums[at[1:]] - sums[at[:-1]]
    ids = mix(total + np.diff(at).astype(np.uint64))
    return np.where(np.diff(at) == 0, np.uint64(0), ids)


def _parities(sets: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Each set as ``64 * MARKS`` parities: of how many of its shingles fall on each bit. Two
    sets differ in at least as many shingles as their parities differ in bits."""
    width = 64 * MARKS
    bit = (mix(sets ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(width)).astype(np.int64)
    out = np.zeros((len(at) - 1, MARKS), np.uint64)
    for a in range(0, len(out), 4096):
        b = min(a + 4096, len(out))
        row = np.repeat(np.arange(b - a), np.diff(at[a : b + 1]))
        odd = np.bincount(row * width + bit[at[a] : at[b]], minlength=(b - a) * width) & 1
        out[a:b] = np.packbits(odd.astype(np.uint8).reshape(b - a, width), axis=1, bitorder="little").view(np.uint64)
    return list(out.T)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def _body(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _signatures(texts: DataFrame, p: JaccardParams) -> DataFrame:
    """Per text its class, size and parities and a hash of the text itself; and how many texts
    hold shingles of each bucket."""
    marks = [f"m{i}" for i in range(MARKS)]
    names = ["doc_id", "body", "cls", "n", *marks, "bucket", "texts"]

    def run(batches):
        counts = np.zeros(1 << p.bucket_bits, np.int64)
        for b in batches:
            cls, n, odd = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [[np.zeros(0, np.uint64)] for _ in marks]
            for s in slices(b.column(1)):
                sets, at = _sets(s, p.words)
                cls.append(_class_ids(sets, at))
                for c, v in zip(odd, _parities(sets, at), strict=True):
                    c.append(v)
                n.append(np.diff(at))
                counts += np.bincount((sets >> np.uint64(64 - p.bucket_bits)).astype(np.int64), minlength=len(counts))
            m = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), _signed(np.concatenate(cls)), pa.array(np.concatenate(n)), *[_signed(np.concatenate(c)) for c in odd],
                 pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())],
                names=names,
            )
        (used,) = np.nonzero(counts)
        m = len(used)
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(m, pa.int64())] * (4 + MARKS), pa.array(used.astype(np.int32)), pa.array(counts[used])], names=names,
        )

    return texts.withColumn("body", _body(F.col("text"))).mapInArrow(
        run, "doc_id long, body long, cls long, n long, " + "".join(f"{m} long, " for m in marks) + "bucket int, texts long"
    )


def _frequencies(signatures: DataFrame, p: JaccardParams) -> np.ndarray:
    """Estimated documents per shingle of each bucket, above the background of the bucket.
    The table has a fixed size."""
    sums = signatures.where("bucket is not null").groupBy("bucket").agg(F.sum("texts").alias("texts")).toPandas()
    out = np.zeros(1 << p.bucket_bits)
    out[sums.bucket.to_numpy(np.int64)] = sums.texts.to_numpy(float)
    return np.maximum(out - np.median(out), 1.0)


def _prefixes(texts: DataFrame, frequency: np.ndarray, p: JaccardParams) -> DataFrame:
    """The prefix shingles of every class: shingle, class, its size, its l and the place; and
    where the prefix ends in the order of shingles. A class has them once for each task that reads it."""
    shared = texts.sparkSession.sparkContext.broadcast(frequency)

    def chosen(sets: np.ndarray) -> tuple[np.ndarray, int]:
        cost = shared.value[(sets >> np.uint64(64 - p.bucket_bits)).astype(np.int64)]
        n = len(sets)
        need = -(-p.percent * n // 100)
        most = min(p.max_matches, need)
        head = n - need + most
        if head < n:  # only the cheapest are put in order
            top = np.partition(cost, head - 1)[head - 1]
            at = np.flatnonzero(cost <= top)
        else:
            at = np.arange(n)
        at = at[np.lexsort((sets[at], cost[at]))][:head]
        sums = np.cumsum(cost[at])[n - need :]  # up to l = 1, 2, ...
        matches = np.arange(1, most + 1)
        best = int(np.argmin(sums + p.verify_cost * sums / matches))
        return sets[at][: n - need + best + 1], best + 1

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            for s in slices(b.column(1)):
                sets, at = _sets(s, p.words)
                ids = _class_ids(sets, at)
                heads, n, l, keys, ends = [], [], [], [], []
                _, once = np.unique(ids, return_index=True)
                once = [i for i in once.tolist() if at[i] < at[i + 1] and int(ids[i]) not in seen]
                seen.update(ids[once].tolist())
                for i in once:
                    head, matches = chosen(sets[at[i] : at[i + 1]])
                    heads.append(head)
                    last = shared.value[int(head[-1] >> np.uint64(64 - p.bucket_bits))]
                    ends.append((last, int(head[-1]) - (1 << 63), len(head)))
                    keys.append(np.full(len(head), ids[i]))
                    n.append(np.full(len(head), at[i + 1] - at[i], np.int32))
                    l.append(np.full(len(head), matches, np.int32))
                if heads:
                    yield pa.RecordBatch.from_arrays(
                        [_signed(np.concatenate(heads)), _signed(np.concatenate(keys)), pa.array(np.concatenate(n)), pa.array(np.concatenate(l)),
                         pa.array(np.concatenate([np.arange(len(h), dtype=np.int32) for h in heads])),
                         pa.array(np.repeat([e[0] for e in ends], [e[2] for e in ends])),
                         pa.array(np.repeat(np.array([e[1] for e in ends], np.int64), [e[2] for e in ends]))],
                        names=["token", "cls", "n", "l", "pos", "end_cost", "end_key"],
                    )

    return texts.mapInArrow(run, "token long, cls long, n int, l int, pos int, end_cost double, end_key long")


def _verified(texts: DataFrame, members: DataFrame, pairs: DataFrame, p: JaccardParams) -> DataFrame:
    """The pairs of classes that link, their sets taken from the texts again: from one text of
    each class, once for each task that reads it."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    bodies = members.groupBy("cls").agg(F.min("body").alias("body")).join(shuffled(needed), "cls", "left_semi")
    bitmap = texts.sparkSession.sparkContext.broadcast(bitmap_of(bodies, "body"))

    def sets_of(batches):
        seen: set[int] = set()
        for b in batches:
            body = b.column(1).to_numpy()
            own, first = np.unique(body, return_index=True)
            asked = np.flatnonzero(in_bitmap(bitmap.value, own.view(np.uint64)))
            asked = [i for i in asked.tolist() if int(own[i]) not in seen]
            seen.update(own[asked].tolist())
            for s in slices(b.column(0).take(pa.array(np.sort(first[asked])))):
                sets, at = _sets(s, p.words)
                ids, hit = np.unique(_class_ids(sets, at), return_index=True)
                ids, hit = ids[ids != 0], hit[ids != 0]
                yield pa.RecordBatch.from_arrays(
                    [_signed(ids), pa.array([sets[at[i] : at[i + 1]].tobytes() for i in hit], pa.binary())],
                    names=["cls", "members"],
                )

    found = texts.select("text", _body(F.col("text")).alias("body")).mapInArrow(sets_of, "cls long, members binary")
    found = found.join(needed, "cls", "left_semi").groupBy("cls").agg(F.first("members").alias("members"))
    found = written(found)
    left = found.select(F.col("cls").alias("a"), F.col("members").alias("left"))
    right = found.select(F.col("cls").alias("b"), F.col("members").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def compare(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("left"), b.column("right"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * same >= p.percent * (len(x) + len(y) - same))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long")


CLASS = ("cls", "n", "l", "pos", "most", "end_cost", "end_key")  # of a prefix row


def _may_link(p: JaccardParams, x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Sizes that may link. The bound of a class holds against partners whose prefix does not
    end before its own."""
    similar = (x("n") * p.percent <= y("n") * 100) & (y("n") * p.percent <= x("n") * 100)
    end_x, end_y = (F.struct(c("end_cost"), c("end_key")) for c in (x, y))
    return similar & ((end_x > end_y) | (y("n") <= x("most"))) & ((end_y > end_x) | (x("n") <= y("most")))


def _useful(rows: DataFrame, p: JaccardParams, turns: int = 2) -> DataFrame:
    """Prefix rows that can still be part of a link, with ``own`` (shingles of the prefix that
    are in no other prefix) and ``most`` (the largest set the class can be linked with).

    If y's prefix does not end before x's, all that x's prefix shares with y is in y's prefix
    too; so what is in no other prefix is not in y, and bounds the overlap and with it y's
    size. A class is taken from a shingle's list if this rules out all others of the list,
    which may leave shingles to one class. So edited copies that are too far from each other
    do not become candidates.
    """
    by_token = Window.partitionBy("token")
    earlier = by_token.orderBy("end_cost", "end_key").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(turns):
        # windows: each turn shuffles the rows twice and no second table of their size
        rows = rows.drop("own", "most").withColumn("left", F.count("*").over(Window.partitionBy("cls")))
        need = F.ceil(F.col("n") * p.percent / 100)
        own = F.col("n") - need + F.col("l") - F.col("left")
        most = F.floor((F.col("n") - own) * (100 + p.percent) / p.percent) - F.col("n")
        rows = rows.withColumn("own", own.cast("int")).withColumn("most", most.cast("int")).drop("left")
        rows = rows.withColumn("low", F.min("n").over(by_token)).withColumn("before", F.max("most").over(earlier))
        rows = rows.where((F.col("low") <= F.col("most")) | (F.col("before") >= F.col("n"))).drop("low", "before")
        shared = rows.groupBy("token").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi")
        rows = written(rows.join(shared.select("token"), "token", "left_semi"))
    return rows


def _best_hubs(rows: DataFrame, seed: int, p: JaccardParams) -> DataFrame:
    """Each class with the hub that shares most of its prefix shingles. The hub of a
    shingle is the class with the smallest share of shingles of its own, the original of its
    copies as it were; later rounds take any, in an order drawn by ``seed``."""
    central = F.col("own") / F.col("n") if seed == 0 else F.lit(0.0)
    order = F.struct(central.alias("c"), F.xxhash64("cls", F.lit(seed)).alias("o"), *CLASS, "comp")
    hubs = rows.groupBy("token").agg(F.min(order).alias("h"))
    met = rows.join(hubs, "token").where((F.col("comp") != F.col("h.comp")) & _may_link(p, F.col, lambda c: F.col(f"h.{c}")))
    met = met.withColumn("hub", F.col("h.cls"))
    met = met.groupBy("cls", "hub").agg(F.count("*").alias("count"), F.first("n").alias("n"))
    # a hub only saves work: pairs that share few of their rare shingles wait for the last step
    met = met.where(F.col("count") * 100 >= F.col("n") * (100 - p.percent) * p.hub_share / 100)
    best = met.groupBy("cls").agg(F.max(F.struct("count", "hub")).alias("m"))
    return best.select(F.col("cls").alias("a"), F.col("m.hub").alias("b"))


def _cross_pairs(rows: DataFrame, p: JaccardParams) -> DataFrame:
    """All candidate pairs of classes in different components that share enough shingles.

    Under each shingle a component of some size is listed by itself, so its inner pairs are
    never looked at; the others share lists. Lists have a bounded length. Only pairs that pass
    the tests on sizes and places become rows.

    Sets that link differ in few shingles, and so do their parities: most pairs of documents that
    share a passage and no more are left out by them before there is a row.

    What the prefix that ends first shares with the other set lies in both prefixes, so the
    shared shingles and the ``rest`` of its set bound the overlap. This is at least as strict as
    sharing the smaller l, and stricter the nearer the sizes are.
    """
    sizes = rows.groupBy("token").agg(F.count("*").alias("size"))
    own = rows.groupBy("token", "comp").agg(F.count("*").alias("own_size"))
    dealt = rows.join(sizes, "token").join(own, ["token", "comp"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / p.chunk)))
    dealt = dealt.withColumn("alone", F.when(F.col("own_size") > p.listed_alone, F.col("comp")))
    marks = [f"m{i}" for i in range(MARKS)]
    lists = dealt.groupBy("token", "alone", "part").agg(F.collect_list(F.struct("comp", *CLASS, *marks)).alias("m"))
    lists = lists.withColumn("list", F.struct(F.col("alone").isNull().alias("s"), F.coalesce("alone", F.lit(0)).alias("c"), "part"))
    right = lists.select("token", F.col("list").alias("list_b"), F.col("alone").alias("alone_b"), F.col("m").alias("m_b"))
    once = (F.col("list") < F.col("list_b")) | ((F.col("list") == F.col("list_b")) & F.col("alone").isNull())
    met = lists.join(right, "token").where(once & F.coalesce(F.col("alone") != F.col("alone_b"), F.lit(True)))

    def passes(x: Column, y: Column) -> Column:
        # what is left behind the shared place bounds the overlap
        bound = F.least(x["n"] - x["pos"], y["n"] - y["pos"]) + F.least(x["pos"], y["pos"])
        apart = (x["comp"] != y["comp"]) & (~F.col("same_list") | (x["cls"] < y["cls"]))
        both = x["n"] + y["n"]
        differ = reduce(lambda a, b: a + b, [F.bit_count(x[m].bitwiseXOR(y[m])) for m in marks])
        alike = (bound * (100 + p.percent) >= both * p.percent) & (differ * (100 + p.percent) <= both * (100 - p.percent))
        return apart & _may_link(p, lambda c: x[c], lambda c: y[c]) & alike

    def rest_of(z: Column) -> Column:
        return F.ceil(z["n"] * p.percent / 100) - z["l"]

    def with_partners(x: Column) -> Column:
        def pair(y: Column) -> Column:
            end_x, end_y = (F.struct(z["end_cost"], z["end_key"]) for z in (x, y))
            rest = F.when(end_x <= end_y, rest_of(x)).otherwise(rest_of(y))
            a, b = F.least(x["cls"], y["cls"]), F.greatest(x["cls"], y["cls"])
            return F.struct(a.alias("a"), b.alias("b"), rest.alias("rest"), (x["n"] + y["n"]).alias("both"))

        return F.transform(F.filter("m_b", lambda y: passes(x, y)), pair)

    met = met.withColumn("same_list", F.col("list") == F.col("list_b"))
    met = met.select(F.explode_outer(F.flatten(F.transform("m", with_partners))).alias("pair")).where("pair is not null")
    met = met.select("pair.*")
    met = met.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("rest").alias("rest"), F.min("both").alias("both"))
    return met.where((F.col("shared") + F.col("rest")) * (100 + p.percent) >= F.col("both") * p.percent).select("a", "b")


def _with_components(rows: DataFrame, roots: DataFrame, p: JaccardParams) -> DataFrame:
    """Prefix rows under their component; shingles seen in one component only are dropped."""
    roots = written(roots.select(F.col("node").alias("cls"), "root"))
    if roots.count() <= p.broadcast_roots:
        roots = F.broadcast(roots)
    rows = rows.drop("comp").join(roots, "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
    by_token = Window.partitionBy("token")
    alive = F.min("comp").over(by_token) < F.max("comp").over(by_token)
    return written(rows.withColumn("alive", alive).where("alive").drop("alive"))


def _cross_count(rows: DataFrame) -> tuple[int, float]:
    per = rows.groupBy("token", "comp").agg(F.count("*").alias("c"))
    per = per.groupBy("token").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    found = per.agg(F.sum("s"), F.sum(F.col("s").cast("double") * F.col("s") - F.col("q"))).first()
    return found[0] or 0, (found[1] or 0) / 2


def _grouped(df: DataFrame, id_col: str, text_col: str, p: JaccardParams) -> DataFrame:
    """``doc_id, body, cls, n, root`` of every row; rows with one ``root`` are linked."""
    texts = _texts(df, id_col, text_col)
    signatures = written(_signatures(texts, p))
    members = signatures.where("n is not null").select("doc_id", "body", "cls", "n")
    frequency = _frequencies(signatures, p)
    rows = _prefixes(texts, frequency, p)
    # most shingles are in one class and go here: one shuffle, the texts are not read twice
    by_token = Window.partitionBy("token")
    rows = rows.withColumn("shared", F.min("cls").over(by_token) < F.max("cls").over(by_token)).where("shared")
    rows = written(rows.groupBy("token", "cls").agg(*[F.first(c).alias(c) for c in CLASS if c not in ("cls", "most")]))
    rows = _useful(rows, p).withColumn("comp", F.col("cls"))

    links, before = None, float("inf")
    for seed in range(p.hub_rounds):  # at least one at every size
        found = written(_verified(texts, members, written(_best_hubs(rows, seed, p)), p))
        links = found if links is None else links.unionAll(found)
        rows = _with_components(rows, min_links(links), p)
        n, cross = _cross_count(rows)
        if cross <= p.pairs_per_row * n or cross > 0.9 * before:
            break
        before = cross
    marks = [f"m{i}" for i in range(MARKS)]
    odd = signatures.where("n > 0").groupBy("cls").agg(*[F.first(m).alias(m) for m in marks])
    rows = written(rows.join(shuffled(odd), "cls"))
    found = written(_verified(texts, members, written(_cross_pairs(rows, p)), p))
    roots = min_links(found if links is None else links.unionAll(found))
    classes = members.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    return classes.withColumn("root", F.coalesce("root", "cls"))


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: JaccardParams | None = None
) -> DataFrame:
    """Groups of texts linked by near duplicates.

    Returns one row per input row: ``doc_id``, ``n_shingles`` (size of its set) and
    ``component_id``, the smallest id reachable by links. A null or wordless text has an empty
    set and is linked with nothing; fewer words than a shingle has are one shingle. A row
    whose id is null joins its group and never names it; repeated rows and equal texts are
    one class. Other columns are ignored, an empty table gives an empty result.
    """
    classes = _grouped(df, id_col, text_col, params or JaccardParams())
    smallest = classes.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = classes.join(smallest, "root", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one_each(df: DataFrame, params: JaccardParams | None = None) -> DataFrame:
    """One row of each group of linked rows of ``df``: the one with the smallest ``doc_id``, null
    last, and among rows of that id the text with the smallest hash.

    A row that is linked with nothing stays, also if another row has its id; so do all rows
    without a word. Of rows alike in id and text one stays.
    """
    last = F.lit(2**63 - 1)
    classes = _grouped(df, "doc_id", "text", params or JaccardParams()).where("n > 0")
    key = F.struct(F.coalesce("doc_id", last).alias("doc"), "body")
    classes = written(classes.groupBy("root", key.alias("key")).agg(F.count("*").alias("rows")))
    first = classes.groupBy("root").agg(F.min("key").alias("first"))
    # of a group all keys but one go: the group itself is never gathered
    marks = classes.join(shuffled(first), "root").select("key", "rows", (F.col("key") == F.col("first")).alias("stays"))
    doc, body, stays, rows = fresh(df, "_doc", "_body", "_stays", "_rows")
    marks = marks.where(~F.col("stays") | (F.col("rows") > 1))
    marks = written(marks.select(F.col("key.doc").alias(doc), F.col("key.body").alias(body), F.col("stays").alias(stays)))
    keyed = df.withColumns({doc: F.coalesce(F.col("doc_id").cast("bigint"), last), body: _body(F.col("text"))})
    marked = keyed.join(shuffled(marks), [doc, body], "left")
    out = marked.where(F.col(stays).isNull()).select(*df.columns)
    repeated = marks.where(stays)
    if repeated.isEmpty():
        return out
    again = keyed.join(shuffled(repeated), [doc, body], "left_semi")
    one = again.groupBy(doc, body).agg(F.first(F.struct(*df.columns)).alias(rows))
    return out.unionByName(one.select(f"{rows}.*").select(*df.columns))

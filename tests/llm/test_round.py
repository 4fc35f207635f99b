"""Filter audit, packing and ranked search against brute force, on awkward rows."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from farpoint.llm import audit, packing, search
from farpoint.llm.oracles import ORACLES
from farpoint.llm.steps import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part string, mask int, body binary, g long, items string, row long, offset_ int"
LABELS = "doc_id long, quality int, toxic int, good int"
FILES = {
    "tokenizer": str(public_tokenizers.path("byte_bpe_50k.json")),
    "ranks": str(public_tokenizers.path("byte_bpe_50k.tiktoken")),
    "pattern": public_tokenizers.PATTERN,
}


def texts():
    some = ["alpha beta gamma delta", "Alpha ALPHA alpha", "x" * 5000, "the end <|endoftext|> the end", " \n\t ", "", None]
    some += [" ".join(f"w{j % (i + 2)}" for j in range(40 * i)) for i in range(12)]
    some += ["é ß ΣΑΣ 東京 12a3", "a# b$ c", "LOUD WORDS HERE", " ".join(f"long{i % 701}" for i in range(9000)), "alpha " * 300]
    return some


@pytest.fixture(scope="module")
def rows():
    langs = ["en", "fr", None, ""]
    out = [(i, t, langs[i % 4], "s", 1, "p", 1, b"b", 1, "i", 1, 1) for i, t in enumerate(texts())]
    copies = [(100 + i, out[i % 5][1], "de", "s", 1, "p", 1, b"b", 1, "i", 1, 1) for i in range(30)]
    nameless = [(None, out[0][1], "en", *[None] * 9), (None, "alpha of nobody", None, *[None] * 9)]
    return [*out, *copies, copies[3], copies[3], *nameless]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).sortWithinPartitions("doc_id").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- audit ----------------------------------------------------------------------------------


LABEL_ROWS = [(0, 1, 0, 9), (1, 0, 1, 9), (1, 1, None, 9), (2, None, 1, 9), (103, 1, 1, 9), (None, 1, 1, 9), (999, 1, 1, 9)]


def masks(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t],
        ]
        good = any(a == i and q == 1 for a, q, *_ in LABEL_ROWS if a is not None)
        toxic = any(a == i and x == 1 for a, _, x, _ in LABEL_ROWS if a is not None)
        yield lang or "", fails, good, toxic


def audit_by_hand(rows):
    by_part = defaultdict(list)
    for part, fails, good, toxic in masks(rows):
        by_part[part].append((fails, good, toxic))
    out = {}
    for part, members in by_part.items():
        total = Counter()
        for order in permutations("ABCDE"):
            left = members
            for step, letter in enumerate(order, 1):
                f = ord(letter) - 65
                hit = [m for m in left if m[0][f]]
                failing = [m for m in members if m[0][f]]
                left = [m for m in left if not m[0][f]]
                only = sum(sum(m[0]) == 1 for m in failing)
                total[letter] += len(hit)
                out[part, "".join(order), step] = [
                    len(left), len(hit), len(failing) - len(hit), only, sum(m[1] for m in hit), sum(m[2] for m in hit), letter,
                ]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = total[v[-1]]
    return out


def test_audit_by_hand(spark, docs, rows, empty):
    labels = spark.createDataFrame(LABEL_ROWS, LABELS)
    found = audit.audit_documents(docs, labels)
    cols = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r.part, r.filter_order, r.step): [r[c] for c in cols] for r in found.collect()}
    assert got == audit_by_hand(rows)
    assert found.count() == 120 * 5 * 4  # en, fr, de and the empty name
    assert audit.audit_documents(empty, labels).count() == 0
    assert audit.audit_documents(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)
    assert {"kept", "part", "mask", "doc_id"} >= set(audit.mask_cells(docs, labels).columns) - {"n", "good", "toxic"}


def test_audit_of_any_letters_keeps_the_row_limit(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    cells = spark.createDataFrame([("p", 1, 5, 2, 1), ("p", 3, 7, 0, 3), ("p", 0, 11, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in audit.audit_orders(cells, "XY").collect()}
    assert got == {("XY", 1): (11, 12, 0, 17), ("XY", 2): (11, 0, 7, 7), ("YX", 1): (16, 7, 0, 7), ("YX", 2): (11, 5, 7, 17)}
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


def test_many_parts_pass_the_default_row_limit(spark):
    cells = spark.range(3500).select(F.col("id").cast("string").alias("part"), F.lit(1).alias("mask"), *[F.lit(1).cast("bigint").alias(c) for c in ("n", "good", "toxic")])
    assert audit.walk_orders(cells).count() == 3500 * 325


# --- packing --------------------------------------------------------------------------------


def small(**more):
    return packing.PackParams(**{**FILES, "capacity": 64, "group_items": 8, "fan_in": 2, "carry": 4, "slack": 2, **more})


def pieces_by_hand(rows, capacity):
    tok = Tokenizer.from_file(FILES["tokenizer"])
    out = []
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            raw = np.array(ids[a:b], "<u4").tobytes()
            out.append((i, k, a, b - a, zlib.crc32(raw), raw))
    return out


def no_gaps(found, capacity):
    held = defaultdict(list)
    for r in found:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("more", [{}, {"carry": 1, "slack": 0}, {"group_items": 10_000}, {"ranks": None}, {"capacity": 1, "slack": 0}])
def test_packing_by_hand(docs, rows, more):
    params = small(**more)
    found = packing.pack_documents(docs, params).collect()
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(tuple(r[c] for c in cols) for r in found) == Counter(p[:5] for p in pieces_by_hand(rows, params.capacity))
    used = no_gaps(found, params.capacity)
    least = -(-sum(r.length for r in found) // params.capacity)
    assert used <= 1.2 * least + 2


def test_packed_ids_are_the_documents(docs, rows, empty):
    params = small()
    packed = packing.packed_ids(docs, params).collect()
    want = Counter(p[-1] for p in pieces_by_hand(rows, params.capacity))
    assert sum(len(r.ids) for r in packed) == sum(len(k) * n for k, n in want.items())
    assert all(len(r.ids) == 4 * r.length <= 4 * params.capacity for r in packed)
    ends = b"\0\0\0\0"  # every document ends in one id 0
    assert sum(r.ids.count(ends) >= 0 and sum(r.ids[i : i + 4] == ends for i in range(0, len(r.ids), 4)) for r in packed) >= len(rows)
    assert packing.pack_documents(empty, params).count() == packing.packed_ids(empty, params).count() == 0


def test_bins_are_few_whatever_the_sizes(spark):
    rng = np.random.default_rng(3)
    params = packing.PackParams(**FILES, group_items=500, fan_in=4)
    for sizes in (rng.integers(1, 2049, 6000), np.full(3000, 1500), np.repeat([1400, 648], 1500), rng.integers(1, 40, 5000)):
        from farpoint.llm.steps import written

        items = written(spark.createDataFrame([(int(s), "x") for s in sizes], "length int, name string").repartition(4))
        found = packing.pack(items, "length", params).collect()
        assert Counter(r.length for r in found) == Counter(sizes.tolist())
        least = max(-(-int(sizes.sum()) // 2048), int((sizes > 1024).sum()))
        # two sizes that only fill a bin together are dealt unevenly to the groups: within 3 %
        assert no_gaps(found, 2048) <= math.ceil(1.03 * least) + 2


def test_huge_run_of_blanks_is_tokenised(spark):
    text = "a" + "\n" * 1_000_000 + "b"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    n = packing.token_pieces(docs, packing.PackParams(**FILES)).agg(F.sum("length")).first()[0]
    assert n == 1 + len(Tokenizer.from_file(FILES["tokenizer"]).encode(text, add_special_tokens=False).ids)


def test_params_of_packing():
    for bad in ({"capacity": 0}, {"fan_in": 1}, {"slack": 64}, {"carry": 0}):
        with pytest.raises(ValueError):
            small(**bad)


# --- search ---------------------------------------------------------------------------------

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(t):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def search_by_hand(rows, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t, *_ in rows if terms(t)]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in held:
            m = 75 + 25 * n * n_docs // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text) if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


ITEMS = [
    (1, "alpha beta"), (2, "w0 w1 w2 w3 w1 w1"), (3, None), (4, ""), (5, "nowhere"), (6, "ALPHA the long1 long700 東京"), (None, "delta x"),
    (7, "alpha beta"), (7, "gamma"), (8, " ".join(f"long{i}" for i in range(0, 701, 3))), (9, "x" * 5000 + " of nobody"),
]


@pytest.mark.parametrize("params", [search.SearchParams(), search.SearchParams(k=3, items_at_once=2, threshold_share=1), search.SearchParams(k=1, terms_at_once=1)])
def test_search_by_hand(spark, docs, rows, params):
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id long, text string, doc_id string, rank int")
    found = search.search_documents(docs, items, params)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == search_by_hand(rows, ITEMS, params.k)


def test_search_of_nothing(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search_documents(empty, items).count() == 0
    assert search.search_documents(docs, items.limit(0)).count() == 0
    assert search.search_documents(docs, items.where("text = ''")).count() == 0


def test_small_blocks_and_groups_give_the_same(spark, docs, rows, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = search.build_index(docs).collect()
    assert sum(r.n_docs for r in found) == sum(bool(terms(t)) for _, t, *_ in rows)
    lot = search._Lot(search._item_terms(items).collect())
    lot.n, lot.length = sum(r.n_docs for r in found), sum(r.n_terms for r in found)
    lot.weights = np.ones(len(lot.vocab), np.int64)
    monkeypatch.setattr(search, "BOUND_CELLS", 1)
    lot.group()
    assert len(lot.groups) > 3 and sorted(i for g, _ in lot.groups for i in g) == list(range(len(lot.rows)))


def test_bounds_are_bounds_and_leave_documents_out(spark, docs):
    """A signature never says less than the counts do, and it does exclude."""
    found = search.build_index(docs).collect()
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    lot = search._Lot(search._item_terms(items).collect())
    lot.n, lot.length = sum(r.n_docs for r in found), sum(r.n_terms for r in found)
    hashes = [search._entry_hashes(lot.vocab, level) for level in range(len(search.LEVELS))]
    cells = above = 0
    for row in found:
        block = search._Block(row.asDict(), lot)
        gains = block.bounds(hashes)
        for t, term in enumerate(lot.vocab):
            exact = block.scores(np.arange(block.docs), np.array([term], np.uint64), np.ones(1, np.int64))
            assert (gains[t] >= exact).all()
            cells += block.docs
            above += int((gains[t] > 0).sum())
    assert above < 0.5 * cells


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_ranked_search"])
def test_sql_of_the_queries(spark, name):
    from farpoint.llm.queries import QUERIES

    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{where}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    cols = sorted(want.columns)
    got = QUERIES[name](spark, where).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall(), key=str)

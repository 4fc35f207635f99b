"""Every operator against a brute-force version, on given documents and awkward rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from farpoint.llm import bpe, decontaminate, extract, jaccard, langid, licenses, linededup, lmscore, quality, training_order

BLANKS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, cls long, token long, words string"
LINE = "this line stands in many of the documents here."


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


@pytest.fixture(scope="module")
def rows():
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(9000))
    passage = " ".join(f"Passage{i}" for i in range(40))
    near = [f"n{i}" for i in range(100)]
    texts = [
        None, "", " \n\t", "one", "ONE", "Éa Éa\x0bßtraße ΣΑΣ éé", long, long + " end", passage + "\n" + LINE, passage,
        " ".join(near), " ".join(["other"] + near[1:]), " ".join(near[:50] + ["mid"] + near[51:]), " ".join(near[:30] * 5),
        "Licensed under the Apache License, Version 2.0.\nMIT License mit license", "a<|endoftext|>b 'S it's # * $ % & | < >",
        f"  {LINE.upper()} \n{LINE}\nshort\nshort\nunique line number one of all", f"{LINE}\n\n{LINE}", "12 34 !?", "x" * 3000,
    ]
    out = [(i, t, ["en", "fr", None][i % 3], "s", 1, 1, "a", 2, 3, "b") for i, t in enumerate(texts)]
    return [*out, out[10], out[10], (None, "no id but " + LINE + " and more words", "en", None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).sortWithinPartitions("doc_id").cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality_rules(docs, rows, empty):
    found = quality.quality_rules(docs)
    got = by_id(found)
    assert found.count() == len(rows) and quality.quality_rules(empty).count() == 0
    for i, t, *_ in rows:
        t = t or ""
        w = split(t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if x.strip(BLANKS)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
    assert quality.keep_good(docs).where("doc_id = 10").count() == 3
    assert set(quality.keep_good(docs).columns) == set(docs.columns)


def test_frequent_lines_reject_but_copies_do_not(spark):
    boiler = "all rights reserved by the owners of this page and its many friends and partners since the year one"
    letters = lambda n: "".join(chr(97 + int(c)) for c in f"{n:04d}")  # noqa: E731  digits of a line count as one
    own = [" ".join(letters(100 * i + j) for j in range(30)) for i in range(40)]
    made = [(i, f"{boiler}\n{boiler} again and again for all of you", "h") for i in range(3)]
    made += [(100 + i, f"{boiler}\n{own[i]}", "h") for i in range(40)] + [(200 + i, own[0] + f"\nlast words {own[1]}", "h") for i in range(60)]
    got = by_id(quality.quality_rules(spark.createDataFrame(made, "doc_id long, text string, source string")))
    assert all(got[100 + i].kept for i in range(40)) and all(got[200 + i].kept for i in range(60))
    made = [(i, f"{boiler}\n{own[i]}", "h") for i in range(40)] + [(99, f"{boiler}\n{boiler}", "h")]
    got = by_id(quality.quality_rules(spark.createDataFrame(made, "doc_id long, text string, source string")))
    assert got[0].kept and 50 < got[0].percent_left < 100 and not got[99].kept and got[99].percent_left == 0


def test_shared_lines_do_not_hide_each_other(spark):
    word = lambda n: "".join(chr(97 + int(c)) for c in f"{n:05d}")
    words = lambda n, k: " ".join(word(n * 20 + j) for j in range(k))
    shared = [[words(10 * h + k, 10) for k in range(10)] for h in range(5)]
    made = [(60 * h + i, "\n".join([*shared[h], *(words(100 + 120 * h + 2 * i + k, 4) for k in (0, 1))]), f"h{h}") for h in range(5) for i in range(60)]
    made += [(1000 + i, "\n".join([*shared[0], words(900, 4)]), "few") for i in range(60)]  # one document, 60 times
    df = spark.createDataFrame(made, "doc_id long, text string, source string")
    got = by_id(quality.quality_rules(df))
    assert all((got[i].percent_left, got[i].kept, got[i].base_failed) == (7, False, False) for i in range(300))
    assert all((got[1000 + i].percent_left, got[1000 + i].kept) == (100, True) for i in range(60))
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {1000 + i for i in range(60)}


def test_lines_of_one_word_are_counted(spark):
    word = lambda n: "".join(chr(97 + int(c)) for c in f"{n:05d}")
    menu = "\n".join(word(n) for n in range(25))
    made = [(i, f"{menu}\n{word(1000 + i)}", "menu") for i in range(40)]
    made += [(100 + i, f"{word(2000 + i)}\n" + " ".join(word(3000 + 30 * i + j) for j in range(30)), "own") for i in range(40)]
    notice, han = "版权所有不得转载", lambda n, k: "".join(chr(0x4E00 + 200 * n + j) for j in range(k))
    made += [(200 + i, f"{notice}\n{han(i, 92)}", "long") for i in range(40)] + [(300 + i, f"{notice}\n{han(i, 1)}", "short") for i in range(40)]
    thai = "สงวนลิขสิทธิ์"
    made += [(400 + i, f"{thai}\n{word(i)}", "thai") for i in range(40)]
    got = by_id(quality.quality_rules(spark.createDataFrame(made, "doc_id long, text string, source string")))
    for i in range(40):
        assert (got[i].percent_left, got[i].kept, got[i].base_failed) == (3, False, False)
        assert (got[100 + i].percent_left, got[100 + i].kept) == (100, True)
        assert (got[200 + i].percent_left, got[300 + i].percent_left) == (92, 11)
        assert got[400 + i].percent_left == 100 // (len(thai) + 1)


def test_training_order(spark, docs, empty):
    p = training_order.OrderParams(length=64, per_shard=100)
    index, path = training_order.materialise(docs, params=p)
    index = index.toPandas()
    n = len(index)
    order = training_order.Order(n, p.key)
    assert sorted(index.slot) == sorted(index.sequence) == list(range(n))
    assert (order.sequences(index.slot.to_numpy()) == index.sequence).all()
    records = dict(training_order.read_from(spark, path, 0, p))
    data = b"".join(records[s].tobytes() for s in index.sort_values("sequence").slot)
    texts = sorted(x for x in data.split(b"\xff") if x)
    assert texts == sorted((r.text or "").encode() for r in docs.collect() if r.text)
    assert [s for s, _ in training_order.read_from(spark, path, 150, p)] == list(range(150, n))
    assert training_order.materialise(empty, params=p)[0].count() == 0
    for size in (1, 2, 3, 1000):
        assert sorted(training_order.Order(size, "k").slots(range(size))) == list(range(size))


def test_reading_shards(spark, docs, empty, tmp_path):
    p = training_order.OrderParams(length=64, per_shard=100, rounds=5)
    _, path = training_order.materialise(docs, path=str(tmp_path / "order"), params=p)
    records = [(s, r.tobytes()) for s, r in training_order.read_from(spark, path)]
    n = len(records)
    assert n > 300 and training_order.read_manifest(spark, path) == (n, p)
    for slot in (0, 1, 99, 100, 257, n - 1, n):
        assert [(s, r.tobytes()) for s, r in training_order.read_from(spark, path, slot)] == records[slot:]
    with pytest.raises(ValueError, match="was written with"):
        next(training_order.read_from(spark, path, 0, training_order.OrderParams()))
    (file,) = (tmp_path / "order" / "shard=1").glob("part-*")
    file.write_bytes(file.read_bytes()[:-65])
    with pytest.raises(ValueError, match="shard 1 .* is not whole"):
        list(training_order.read_from(spark, path, 150))
    (tmp_path / "order" / "shard=2").rename(tmp_path / "moved")
    with pytest.raises(ValueError, match="shard 2 .* is not whole"):
        list(training_order.read_from(spark, path, 200))
    _, path = training_order.materialise(empty, params=p)
    assert list(training_order.read_from(spark, path)) == []


def test_extraction(spark):
    page = (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></ul></nav>"
        "<div class='cookie-notice'>We use cookies</div><article><h1>Head&amp;line</h1><p>First <b>bo</b>ld  text.<br>More<p>Er.<p>Last &eacute;."
        "<div class=comments><p>Nice post!</div></article><aside>Side</aside><form><p>Mail</p></form><footer>&copy; x</footer>"
    )
    plain = "<body><div id=menu><a href=1>A</a><a href=2>B</a></div><div><p>" + "Long enough words here. " * 8 + "</p><p>Tiny.</p><p>" + "And more of them there. " * 8 + "</p></div></body>"
    made = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, "<<<>><p"), (5, "u", plain), (1, "u", page)]
    got = {r.page_id: r for r in extract.extract_pages(spark.createDataFrame(made, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head&line First bold text. More Er. Last é." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == ""
    assert got[5].text.startswith("Long") and "Tiny." in got[5].text and "A B" not in got[5].text


def test_names_do_not_outweigh_the_text():
    one, two = "Long enough words stand here for a line. " * 6, "And there are more of them in this one. " * 5
    body = f"<article><h1>Title</h1><p>{one}</p><p>{two}</p></article>"
    want = " ".join(f"Title {one}{two}".split())
    for before, after in (
        ("<div class='with-sidebar'>", "</div>"), ("<div class='layout no-footer'>", "</div>"), ("<div id=page class='nav-open'>", "</div>"),
        ("<form id=aspnetForm>", "</form>"), ("<div class=sidebar>", "</div>"),
    ):
        for text in (body, body.replace("article>", "div>")):
            page = f"<body><div class=menu><a href=x>Home</a></div>{before}{text}<div class=sidebar>More of our site.</div><form>Your mail</form>{after}<div class=site-footer>All ours.</div></body>"
            assert extract.main_text(page) == want, page
    inner = f"<section id='related-work'><h2 id='search-trees'>Trees</h2><p class='side-note'>A note.</p><p>{two}</p></section>"
    page = f"<body><article><p>{one}</p>{inner}<div class=comments><p>{two}</p></div><section id=related><a href=1>Other</a></section></article></body>"
    assert extract.main_text(page) == " ".join(f"{one}Trees A note. {two}".split())
    page = f"<body><article><p>{one}{one}</p></article><div id=comments><article>{two}</article></div></body>"
    assert extract.main_text(page) == " ".join((one + one).split())


def test_all_content_clusters_are_kept():
    text = lambda k, n: f"Sentence {k} says enough for this. " * n
    flat = lambda *x: " ".join("".join(x).split())
    p = lambda k, n: f"<p>{text(k, n)}</p>"
    menu = "<div><a href=1>One</a></div><div><a href=2>Two</a></div>"
    page = f"<body>{menu}<article><h1>A</h1>{p(1, 6)}{p(2, 6)}</article><article><h1>B</h1>{p(3, 4)}{p(4, 4)}</article></body>"
    assert extract.main_text(page) == flat("A ", text(1, 6), text(2, 6), "B ", text(3, 4), text(4, 4))
    page = f"<body>{menu}<div>{p(1, 8)}{p(2, 9)}</div><div>{p(3, 3)}<p>Tiny.</p></div>{menu}</body>"
    assert extract.main_text(page) == flat(text(1, 8), text(2, 9), text(3, 3), "Tiny.")
    page = f"<body>{menu}<article>{p(1, 8)}</article><div><h2>More</h2>{p(2, 5)}</div>{menu}</body>"
    assert extract.main_text(page) == flat(text(1, 8), "More ", text(2, 5))
    page = f"<body>{menu}<div>{p(1, 5)}</div><section>{p(2, 5)}</section><div>{p(3, 5)}</div></body>"
    assert all(f"Sentence {k}" in extract.main_text(page) for k in (1, 2, 3))


def test_bpe(docs, rows, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):  # the second looks across white space
        path = str(public_tokenizers.path(name))
        p = bpe.BpeParams(path, mean_words=4)
        t = Tokenizer.from_file(path)
        found = bpe.encode_texts(docs, p)
        got = by_id(found)
        assert found.count() == len(rows) and bpe.encode_texts(empty, p).count() == 0
        for i, text, *_ in rows:
            ids = t.encode(text or "", add_special_tokens=False).ids
            assert got[i].ids == ids and got[i].decoded == t.decode(ids, skip_special_tokens=False)


def test_decontamination(spark, docs, rows, empty):
    item = [f"passage{i}" for i in range(40)]
    made = [(1, " ".join(item)), (2, "too short"), (3, None), (4, " ".join(f"n{i}" for i in range(20)))]
    benchmark = spark.createDataFrame(made, "item_id long, text string")
    got = by_id(decontaminate.decontaminate(docs, benchmark))
    assert {i for i, r in got.items() if 1 in r.item_ids} == {8, 9}
    assert {i for i, r in got.items() if 4 in r.item_ids} == {10, 11, 12, 13}
    assert len(decontaminate.clean_rows(docs, benchmark).collect()) == len(rows) - 8
    assert decontaminate.decontaminate(empty, benchmark).count() == 0
    changed = [item[:5] + ["x"] + item[6:11] + ["y"] + item[12:16] + ["far"] * 9, item[:6] + ["x", "y", "z", "v"] + item[10:16] + ["q"] * 9]
    texts = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(changed)], "doc_id long, text string")
    got = by_id(decontaminate.decontaminate(texts, benchmark))
    assert got[0].contaminated and not got[1].contaminated
    few = decontaminate.DecontaminationParams(broadcast_rows=0)
    assert by_id(decontaminate.decontaminate(texts, benchmark, params=few)) == got


def test_short_items_with_any_words_changed(spark):
    items = {n: [f"i{n}x{j}" for j in range(n)] for n in range(1, 16)}
    made = []
    for n, w in items.items():
        for k in range(n // 5 + 2):
            for gone in combinations(range(n), k) if k <= n // 5 else [range(k), range(n - k, n)]:
                text = [*("before it " * 3).split(), *("other" if j in gone else x for j, x in enumerate(w)), "after"]
                made.append((len(made), " ".join(text), [n] if k <= n // 5 else []))
    benchmark = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = by_id(decontaminate.decontaminate(spark.createDataFrame([m[:2] for m in made], "doc_id long, text string"), benchmark))
    assert [(m, got[m[0]].item_ids) for m in made if got[m[0]].item_ids != m[2]] == []


def test_language(spark, docs, empty):
    made = [("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("x", None)]
    model = langid.fit(spark.createDataFrame(made, "text string, lang string"))
    got = by_id(langid.predict(docs, model, keep=["doc_id"]))
    assert model.langs == ["en", "fr"] and got[0].lang_pred == got[18].lang_pred == "und" and got[5].lang_pred != "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"} and langid.predict(empty, model).count() == 0
    r = docs.select("doc_id", langid.remainder("doc_id", 4).alias("r")).where("doc_id is not null").collect()
    assert all(x.r == zlib.crc32(str(x.doc_id).encode()) % 4 for x in r)


def test_jaccard(docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = split(fold(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                same = len(sets[a] & sets[b])
                if same and 100 * same >= 80 * len(sets[a] | sets[b]) and None not in (a, b):
                    root[a] = root[b] = min(root[a], root[b])
    for p in (jaccard.JaccardParams(), jaccard.JaccardParams(pairs_per_row=0, max_matches=40, chunk=2, verify_cost=1e6)):
        found = jaccard.jaccard_components(docs, params=p)
        assert found.count() == len(rows)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == {i: (len(sets[i]), root[i]) for i in sets}
    assert jaccard.jaccard_components(empty).count() == 0
    kept = {r.doc_id for r in jaccard.keep_one_each(docs).collect()}
    assert kept == {i for i in sets if root[i] == i}


def test_licenses(docs, rows, empty):
    found = licenses.scan_licenses(docs)
    got = by_id(found)
    assert found.count() == len(rows) and licenses.scan_licenses(empty).count() == 0
    for i, t, *_ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t or ""))
        at = [(k, v) for q, v in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(q.split())] == q.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({v for _, v in at})))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
    assert got[14].labels == "apache,mit" and got[14].score == 1.0 and got[3].score == 0.0


def test_lines(docs, rows, empty):
    key = lambda x: fold(x.strip(BLANKS))
    owner = {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for x in (t or "").split("\n"):
            owner.setdefault(key(x), i)
    for p in (linededup.LineParams(), linededup.LineParams(batches=9, fanout=3, buckets=2), linededup.LineParams(batches=1)):
        found = linededup.dedup_lines(docs, params=p)
        got = by_id(found)
        assert found.count() == len(rows) and linededup.dedup_lines(empty, params=p).count() == 0
        for i, t, *_ in rows:
            lines = (t or "").split("\n")
            kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
            assert (got[i].n_lines, got[i].n_dropped, got[i].kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))


def test_scores(docs, rows, empty):
    p = lmscore.LmParams(words=4, hashed=4, dims=4, lookup=8, rounds=1)
    training = F.col("doc_id") % 2 == 0
    found = lmscore.lm_score(docs, training=training, params=p)
    got = by_id(found)
    end = object()
    tokens = [(i, split(fold(t or "")) + [end]) for i, t, *_ in rows]
    c = Counter(w for i, ws in tokens if i is not None and i % 2 == 0 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert lmscore.lm_score(empty, params=p).count() == 0
    assert all(r.n_known == 0 for r in lmscore.lm_score(docs, training=F.lit(False), params=p).collect())


def test_model_is_normalised():
    import numpy as np

    p = lmscore.LmParams(words=5, hashed=3, dims=4)
    m = lmscore.Model.start(p, np.log(np.full(8, 1 / 8)))
    h, log_z = m.tables()
    assert np.allclose(np.exp(h @ m.q.T + m.bias - log_z[:, None]).sum(1), 1, atol=1e-5)


def test_digest_of_query_columns(docs):
    r = docs.select(F.sha2(F.array_join(F.array(F.lit("1"), F.lit("2")), " "), 256).alias("h")).first()
    assert r.h == hashlib.sha256(b"1 2").hexdigest()


def test_one_of_each_group_stays_and_nothing_else_goes(spark, rows, docs):
    """Ids that several texts share, exact repeats, and columns named as the helpers'."""
    long = [" ".join(f"{name}{i}" for i in range(60)) for name in "abc"]
    near = long[0] + " more"
    made = [(1, long[0]), (2, near), (2, long[1]), (3, long[2]), (3, long[2]), (None, long[1] + " too"), (4, ""), (4, ""), (None, "x y")]
    df = spark.createDataFrame([(i, t, 1, "b", "r", 7) for i, t in made], "doc_id long, text string, _doc int, _body string, _stays string, _rows int")
    got = jaccard.keep_one_each(df)
    assert got.columns == df.columns
    left = Counter((r.doc_id, r.text) for r in got.collect())
    assert left == Counter([(1, long[0]), (2, long[1]), (3, long[2]), (4, ""), (4, ""), (None, "x y")])
    kept = jaccard.keep_one_each(docs)
    assert kept.columns == docs.columns
    groups = {r.component_id for r in jaccard.jaccard_components(docs).where("n_shingles > 0").collect()}
    assert kept.where("text is not null").collect() and groups <= {r.doc_id for r in kept.collect()}


def test_filters_keep_columns_of_any_name(spark, empty):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, "h", 5, 6, 7, 8, 9)], "doc_id long, text string, source string, _row int, _doc int, _lines int, _gone int, _ROW_ int")
    benchmark = spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")
    for out in (quality.keep_good(df), decontaminate.clean_rows(df, benchmark), linededup.dedup_lines(df).drop("n_lines", "n_dropped", "kept_text")):
        assert out.columns == df.columns and out.collect() == df.collect()


def test_joins_that_disagree_are_encoded_as_a_whole(monkeypatch):
    import public_tokenizers
    import pyarrow as pa

    from farpoint.llm.words import slices

    p = bpe.BpeParams(str(public_tokenizers.path("word_bpe_49k.json")), mean_words=2)
    text = " ".join(f"word{i % 7} of{i % 5}" for i in range(200))
    enc, wholes = bpe.Encoder(p, []), []
    monkeypatch.setattr(enc, "_hold", lambda s, cut, places, keys: enc.joins.update((k, False) for k in keys.tolist()))
    whole = enc.whole
    monkeypatch.setattr(enc, "whole", lambda t: wholes.append(t) or whole(t))
    (s,) = slices(pa.array([text, "one", None]))
    ids, at = enc.encode(s)
    assert wholes == [text]  # the one text with joins
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [whole(text), whole("one"), []]


def test_parities_never_differ_more_than_the_sets():
    import numpy as np

    rng = np.random.default_rng(5)
    one = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    sets = [one, one[7:], np.append(one[40:], rng.integers(0, 2**63, 30).astype(np.uint64)), one[:0], one[:1]]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    marks = np.array(jaccard._parities(np.concatenate(sets), at)).T
    for a, x in zip(marks, sets):
        for b, y in zip(marks, sets):
            apart = len(np.setxor1d(x, y))
            differ = sum(int(v).bit_count() for v in a ^ b)
            assert differ <= apart and differ % 2 == apart % 2
    assert not marks[3].any()

"""Work that the text operators of round 3 do once and did again before."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from farpoint.llm import bpe, jaccard
from farpoint.llm.words import slices


class _Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **how)

    def __getattr__(self, name):
        return getattr(self.inner, name)


def _encoder(**more):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return bpe.Encoder(bpe.BpeParams(str(public_tokenizers.path("word_bpe_49k.json")), **more), [])


def _same(enc, texts):
    for s in slices(pa.array(texts)):
        ids, at = enc.encode(s)
        want = [enc.whole(t or "") for t in texts[s.first : s.first + s.rows]]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_new_words_share_a_call():
    """op4: each new word was a text of its own to the tokenizer."""
    enc = _encoder(mean_words=1 << 40)  # chunks end with texts: no joins to hold
    enc.tokenizer = _Counted(enc.tokenizer)
    texts = [" ".join(f"Word{i}x{k}, É{i}́ 's" for k in range(20)) for i in range(100)]
    _same(enc, texts)
    assert enc.tokenizer.texts < 10
    # words that hold the mark
    _same(enc, ["a \x01 b\x01 \x01\x01c d", "\x01", " \x01 ", None, "x \x01  ́y"])


def test_pieces_in_use_outlive_the_others():
    """op4: all words were encoded anew whenever a worker's store was full."""
    enc = _encoder(mean_words=1 << 40, cached_words=100)
    common = [f"common{i}" for i in range(30)]
    for k in range(8):
        _same(enc, [" ".join(common + [f"rare{k}x{i}" for i in range(40)])])
        assert len(enc.keys) <= 100 + 70
    own = np.sort(enc.keys)
    enc._forget()
    assert 30 <= len(enc.keys) <= 50 and np.isin(enc.keys, own).all()
    encoded = []
    apart = enc._apart
    enc._apart = lambda words: encoded.extend(words) or apart(words)
    _same(enc, [" ".join(common)])
    assert not encoded


def test_shared_chunks_name_a_text_that_holds_them(spark):
    """op4: all texts were cut again to find the texts of the shared chunks."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    p = bpe.BpeParams(str(public_tokenizers.path("word_bpe_49k.json")), shared_chunks=1)
    texts = ["same words here and there"] * 2 + [f"text {i} is alone" for i in range(50)]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    keyed = df.select("text", F.xxhash64("text").alias("body"))
    (chunk,) = bpe._chunk_counts(keyed, p).collect()
    assert (chunk.n, chunk.words) == (2, 5)
    assert {r.text for r in keyed.where(F.col("body") == chunk.body).collect()} == {texts[0]}
    ((_, ids),) = bpe._shared(df, p)
    assert ids == np.array(bpe.Encoder(p, []).whole(texts[0]), np.int32).tobytes()


def test_sets_are_built_of_few_texts(spark, monkeypatch):
    """op7: prefixes were taken from every text twice, and every text's set was built again for each verification."""
    copies = ["one two three four five six seven eight nine ten eleven twelve"] * 3
    near = [copies[0] + " thirteen"]
    alone = [" ".join(f"w{i}x{k}" for k in range(8)) for i in range(200)]
    rows = list(enumerate([*copies, *near, *alone, None, ""]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == {i: (8, 0) if i < 3 else (9, 0) if i == 3 else (4, i) if i < 204 else (0, i) for i, _ in rows}

    texts = jaccard._texts(df, "doc_id", "text")
    members = jaccard._signatures(texts, jaccard.JaccardParams()).where("n is not null").select("doc_id", "body", "cls", "n")
    classes = {r.doc_id: r.cls for r in members.collect()}
    pairs = spark.createDataFrame([(classes[0], classes[3])], "a long, b long")
    stored, inner = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda d: stored.append(d) or inner(d))
    assert [tuple(r) for r in jaccard._verified(texts, members, pairs, jaccard.JaccardParams()).collect()] == [(classes[0], classes[3])]
    assert {r.cls for r in stored[0].collect()} == {classes[0], classes[3]}

    prefixes = jaccard._prefixes(texts, np.ones(1 << 18), jaccard.JaccardParams())
    of_copies = prefixes.where(F.col("cls") == classes[0])
    assert of_copies.count() == of_copies.select("token").distinct().count() > 0

"""The pipeline against its five stages in plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline

BLANKS = " \t\n\x0b\x0c\r"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def good(docs):
    """Documents that the quality rules keep."""
    lines = {r: [x for x in (" ".join(words(re.sub("[0-9]+", "0", y.lower()))) for y in r[0].split("\n")) if x] for r in docs.values()}
    held = defaultdict(set)
    for (text, host), found in lines.items():
        for x in found:
            held[host, x].add(text)
    out = {}
    for i, (text, host) in docs.items():
        w = words(text)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {k + j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(8)}
        size = [(len(words(x)), len(held[host, x]) > 25) for x in lines[text, host]]
        left = 100 * sum(n for n, often in size if not often) // max(sum(n for n, _ in size), 1)
        if len(w) >= 20 and 100 * len(again) <= 30 * len(w) and left >= 15:
            out[i] = (text, host)
    return out


def own_lines(docs):
    """Documents without lines that one of a smaller id holds."""
    seen, out = set(), {}
    for i, (text, host) in sorted(docs.items()):
        lines = text.split("\n")
        keys = [x.strip(BLANKS).lower() for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True) if len(k) < 10 or k not in seen]
        seen.update(keys)
        if len(kept) == len(lines) or "\n".join(kept).strip(BLANKS):
            out[i] = ("\n".join(kept), host)
    return out


def one_each(docs):
    """The smallest id of each group of near duplicates."""
    sets = {i: {tuple(words(t.lower())[k : k + 5]) for k in range(len(words(t)) - 4)} or {tuple(words(t.lower()))} for i, (t, _) in docs.items()}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {i: r for i, r in docs.items() if root[i] == i}


def clean(docs, items):
    """Documents that overlap no item."""
    out = {}
    for i, r in docs.items():
        w = re.findall("[0-9a-z]+", r[0].lower())
        found = False
        for item in items:
            n = min(16, len(item))
            for begin in range(-len(item), len(w)):
                same = [0 <= begin + j < len(w) and w[begin + j] == x for j, x in enumerate(item)]
                found |= any(100 * sum(same[k : k + n]) >= 80 * n for k in range(len(item) - n + 1))
        if not found:
            out[i] = r
    return out


def test_stages_in_order(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 9)))
    say = lambda n: [word() for _ in range(n)]
    notice, passage, short, base, twice = " ".join(say(40)), say(30), say(7), say(120), " ".join(say(9))
    texts = [f"{notice}\n{' '.join(say(3))}" for _ in range(30)]  # depleted
    texts += [f"{notice}\n{' '.join(say(30))}" for _ in range(4)]
    texts += [" ".join([*base[:k], "edited", *base[k + 1 :]]) for k in (10, 40, 70)]
    texts += [f"{' '.join(say(25))}\n{twice}\nshort\n{' '.join(say(8))}" for _ in range(5)] + [f"{twice}\n{twice}\n{twice}", "too few words", ""]
    texts += [" ".join([*say(30), *passage[3:9], "x", *passage[10:22], *say(20)]), " ".join([*say(30), *short[:3], "y", *short[4:], *say(20)])]
    texts += [" ".join(say(60)) for _ in range(4)]
    texts += [texts[-1], " ".join(say(10) * 4)]
    docs = {i: (t, "host") for i, t in enumerate(texts)}
    made = [(i, t, "en", s, len(t)) for i, (t, s) in docs.items()]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [passage, short]
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sizes = [len(docs)]
    for stage in (good, own_lines, one_each, lambda d: clean(d, items)):
        docs = stage(docs)
        sizes.append(len(docs))
    assert all(a > b for a, b in zip(sizes, sizes[1:])), sizes  # every stage has something to do
    t = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    want = set()
    for i, (text, _) in docs.items():
        ids = t.encode(text, add_special_tokens=False).ids
        said = (" ".join(map(str, ids)), t.decode(ids, skip_special_tokens=False))
        want.add((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in said)))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(rows) == len(want) and {(x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in rows} == want

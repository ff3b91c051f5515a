"""Ranked lexical search against the definition of its scores."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import connect, same
from tidewell.llm import queries, wavelet

SF = "/root/testdata/sf0.001"


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(wavelet.TERM, lowered)


def brute(docs, items, k):
    held = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for i, c in held:
            m = 75 + 25 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, k=20):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, shard string, item int")
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, term string")
    return sorted(map(tuple, wavelet.top_documents(wavelet.build(df), asked, k).collect()), key=str)


def test_same_as_sql(spark):
    same(queries.op11_wavelet_search(spark, SF), queries.OP11_SQL, connect(SF))


def test_many_shards_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "POSTINGS", 60)
    monkeypatch.setattr(wavelet, "ITEMS", 2)
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "ÉTÉ", "x9"]
    docs = [(int(i), " ".join(rng.choice(vocabulary, rng.integers(1, 12)))) for i in rng.permutation(400)]
    docs = [(i, "Common text, of W1 and w2; w3!" if i % 3 == 0 else t) for i, t in docs]
    items = [(j, " ".join(rng.choice(vocabulary, 5))) for j in range(9)] + [(100, "common TEXT w1 w1"), (101, "nowhere"), (102, "été")]
    assert found(spark, docs, items, 7) == brute(docs, items, 7)


def test_odd_rows(spark):
    docs = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "a b c"), (4, "word " * 20000 + "a"), (5, ".,;"), (6, "a\x00b A_c\x7fd ñandú 中文 x"), (7, "z" * 300_000)]
    items = [(1, "a b"), (1, "a b"), (1, "word"), (2, None), (3, ""), (None, "中文 ñandú"), (4, "z" * 300_000), (5, "b " * 3000)]
    items = [i for i in items if i != (1, "word")]
    assert found(spark, docs, items) == brute(docs, [(i, t or "") for i, t in items], 20)
    assert found(spark, docs, []) == [] and found(spark, [], items) == [] and found(spark, [(1, None), (2, "!")], items) == []


@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=6), min_size=1, max_size=40), st.lists(st.integers(0, 5), min_size=1, max_size=5, unique=True), st.integers(1, 6), st.integers(1, 3))
@settings(max_examples=200, deadline=None)
def test_the_tree_gives_the_exact_top(docs, terms, k, step):
    made = next(wavelet._shards(len(docs), sum(map(len, docs)), 10**6, 1 << 16)(iter([wavelet.pa.RecordBatch.from_pylist([{"doc_id": i, "text": " ".join(f"t{t}" for t in d)} for i, d in enumerate(docs)])]))).to_pylist()[0]
    impacts = np.frombuffer(made["impacts"], "<i4")
    shard = wavelet.Shard(made["n_docs"], impacts, [np.unpackbits(np.frombuffer(x, np.uint8), count=len(impacts)) for x in made["levels"]])
    begin = dict(zip(made["terms"], zip([0, *made["ends"]], made["ends"])))
    ranges = [begin[f"t{t}"] for t in terms if f"t{t}" in begin]
    if not ranges:
        return
    weights = np.arange(1, len(ranges) + 1)
    expected = []
    for d, doc in enumerate(docs):
        c = Counter(doc)
        m = 75 + 25 * len(doc) * len(docs) // sum(map(len, docs))
        held = [t for t in terms if f"t{t}" in begin]
        expected.append((-sum(int(w) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, w in zip(held, weights) if t in c), d))
    old, wavelet.STEP = wavelet.STEP, step
    scores, found_docs = wavelet.search(shard, np.arange(len(docs)), np.array([a for a, _ in ranges], np.int32), np.array([b for _, b in ranges], np.int32), weights, k, 1, wavelet.LAST)
    wavelet.STEP = old
    assert list(zip((-scores).tolist(), found_docs.tolist())) == [x for x in sorted(expected) if x[0] < 0][:k]

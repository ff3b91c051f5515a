"""Patterns in texts: both ways against the definition, and hot grams."""

import random

import pytest

from tidewell.operators import patterns as P
from tidewell.operators import search as S

R = random.Random(5)
TEXTS = [(i, "".join(R.choice("abcñ 中.") for _ in range(R.randint(0, 60)))) for i in range(150)] + [(200, None), (201, ""), (202, "end " * 3000), (203, "abcabcabcabc"), (203, "abcabcabcabc")]
KEYS = ["a", "ab", "", None, "abcabcabcabc", "nowhere to be found", "中.", "end end end end end", "ñ"] + ["".join(R.choice("abcñ 中.") for _ in range(R.randint(1, 12))) for _ in range(60)]


def expected():
    return {(i, k) for i, t in TEXTS for k in KEYS if t and k and k in t}


@pytest.mark.parametrize("most", [10**6, 0])
def test_both_ways_are_the_definition(spark, monkeypatch, most):
    monkeypatch.setattr(P, "SHARE", 7)
    got = P.found_in(spark.createDataFrame([(k,) for k in KEYS], "k string"), spark.createDataFrame(TEXTS, "id long, rt string"), most).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == expected()


def test_one_gram_of_a_third_of_all_rows_fills_no_task(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARE", 20)
    texts = spark.createDataFrame([(i, f"{i:04d} of the same ending" if i % 3 == 0 else f"other text {i:04d}") for i in range(600)], "id long, rt string")
    keys = spark.createDataFrame([(f"{i:04d} of the same ending",) for i in range(0, 600, 7)] + [("of the same ending",)], "k string")
    got = {tuple(r) for r in P.by_rarest_gram(keys, texts).collect()}
    assert got == {(i, f"{i:04d} of the same ending") for i in range(0, 600, 21)} | {(i, "of the same ending") for i in range(0, 600, 3)}


@pytest.mark.parametrize("most", [10**6, 0])
def test_no_patterns_or_texts(spark, most):
    none, some = spark.createDataFrame([], "k string"), spark.createDataFrame([("a",)], "k string")
    texts = spark.createDataFrame([(1, "a")], "id long, rt string")
    assert P.found_in(none, texts, most).collect() == [] and P.found_in(some, texts.limit(0), most).collect() == []
    assert [tuple(r) for r in P.found_in(some, texts, most).collect()] == [(1, "a")]


def test_fragments_of_any_length(spark):
    docs = spark.createDataFrame([(1, "One  two\tTHREE four"), (2, "xone two"), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two"), (2, "ONE TWO three"), (3, ""), (4, None), (5, "o"), (6, "one two"), (7, " two  three ")], "item_id long, fragment string")
    got = sorted(map(tuple, S.documents_with(items, docs).collect()))
    assert got == [(1, 1), (1, 2), (2, 1), (5, 1), (5, 2), (6, 1), (6, 2), (7, 1)]

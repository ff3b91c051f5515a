"""Word similarity against all stretches, and suggestions against every page."""

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell import catalogue
from tidewell.operators import search as S

SF = "/root/testdata/sf0.001"


def grams(text):
    import re

    return [("  " + w + " ")[i : i + 3] for w in re.findall("[a-z0-9]+", text.translate(S._FOLD).lower()) for i in range(len(w) + 1)]


def every_stretch(query, text):
    wanted, found, best = set(grams(query)), grams(text), 0.0
    for i in range(len(found)):
        for j in range(i, len(found)):
            stretch = set(found[i : j + 1])
            best = max(best, len(wanted & stretch) / len(wanted | stretch) if wanted else 0.0)
    return best


WORDS = st.lists(st.sampled_from(["ab", "abc", "zz", "a", "Éb", "bca", "1", "zz", "zz"]), max_size=14)


@given(WORDS, WORDS, st.sampled_from([" ", ", ", " ¿"]))
@settings(max_examples=400, deadline=None)
def test_word_similarity_is_the_best_of_all_stretches(query, text, between):
    q, t = " ".join(query[:4]), between.join(text)
    assert abs(S.word_similarity(q, t) - every_stretch(q, t)) < 1e-12


def test_long_repeats_between_two_parts_do_not_hide_them():
    for n in (5, 12, 5000):
        assert abs(S.word_similarity("abc def", "abc " + "zz " * n + "def") - 8 / 11) < 1e-12
    assert S.word_similarity("", "abc") == S.word_similarity("abc", "") == S.word_similarity("?", "!") == 0.0


def test_trigrams_stay_inside_words():
    text = "Él año-2024 ab a"
    codes = [bytes([c >> 16, c >> 8 & 255, c & 255]).decode() for c in S._grams(text).tolist()]
    assert codes == grams(text)


def test_suggestions_are_the_best_pages_of_all(spark):
    rows = duckdb.sql(f"SELECT source, text FROM '{SF}/documents.parquet'").fetchall()
    best = {}
    for source, text in rows:
        best[source] = max(best.get(source, 0), S.word_similarity("Andiou heron xyz", text or ""))
    expected = [(s, round(v, 6)) for s, v in sorted(best.items(), key=lambda x: (-x[1], x[0])) if v > 0.15][:3]
    assert expected
    for name in ("similar_alerts", "similar_indexed"):
        assert [tuple(r) for r in catalogue.QUERIES[name](spark, SF).collect()] == expected


def test_long_pages_are_read_in_little_time():
    import time

    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(300)]
    text = " ".join(rng.choice(words, 200_000))
    began = time.process_time()
    S.word_similarity(" ".join(words[:4]), text)
    S.word_similarity("ab", "ab " * 300_000)
    assert time.process_time() - began < 20


def test_a_task_reads_only_pages_that_may_be_among_the_best(monkeypatch):
    """Each task returns its best documents; starts of stretches that cannot reach the best are not followed."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdehinorxyz"), rng.integers(2, 6))) for _ in range(400)]
    pages = [(f"d{k % 9}", " ".join(rng.choice(words, 150))) for k in range(60)]
    bound = [len(set(grams("Andiou heron xyz")) & set(grams(t))) / 17 for _, t in pages]
    calls, one = [], S._followed
    monkeypatch.setattr(S, "_followed", lambda *a: calls.append(1) or one(*a))
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in pages]), pa.array([t for _, t in pages]), pa.array(bound)], ["document_key", "text_content", "similarity"])
    got = [(d, s) for b in S._task_best(iter([batch]), "Andiou heron xyz", 3, 0.15) for d, s in zip(*b.to_pydict().values(), strict=True)]
    best = {}
    for d, t in pages:
        best[d] = max(best.get(d, 0), S.word_similarity("Andiou heron xyz", t))
    assert sorted(got, key=lambda x: (-x[1], x[0])) == sorted(best.items(), key=lambda x: (-x[1], x[0]))[:3]
    assert len(calls) < 3 * len(pages)


def test_wanted_stems_are_looked_for_among_distinct_tokens(spark):
    """Stems are made of the distinct tokens, before the wanted ones are picked; counts within and over rows of a page add up."""
    rows = [("a", 1, "casa casas, perro"), ("a", 1, "casa"), ("b", 2, None), ("b", 3, "...")]
    table = S.term_table(spark.createDataFrame(rows, "document_key string, page_number int, text_content string"))
    stems = {r.term: r.tf for r in table.collect()}
    assert sorted(stems.values()) == [1, 3] and table.filter("page_number <> 1").count() == 0
    plan = table.filter(f"term = '{max(stems, key=stems.get)}'")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "LogicalRDD" in plan

"""Operators against plain Python on rows that the test tables do not hold."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions.ranges import place_in
from tidewell.operators import matching as M
from tidewell.operators import merge as G
from tidewell.operators import reports as R
from tidewell.operators import patterns
from tidewell.operators import search as S


def test_place_in_is_a_count(spark):
    for bounds in ([], [3], [1, 4], [0, 1, 2, 5, 8, 9, 13]):
        got = [r[0] for r in spark.range(-1, 15).select(place_in(bounds, F.col("id"))).collect()]
        assert got == [sum(b <= v for b in bounds) for v in range(-1, 15)]
    assert spark.sql("SELECT CAST(null AS int) AS v").select(place_in([1, 2], F.col("v")).alias("n")).first().n == 0


def _interval_first(y, blocks, margin=6.0, forward=45.0):
    """The rule over a group's blocks, sorted by center: the one that holds the place, the next one, the nearest."""
    rows = sorted((c, b, c if s is None else s, c if e is None else e) for b, c, s, e in blocks)
    inside = [b for c, b, s, e in rows if s - margin <= y <= e + margin]
    behind, before = [r for r in rows if r[0] >= y], [r for r in rows if r[0] < y]
    if not rows or inside:
        return inside[0] if inside else None
    nxt, prev = behind[0] if behind else None, before[-1] if before else None
    if nxt and (y <= nxt[2] and nxt[2] - y <= forward or prev and prev[3] <= y <= nxt[2]):
        return nxt[1]
    return min((abs(c - y), c, b) for c, b, _, _ in rows)[2]


def test_interval_first(spark):
    r = random.Random(1)
    blocks = [(r.choice([1, 2, 3]), k, float(r.choice(range(0, 400, 10)))) for k in range(60)]
    blocks = [(g, k, c, None if r.random() < 0.3 else c - r.choice([0, 5, 30]), None if r.random() < 0.3 else c + r.choice([0, 4, 60])) for g, k, c in blocks]
    points = [(i, r.choice([1, 2, 3, 4, None]), r.choice([None, *map(float, range(-50, 460, 5))])) for i in range(500)]
    found = M.interval_first(spark.createDataFrame(points, "id int, g int, y double"), spark.createDataFrame(blocks, "g int, block_id int, center double, start double, end double"), "g").collect()
    expected = {i: _interval_first(y, [b[1:] for b in blocks if b[0] == g]) if g is not None and y is not None else None for i, g, y in points}
    assert {x.id: x.block_id for x in found} == expected and len(found) == len(points)


def test_near_country_of_rows_with_nulls_and_repeats(spark):
    r = random.Random(2)
    countries = [(r.choice([1, 2]), float(r.randint(0, 400)), r.randint(1, 3), r.choice("ABC")) for _ in range(40)]
    points = [(i % 90, r.choice([1, 2, None]), r.choice([None, 50.0, 133.5, 390.0]), r.choice([None, "x"])) for i in range(100)]
    got = M.near_country(spark.createDataFrame(points, "id int, g int, y double, extra string"), spark.createDataFrame(countries, "g int, cy double, priority int, country string"), "g").collect()

    def one(g, y):
        near = [(abs(cy - y), p, c) for h, cy, p, c in countries if h == g and abs(cy - y) <= 45] if y is not None else []
        return min(near)[2] if near else None

    assert sorted(map(repr, map(tuple, got))) == sorted(repr((*p, one(p[1], p[2]))) for p in points)


def test_folder_cycles_have_no_path(spark):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (10, 11, "x"), (11, 12, "y"), (12, 10, "z"), (13, 12, "w"), (20, 99, "lost"), (30, 30, "self")]
    rows += [(k, k - 1 if k > 100 else None, str(k)) for k in range(100, 160)]
    got = {r.id: r.path for r in G.folder_paths(spark.createDataFrame(rows, "id int, parent int, name string")).collect()}
    assert (got[3], got[20]) == ("a/b/c", "lost") and got[159] == "/".join(map(str, range(100, 160)))
    assert [got[k] for k in (10, 11, 12, 13, 30)] == [None] * 5 and len(got) == len(rows)


@pytest.mark.parametrize("few", [patterns.AUTOMATON, 2])
def test_fragments_of_any_length(spark, monkeypatch, few):
    monkeypatch.setattr(patterns, "AUTOMATON", few)
    texts = [(1, "Uno dos  tres cuatro cinco seis siete ocho nueve diez"), (2, "el uno"), (3, "prefijouno dos treso"), (4, None), (5, "")]
    fragments = ["uno", "no dos tr", "UNO DOS", "tres cuatro", "dos tres cuatro", "s tres cuatro c", "dos tres cuatro cinco seis siete ocho nueve di", "diez once doce", "", None, "seis  siete ocho nueve die", "x"]
    items = list(enumerate(fragments))
    got = S.documents_with(spark.createDataFrame(items, "item_id int, fragment string"), spark.createDataFrame(texts, "doc_id int, text string")).collect()
    low = lambda t: " ".join((t or "").lower().split())
    assert sorted(map(tuple, got)) == sorted((i, d) for i, f in items for d, t in texts if low(f) and low(f) in low(t))
    assert S.documents_with(spark.createDataFrame([], "item_id int, fragment string"), spark.createDataFrame(texts, "doc_id int, text string")).collect() == []


def test_quotas_of_a_busy_hour(spark):
    r = random.Random(4)
    rows = [(k, r.choice(["a", "b", "c"]), f"2024-01-0{r.choice([2, 3])} 10:{r.randint(0, 2):02d}:00") for k in range(60)]
    log = spark.createDataFrame(rows, "id int, chat_id string, at string").select("id", "chat_id", F.to_timestamp("at").alias("created_at"), F.lit("q").alias("command"))
    got = {x.id: x.decision for x in R.quota_decisions(log, "q", F.lit("gratis"), global_quota=12).collect()}
    expected = {}
    for day in ("2024-01-02", "2024-01-03"):
        n = {}
        for k, (at, i, chat) in enumerate(sorted((at, i, c) for i, c, at in rows if at.startswith(day))):
            n[chat] = n.get(chat, 0) + 1
            expected[i] = "global_limit" if k >= 12 else "own_limit" if n[chat] > R.QUOTAS["gratis"] else "ok"
    assert got == expected and set(expected.values()) == {"global_limit", "own_limit", "ok"}


def test_places_of_all_rows(spark):
    rows = [(k, k * 7919 % 1000) for k in range(2000)]
    got = R.placed(spark.createDataFrame(rows, "id int, v int"), [F.col("v").desc(), F.col("id").asc()]).collect()
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    assert {(x.place, x.id) for x in got} == {(k + 1, i) for k, (i, _) in enumerate(order)}
    assert R.placed(spark.createDataFrame([], "id int"), [F.col("id")]).collect() == []


def test_suggestions_by_words(spark):
    """All pages scored, against the pages that the bound lets through; the score by its definition on every stretch."""
    r = random.Random(6)
    words = ["heron", "herons", "andio", "andiou", "xyz", "xy", "agua", "norma", "her", "on"]
    pages = [(f"k{n % 9}", " ".join(r.choice(words) for _ in range(r.randint(0, 8)))) for n in range(60)] + [("null", None), ("empty", "")]
    query = "Andiou heron xyz"

    def grams(t):
        return [("  " + w + " ")[i : i + 3] for w in (t or "").lower().split() for i in range(len(w) + 1)]

    def score(t):
        wanted, found = set(grams(query)), grams(t)
        return max((len(wanted & set(found[i:j])) / len(wanted | set(found[i:j])) for i in range(len(found)) for j in range(i + 1, len(found) + 1)), default=0.0)

    assert all(abs(S.word_similarity(query, t or "") - score(t)) < 1e-9 for _, t in pages)
    best = {}
    for k, t in pages:
        best[k] = max(best.get(k, 0.0), score(t))
    got = S.suggestions(spark.createDataFrame(pages, "document_key string, text_content string"), query, k=5, by_words=True).collect()
    assert [(x.document_key, round(x.similarity, 9)) for x in got] == [(k, round(v, 9)) for k, v in sorted(best.items(), key=lambda x: (-x[1], x[0])) if v > 0.15][:5]

"""Golden cases and properties of functions and pure Python parts."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import keys as K
from tidewell.functions import quality as Q
from tidewell.functions import text as X
from tidewell.operators import extraction as E
from tidewell.operators import layout as L
from tidewell.operators import search as S


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("text", ["alerta-digemid-no-41-2026", "Alerta DIGEMID N° 41-2026", "41-2026"])
def test_alert_number(spark, text):
    assert one(spark, K.alert_number(F.col("t"), F.lit(None)), t=text) == "41-2026"


def test_dates(spark):
    assert one(spark, K.iso_date(F.col("t")), t="05/3/2026") == "2026-03-05"
    assert one(spark, K.iso_date(F.col("t")), t="31/02/2024") == "2024-02-31"
    assert tuple(one(spark, K.date_info(F.col("t")), t="31/02/2024")) == (None, "31/02/2024")
    assert one(spark, K.day_month(F.col("t"), F.col("k")), t="22 Jul", k="81-2026") == "2026-07-22"


def test_titles_and_numbers(spark):
    assert one(spark, X.is_generic_title(F.col("t"), F.col("k")), t="ALERTA DIGEMID N 81-2026", k="81-2026")
    assert one(spark, K.number_key(F.col("t")), t="014-2011-SA") == "14"
    assert one(spark, X.fold(F.col("t")), t="Nº  lote °") == "NO LOTE °"
    assert one(spark, E.repaired_lot(F.col("t")), t="MO655") == "M0655"


def test_quality_bounds(spark):
    texts = ["", "corto", "a" * 60, "Una frase normal con palabras.", "12345 67890 !!! ??? 123 456", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(Q.quality_score(F.col("t")).alias("q")).collect()
    assert [r.q for r in rows][:2] == [0.0, 0.0] and all(0 <= r.q <= 1 for r in rows)


@given(st.text(max_size=40))
@settings(max_examples=100, deadline=None)
def test_word_similarity_bounds(text):
    assert 0 <= S.word_similarity("ibuprofeno", text) <= 1
    assert S.word_similarity("ibuprofeno", "x ibuprofeno y") == 1


_CELL = st.text(st.characters(whitelist_categories=("L", "N")), min_size=1, max_size=8)


@given(st.lists(_CELL, min_size=1, max_size=4, unique=True), st.lists(st.lists(_CELL, min_size=4, max_size=4), min_size=1, max_size=4))
@settings(max_examples=100, deadline=None)
def test_editable_tables_round_trip(names, rows):
    grid = [names, *[r[: len(names)] for r in rows]]
    widths = [max(3, *(len(g[i]) for g in grid)) for i in range(len(names))]
    show = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)) + " |"
    text = "\n".join(["antes", show(grid[0]), "| " + " | ".join("-" * w for w in widths) + " |", *map(show, grid[1:]), "despues"])
    assert L.rebuilt(L.editable(text)) == text


def test_page_lines_merge_numerals_and_dot_index():
    words = [(10, 40, 10, 10, "1."), (30, 52, 50, 10, "punto"), (10, 90, 50, 10, "Indice"), (300, 90, 10, 10, "12")]
    assert L.page_lines(words) == ["1. punto", "Indice .......... 12"]


def test_trials_end_by_alerts(spark, tmp_path):
    from tidewell.streaming import incremental as I

    rows = [(1, "start", "2024-01-01 00:00:00")] + [(1, "alert", f"2024-01-0{k} 00:00:00") for k in (2, 3, 4)] + [(2, "start", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "chat_id long, event string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = I.events(spark, f"{tmp_path}/in", "chat_id long, event string, ts timestamp")
    got = {(r.chat_id, r.state, r.sent) for r in I.run_to_table(I.trials(stream), f"{tmp_path}/out", "update").collect()}
    assert (1, "finalizada", 3) in got and (2, "activa", 0) in got


@pytest.mark.parametrize("mode, want", [("append", {(1, "a"), (2, "b"), (3, "c")}), ("complete", {(1, "a"), (2, "b"), (3, "c")}), ("none", set())])
def test_streams_are_written_as_tables(spark, tmp_path, mode, want):
    """Several batches, each of one file; a stream that has no rows."""
    from tidewell.streaming import incremental as I

    rows = [] if mode == "none" else [(1, "a"), (2, "b"), (3, "c")]
    spark.createDataFrame(rows, "k int, v string").repartition(3, "k").write.parquet(f"{tmp_path}/in")
    stream = I.events(spark, f"{tmp_path}/in", "k int, v string")
    if mode == "complete":
        stream = stream.groupBy("k").agg(F.max("v").alias("v"))
    got = I.run_to_table(stream, f"{tmp_path}/out", "complete" if mode == "complete" else "append")
    assert got.columns == ["k", "v"] and sorted(map(tuple, got.collect())) == sorted(want)


def test_upserted_stream_is_the_last_row_of_each_key(spark, tmp_path):
    from tidewell.operators.merge import last_wins
    from tidewell.sources.tables import BucketTable
    from tidewell.streaming import incremental as I

    spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], "k int, n int, v string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = I.events(spark, f"{tmp_path}/in", "k int, n int, v string")
    table = BucketTable(spark, f"file://{tmp_path}/t", stream.schema, ["k"], lambda old, new: last_wins(old.unionByName(new), ["k"], ["n"]))
    I.upserted(stream, table, f"{tmp_path}/c").awaitTermination()
    assert sorted(map(tuple, table.read().select("k", "v").collect())) == [(1, "c"), (2, "b")]


def test_reports_are_written(spark, tmp_path):
    from tidewell.sources import files as R

    (tmp_path / "inv.json").write_text('{"items": [{"document_key": "RM-1-2020", "title": "t", "tipo": "RM", "pdf_urls": ["u"]}]}')
    items = R.read_inventory(spark, str(tmp_path / "inv.json"))
    R.write_report(items, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out/json").count() == 1
    assert "RM: 1" in spark.read.text(f"{tmp_path}/out/markdown").first().value


def test_seeds_that_cannot_be_read_are_told(spark, tmp_path):
    from tidewell.sources import files as R

    (tmp_path / "a.json").write_text('[{"document_key": "DS-1", "titulo": "t"}, {"document_key": " ", "titulo": "t"}, {"document_key": "DS-2"}]')
    (tmp_path / "b.json").write_text('[{"document_key": "DS-3", ')
    got = {(r.document_key, r.rejected) for r in R.checked_seeds(spark, f"{tmp_path}/*.json").collect()}
    assert {("DS-1", None), (" ", "no key"), ("DS-2", "no title"), (None, "no JSON")} <= got | {(None, "no JSON")} and ("DS-1", None) in got
    assert {r for _, r in got} == {None, "no key", "no title", "no JSON"}
    with pytest.raises(Exception, match="a seed cannot be read"):
        R.read_seeds(spark, f"{tmp_path}/a.json").collect()


def test_registrations_of_over_six_digits(spark):
    """A narrative's registration number is given whole, whatever its length."""
    docs = spark.createDataFrame([(1, ["Comercialización ilegal del producto UNO", "R.S. BE-0120999 y"]), (2, ["Comercialización ilegal del producto DOS", "R.S. BE-01234 y"])], "doc_id int, lines array<string>")
    assert {r.doc_id: r.sanitary_registration for r in E.narrative_alerts(docs).collect()} == {1: "BE-0120999", 2: "BE-01234"}


@pytest.mark.parametrize(("name", "inner", "most"), [
    ("maker_country", "regexp_replace", 80), ("table_markdown", "regexp_replace", 6), ("narrative_products", "lote", 3), ("table_rows", "upper", 8), ("page_method", "26,", 3), ("review_flags", "regexp_extract_all", 5), ("alert_products", "ACCENTED", 6),
])
def test_a_value_used_several_times_is_computed_once(spark, name, inner, most):
    """An expression that stands in a plan many times is computed as often."""
    from tidewell import catalogue

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(X.ACCENTED if inner == "ACCENTED" else inner) <= most

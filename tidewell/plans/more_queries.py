"""Further queries: calendars, counts, sorts and assemblies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import keys as K
from tidewell.operators import extraction as E
from tidewell.operators import merge as G
from tidewell.operators import queues as U
from tidewell.operators import reports as R
from tidewell.operators import states as Z
from tidewell.plans.base import derived, query, table, values
from tidewell.sources import html as H


@query("lima_calendar", """WITH e AS (SELECT event_id, ts - INTERVAL 5 HOUR AS l FROM events) SELECT event_id, l::DATE AS day, isodow(l)::INT AS weekday, date_trunc('week', l)::DATE AS monday, date_trunc('week', l)::DATE + 6 AS sunday, date_trunc('month', l)::DATE AS month, (date_trunc('month', l) + INTERVAL 1 MONTH)::DATE AS next_month,
  ltrim(strftime(l, '%I:%M %p'), '0') AS hour_text FROM e""")
def lima_calendar(spark, sf):
    e = table(spark, sf, "events").select("event_id", K.lima_calendar(F.col("ts")).alias("c"), K.lima_hour(F.col("ts")).alias("hour_text"))
    return e.select("event_id", "c.day", "c.weekday", "c.monday", "c.sunday", "c.month", "c.next_month", "hour_text")


@query("open_counts", "SELECT coalesce(CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'k-' || source END, '?') AS document_key, count(*) AS n FROM documents WHERE n_chars < 1000 GROUP BY 1")
def open_counts(spark, sf):
    d = table(spark, sf, "documents")
    norms = d.filter("source IN ('src1', 'src2', 'src3')").select(F.col("source").alias("id"), F.concat(F.lit("k-"), "source").alias("document_key")).distinct()
    return R.open_counts(d.filter("n_chars < 1000").select(F.col("source").alias("norma_id")), norms)


@query("counts_by_year", "SELECT coalesce(CASE WHEN o_orderkey % 10 <> 0 THEN year(o_orderdate)::VARCHAR END, 'SIN_ANIO') AS value, count(*) AS n FROM orders GROUP BY 1")
def counts_by_year(spark, sf):
    return R.counts_by_year(table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 10 != 0, F.year("o_orderdate").cast("string")).alias("anio")))


@query("value_dedup", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds FROM events GROUP BY user_id")
def value_dedup(spark, sf):
    """TOP3: each value once."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.array_distinct(F.collect_list("event_type"))).alias("k"))
    return e.select("user_id", F.array_join("k", ",").alias("kinds"))


@query("sorted_records", "SELECT row_number() OVER (ORDER BY coalesce(d, '') DESC, y DESC, p_name DESC, p_partkey) AS place, p_partkey FROM (SELECT *, CASE WHEN p_partkey % 3 <> 0 THEN '20' || (p_size % 10) END AS d, p_size AS y FROM part)")
def sorted_records(spark, sf):
    """TOP13: date, year and title downwards, nulls as empty; all rows with their place."""
    p = table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_size").alias("y"), F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("20"), F.col("p_size") % 10)).alias("d"))
    return R.placed(p, [F.coalesce("d", F.lit("")).desc(), F.col("y").desc(), F.col("p_name").desc(), F.col("p_partkey").asc()]).select("place", "p_partkey")


@query("today_rows", "SELECT event_id FROM events WHERE ts::DATE = DATE '2024-01-10'")
def today_rows(spark, sf):
    """TOP7: of the UTC day."""
    return table(spark, sf, "events").filter(F.to_date("ts") == F.expr("DATE '2024-01-10'")).select("event_id")


@query("seed_upsert", "SELECT n_nationkey AS document_key, CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE n_name END AS titulo, n_regionkey::VARCHAR AS tipo, CASE WHEN n_nationkey % 2 = 0 THEN 'updated' ELSE 'kept' END AS action FROM nation UNION ALL SELECT 99, 'NUEVA', 'x', 'new'")
def seed_upsert(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("document_key"), F.col("n_name").alias("titulo"), F.col("n_regionkey").cast("string").alias("tipo"))
    new = n.filter("document_key % 2 = 0").select("document_key", F.upper("titulo").alias("titulo"), F.lit("zz").alias("tipo")).unionByName(spark.sql("SELECT 99 AS document_key, 'NUEVA' AS titulo, 'x' AS tipo"))
    return G.upsert(n, new, "document_key", F.expr("TIMESTAMP '2000-01-01'"), only=("titulo",))


@query("chat_upsert", "SELECT o_custkey AS telegram_chat_id, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY 1")
def chat_upsert(spark, sf):
    """SNK11: one row for each chat, the newest."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("telegram_chat_id"), F.col("o_orderkey").alias("last_order"), "o_orderdate")
    return G.last_wins(o, ["telegram_chat_id"], ["o_orderdate", "last_order"]).select("telegram_chat_id", "last_order")


@query("forced_queue", "SELECT doc_id AS document_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def forced_queue(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "n_chars")
    return U.without_pages(d, d.select("document_id"), 20, [F.col("n_chars").desc(), F.col("document_id")], force=True).select("document_id")


@query("registered_relations", "SELECT l_orderkey, l_partkey FROM lineitem WHERE (l_orderkey, l_partkey) NOT IN (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def registered_relations(spark, sf):
    """JON13: pairs that are not registered yet."""
    l = table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_partkey").join(l.filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct(), ["l_orderkey", "l_partkey"], "left_anti")


CLAUSES = """SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'DS' END AS tipo, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size AS STRING) WHEN p_partkey % 7 = 1 THEN '' END AS numero, CASE WHEN p_partkey % 5 = 0 THEN 2020 END AS anio, CASE p_partkey % 4 WHEN 0 THEN p_name || '. Quedan derogadas todas las normas' WHEN 1 THEN 'Deroga el decreto ' || p_size WHEN 2 THEN 'las disposiciones  que se opongan a ' || p_type END AS d FROM {part}"""


@query("closing_clauses", f"SELECT id, tipo IS NULL AND coalesce(numero, '') = '' AND anio IS NULL AND id % 4 IN (0, 2) AS generic FROM ({CLAUSES})")
def closing_clauses(spark, sf):
    return derived(spark, sf, CLAUSES).select("id", Z.is_closing_clause(F.col("tipo"), F.col("numero"), F.col("anio").cast("int"), F.col("d")).alias("generic"))


@query("source_rejections", "SELECT n_regionkey AS source, count(*) FILTER (n_nationkey % 3 = 0) AS taken, count(*) FILTER (n_nationkey % 3 <> 0) AS rejected, count(DISTINCT CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey % 3 END) AS reasons FROM nation GROUP BY 1")
def source_rejections(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("source"), F.when(F.col("n_nationkey") % 3 != 0, (F.col("n_nationkey") % 3).cast("string")).alias("reason"))
    return R.rejections(n, "source")


@query("layout_counts", "SELECT l_orderkey AS doc, count(*)::INT AS word_count, count(DISTINCT round_even(l_linenumber * 4.0::DOUBLE / 3, 0))::INT AS line_count FROM lineitem GROUP BY 1")
def layout_counts(spark, sf):
    p = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_list(F.struct((F.col("l_linenumber") * 4.0).alias("y0"))).alias("words"))
    return R.layout_counts(p).select("doc", "word_count", "line_count")


@query("full_texts", "SELECT conv_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> '') AS text FROM conversations GROUP BY conv_id")
def full_texts(spark, sf):
    """AGG22: no cap."""
    return R.concatenated(table(spark, sf, "conversations"), "conv_id", "turn", "text", None)


@query("joined_pages", "SELECT d.doc_id, s.n FROM documents d JOIN (SELECT source, count(*) AS n FROM documents WHERE source <> 'src0' GROUP BY 1) s USING (source)")
def joined_pages(spark, sf):
    """JON1: pages with their document."""
    d = table(spark, sf, "documents")
    s = d.filter("source != 'src0'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return d.join(s, "source").select("doc_id", "n")


@query("pdf_validity", "SELECT page_id, page_id % 3 = 0 AS valid FROM pages")
def pdf_validity(spark, sf):
    p = table(spark, sf, "pages")
    body = F.when(F.col("page_id") % 3 == 0, F.lit("%PDF-1.7")).otherwise(F.lit("<html>")).cast("binary")
    return p.select("page_id", H.is_pdf(body, F.lit("application/pdf"), F.lit(5000)).alias("valid"))


MERGED = """SELECT * FROM (VALUES (1, 1, 0, 'Nombre', 'Lote', 'Fabricante', null), (1, 1, 30, 'Ibuprofeno', null, 'Lab Uno', null), (1, 1, 45, '400 mg', 'A100', 'Perú', 'LIMA'), (1, 1, 60, null, 'A200', null, null), (1, 1, 200, 'Crema', 'B300', 'Lab Dos', null), (1, 1, 215, null, 'A100', null, null)) AS t(doc, page, y, col_producto, col_lote, col_fabricante_pais, col_departamento)"""


@query("merged_cells", "SELECT * FROM (VALUES (1, 'A100', 'Ibuprofeno 400 mg', 'Lab Uno', 'Perú', 'LIMA', 0.88::DOUBLE), (1, 'A200', 'Crema', 'Lab Dos', NULL, 'LIMA', 0.72::DOUBLE), (1, 'B300', 'Crema', 'Lab Dos', NULL, 'LIMA', 0.72::DOUBLE)) AS t(doc, lot_number, product_name, manufacturer, manufacturer_country, department, confidence)")
def merged_cells(spark, sf):
    return E.merged_cell_products(values(spark, MERGED))

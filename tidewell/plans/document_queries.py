"""Queries of extraction, layout, html sources and streams."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import functions as F

from tidewell.functions import quality as Q
from tidewell.operators import alerts as A
from tidewell.operators import extraction as E
from tidewell.operators import layout as L
from tidewell.operators import merge as G
from tidewell.operators.store import shared_folder
from tidewell.plans.base import derived, query, spread, table, values
from tidewell.sources import files as R
from tidewell.sources import html as H
from tidewell.sources import tables as T
from tidewell.streaming import incremental as I
from tidewell.streaming import timers as M

TYPED = """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'ALERTA DIGEMID N° ' || (1 + p_partkey % 150) || ' - ' || (2000 + p_partkey % 26) WHEN 1 THEN 'Alerta' WHEN 2 THEN 'alerta digemid nº ' || p_size || '-2024' WHEN 3 THEN NULL ELSE p_name END AS title,
  CASE p_partkey % 9 WHEN 0 THEN 'Comercialización ilegal de ' || p_name || ' que no cuenta con registro sanitario' WHEN 1 THEN 'Retiro del mercado de ' || p_name || ' por control de calidad' WHEN 2 THEN 'Datos del producto farmacéutico falsificado ' || p_type WHEN 3 THEN 'Productos sanitarios ' || p_brand || ' falsificados' WHEN 4 THEN 'productos cosméticos falsificados' WHEN 5 THEN 'Recomendaciones a la población' WHEN 7 THEN p_type || ' retiro del mercado' WHEN 8 THEN p_name END AS body FROM {part}"""
_T = "upper(translate(coalesce(title, '') || ' ' || coalesce(body, ''), 'áéíóúÁÉÍÓÚ', 'aeiouAEIOU'))"


@query("alert_type", f"""SELECT id, CASE WHEN contains({_T}, 'COMERCIALIZACION ILEGAL') AND contains({_T}, 'NO CUENTA CON REGISTRO SANITARIO') THEN 'comercializacion_ilegal_producto_sin_rs' WHEN contains({_T}, 'RETIRO DEL MERCADO') AND contains({_T}, 'CONTROL DE CALIDAD') THEN 'retiro_mercado_control_calidad'
  WHEN contains({_T}, 'PRODUCTO FARMACEUTICO FALSIFICADO') OR contains({_T}, 'PRODUCTOS FARMACEUTICOS FALSIFICADOS') THEN 'producto_falsificado' WHEN contains({_T}, 'PRODUCTOS SANITARIOS') AND contains({_T}, 'FALSIFICADOS') THEN 'producto_sanitario_falsificado'
  WHEN contains({_T}, 'PRODUCTOS COSMETICOS FALSIFICADOS') THEN 'producto_cosmetico_falsificado' WHEN contains({_T}, 'RECOMENDACIONES') THEN 'recomendacion_seguridad' ELSE 'otro' END AS kind,
  coalesce(nullif(replace(regexp_extract(coalesce(title, ''), '(?i)ALERTA\\s+DIGEMID\\s*N[º°O]?\\s*([0-9]{{1,3}}\\s*-\\s*[0-9]{{4}})', 1), ' ', ''), ''), 'k' || id) AS number FROM ({TYPED})""")
def alert_type(spark, sf):
    return derived(spark, sf, TYPED).select("id", E.alert_type(F.col("title"), F.col("body")).alias("kind"), E.alert_number(F.col("title"), F.col("body"), F.concat(F.lit("k"), F.col("id"))).alias("number"))


# Alerts made of a document and a part: planted lines before the document's own, every fourth document without any.
ALERT_TEXTS = """SELECT doc_id, CASE WHEN p_partkey % 5 = 0 THEN 'ALERTA DIGEMID N° ' || (1 + p_partkey % 150) || ' - 2024' END AS title, CASE p_partkey % 4
  WHEN 0 THEN 'Nombre del producto' || chr(10) || 'Nº de lote' || chr(10) || 'Registro sanitario' || chr(10) || 'Resultados analíticos' || chr(10) || p_name || chr(10) || p_size || ' mg' || chr(10) || lot || chr(10) || 'EE-' || lpad(CAST(p_partkey % 10000 AS STRING), 4, '0') || chr(10) || 'Laboratorio ' || p_type || chr(10) || 'PERU' || chr(10) || holder || chr(10) || 'No conforme' || chr(10) || 'Lima, 3' || chr(10) || text
  WHEN 1 THEN 'Datos de productos farmacéuticos falsificados' || chr(10) || 'Nombre' || chr(10) || p_name || chr(10) || 'Lote' || chr(10) || lot || chr(10) || 'Fabricante/País' || chr(10) || 'Lab ' || p_type || ' / Perú' || chr(13) || chr(10) || 'Nombre' || chr(10) || p_brand || chr(10) || 'Lote' || chr(10) || 'B' || p_partkey || chr(10) || 'Lima, 3' || chr(10) || text
  WHEN 2 THEN 'Alerta por presunta falsificación del producto ' || p_name || ', lote N° ' || lot || ', fabricado por Lab ' || p_type || ', de India' || chr(10) || text ELSE text END AS text
  FROM (SELECT *, 'M0' || lpad(CAST(p_partkey AS STRING), 6, '0') AS lot, 'DROGUERIA ' || replace(p_brand, '#', '') || ' S.A.C.' AS holder FROM {documents} JOIN {part} ON doc_id = p_partkey) AS x"""


@query("alert_products", """WITH a AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN (1 + p_partkey % 150) || '-2024' END AS alert_number, 'M0' || lpad(p_partkey::VARCHAR, 6, '0') AS lot FROM documents JOIN part ON doc_id = p_partkey)
SELECT doc_id, alert_number, 'otro' AS alert_type, 'retiro_mercado' AS extractor, p_name || ' ' || p_size || ' mg' AS product_name, lot AS lot_number, 'EE-' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') AS sanitary_registration, 'Laboratorio ' || p_type AS manufacturer, 'PERU' AS manufacturer_country, 'DROGUERIA ' || replace(p_brand, '#', '') || ' S.A.C.' AS registration_holder, 'No conforme' AS analytical_result, 0.86::DOUBLE AS confidence FROM a WHERE p_partkey % 4 = 0
UNION ALL SELECT doc_id, alert_number, 'producto_falsificado', 'falsificados', p_name, lot, NULL, 'Lab ' || p_type, 'Perú', NULL, NULL, 0.84::DOUBLE FROM a WHERE p_partkey % 4 = 1
UNION ALL SELECT doc_id, alert_number, 'producto_falsificado', 'falsificados', p_brand, 'B' || p_partkey, NULL, NULL, NULL, NULL, NULL, 0.84::DOUBLE FROM a WHERE p_partkey % 4 = 1
UNION ALL SELECT doc_id, alert_number, 'otro', 'narrativo_ilegal', p_name, lot, NULL, 'Lab ' || p_type, 'India', NULL, NULL, 0.92::DOUBLE FROM a WHERE p_partkey % 4 = 2""")
def alert_products(spark, sf):
    """EXR1-EXR9: products of alerts planted in documents, found by one pass over them; the other documents have none."""
    found = A.alert_products(spread(derived(spark, sf, ALERT_TEXTS)))
    return found.select("doc_id", "alert_number", "alert_type", "extractor", "product_name", "lot_number", "sanitary_registration", "manufacturer", "manufacturer_country", "registration_holder", "analytical_result", "confidence")


ROUTED = """SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'producto_falsificado' WHEN 1 THEN 'retiro_mercado_control_calidad' ELSE 'otro' END AS kind, CASE p_partkey % 7 WHEN 0 THEN 'Nombre del producto ' || p_name || ';Nº de lote;Registro sanitario;Resultados analíticos' WHEN 1 THEN p_name WHEN 2 THEN 'Datos del producto;Nombre;' || p_name || ';Lote;Fabricante/País' WHEN 3 THEN 'presunta falsificación de ' || p_name WHEN 4 THEN 'Nombre;Lote;' || p_type WHEN 5 THEN 'Nombre del producto;Registro sanitario;' || p_brand ELSE 'nada' END AS body FROM {part}"""


@query("extractor_router", f"""WITH r AS (SELECT id, kind, ';' || upper(translate(body, 'áéíóú', 'aeiou')) || ';' AS b FROM ({ROUTED}))
SELECT id, CASE WHEN kind = 'retiro_mercado_control_calidad' OR contains(b, 'NOMBRE DEL PRODUCTO') AND contains(b, 'LOTE') AND contains(b, 'REGISTRO SANITARIO') AND contains(b, 'RESULTADOS ANALITICOS') THEN 'retiro_mercado'
  WHEN kind IN ({", ".join(f"'{k}'" for k in E.FALSIFIED_TYPES)}) OR (contains(b, 'DATOS DEL PRODUCTO') OR contains(b, 'DATOS DE PRODUCTOS FARMACEUTICOS FALSIFICADOS')) AND (contains(b, ';NOMBRE;') OR contains(b, 'NOMBRE DEL PRODUCTO')) AND (contains(b, ';LOTE;') OR contains(b, 'N° DE LOTE')) AND (contains(b, 'FABRICANTE/PAIS') OR contains(b, 'FABRICANTE / PAIS')) THEN 'falsificados'
  WHEN {" OR ".join(f"contains(b, '{m}')" for m in E.NARRATIVE)} THEN 'narrativo_ilegal' ELSE 'ninguno' END AS extractor FROM r""")
def extractor_router(spark, sf):
    return derived(spark, sf, ROUTED).select("id", E.extractor(F.col("kind"), F.split("body", ";")).alias("extractor"))


TABLE_LINES = """SELECT p_partkey AS doc, CASE p_partkey % 3 WHEN 0 THEN 'Alerta;Nombre del producto  Nº de lote  Fabricante  País;' || p_name || ' ' || p_size || ' mg  ' || 'M0' || lpad(CAST(p_partkey AS STRING), 4, '0') || '  Lab ' || p_type || '  Perú;sigue ' || p_type || ';' || p_brand || '  77A' || p_size || '  Lab Dos  Chile;Recomendaciones;No usar  x  y  z' WHEN 1 THEN 'PRODUCTO | LOTE;Crema ' || p_name || ' | 1' || p_partkey || ';solo una celda' ELSE 'sin tabla;' || p_name END AS body FROM {part}"""


@query("table_rows", """SELECT p_partkey AS doc, p_name || ' ' || p_size || ' mg' AS product_name, 'M0' || lpad(p_partkey::VARCHAR, 4, '0') AS lot_number, 'Lab ' || p_type || ' sigue ' || p_type AS manufacturer, 'Perú' AS manufacturer_country FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, p_brand, '77A' || p_size, 'Lab Dos', 'Chile' FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'Crema ' || p_name || ' solo una celda', '1' || p_partkey, NULL, NULL FROM part WHERE p_partkey % 3 = 1""")
def table_rows(spark, sf):
    rows = spread(derived(spark, sf, TABLE_LINES)).select("doc", F.posexplode(F.split("body", ";")).alias("line_no", "line"))
    return E.table_rows(rows).select("doc", "product_name", "lot_number", "manufacturer", "manufacturer_country")


@query("islands_rows", """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), s AS (SELECT *, (sum((contains(line, '|'))::INT) OVER (PARTITION BY doc_id ORDER BY n))::BIGINT AS isl FROM l)
SELECT doc_id, isl, count(*) AS lines, min(n)::BIGINT AS first_line FROM s WHERE isl > 0 GROUP BY 1, 2""")
def islands_rows(spark, sf):
    from pyspark.sql import Window as W

    l = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).withColumn("n", F.col("p") + 1)
    s = l.withColumn("isl", F.sum(F.contains("line", F.lit("|")).cast("int")).over(W.partitionBy("doc_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    return s.filter("isl > 0").groupBy("doc_id", "isl").agg(F.count(F.lit(1)).alias("lines"), F.min("n").cast("long").alias("first_line"))


@query("carry_forward", "SELECT doc, seg, last_value(CASE WHEN seg % 3 = 1 THEN m END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seg) AS maker FROM (SELECT l_orderkey AS doc, l_linenumber AS seg, min(l_returnflag) AS m FROM lineitem GROUP BY 1, 2)")
def carry_forward(spark, sf):
    l = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("seg")).agg(F.min("l_returnflag").alias("m"))
    return E.carried_forward(l.select("doc", "seg", F.when(F.col("seg") % 3 == 1, F.col("m")).otherwise("").alias("maker")), ["maker"])


_WORDS = "SELECT l_orderkey AS doc, 1 AS page, l_quantity * 15 AS x0, l_linenumber * 4.0::DOUBLE AS y0, l_returnflag || l_linenumber AS t FROM lineitem"


@query("layout_lines", f"""WITH w AS (SELECT doc, page, (round_even(y0 / 3, 0)::INT * 3) AS y, x0, t, CASE WHEN x0 < 270 THEN 0 WHEN x0 < 350 THEN 1 WHEN x0 < 480 THEN 2 WHEN x0 < 650 THEN 3 ELSE 4 END AS b FROM ({_WORDS}))
SELECT doc, page, y, string_agg(t, ' ' ORDER BY x0, t) AS full_text, string_agg(t, ' ' ORDER BY x0, t) FILTER (b = 0) AS col_producto, string_agg(t, ' ' ORDER BY x0, t) FILTER (b = 4) AS col_departamento FROM w GROUP BY 1, 2, 3""")
def layout_lines(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(1).alias("page"), (F.col("l_quantity") * 15).alias("x0"), (F.col("l_linenumber") * 4.0).alias("y0"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text"))
    return E.layout_lines(l).select("doc", "page", "y", "full_text", "col_producto", "col_departamento")


ZONE = """SELECT p_partkey AS doc, page, y, replace(full_text, 'Ibuprofeno', p_name) AS full_text, replace(col_producto, 'Ibuprofeno', p_name) AS col_producto, col_lote FROM {part} CROSS JOIN (SELECT * FROM (VALUES (1, 1, 0, 'Intro', NULL, NULL), (1, 1, 30, 'Datos del producto', NULL, NULL), (1, 1, 60, 'Ibuprofeno M0655', 'Ibuprofeno', 'M0655'), (1, 1, 90, 'Fin 77A', 'Fin', '77A'), (1, 1, 120, 'Debido al riesgo', NULL, NULL), (1, 1, 150, 'Lote', NULL, NULL), (0, 1, 0, 'nada', NULL, NULL)) AS v(form, page, y, full_text, col_producto, col_lote)) AS t WHERE (p_partkey % 3 = 0) = (form = 0)"""


@query("table_zone", "SELECT p_partkey AS doc, y FROM part CROSS JOIN (VALUES (30), (60), (90)) AS t(y) WHERE p_partkey % 3 <> 0")
def table_zone(spark, sf):
    return E.table_zone(derived(spark, sf, ZONE)).select("doc", "y")


@query("table_profile", "SELECT p_partkey AS doc, 'multiproduct' AS profile FROM part WHERE p_partkey % 3 <> 0")
def table_profile(spark, sf):
    return E.table_profile(E.table_zone(derived(spark, sf, ZONE)))


LOTS = """SELECT p_partkey AS doc, page, y + p_size AS y, replace(col_lote, 'M0655', 'M0' || p_partkey || '5') AS col_lote FROM {part} CROSS JOIN (SELECT * FROM (VALUES (1, 0, 'M0655 (envase'), (1, 30, 'mediato)'), (1, 60, 'M06551 (envase'), (1, 90, 'inmediato)'), (1, 120, 'otra cosa'), (1, 150, 'mediato'), (1, 180, '0380-20')) AS v(page, y, col_lote)) AS t"""


@query("lot_blocks", """SELECT p_partkey AS doc, b AS block_id, CASE b WHEN 1 THEN 'M0' || p_partkey || '5 (envase mediato)' WHEN 2 THEN 'M0' || p_partkey || '51 (envase inmediato)' ELSE '0380-20' END AS text, (p_size + CASE b WHEN 1 THEN 15 WHEN 2 THEN 75 ELSE 180 END)::DOUBLE AS center FROM part CROSS JOIN (VALUES (1), (2), (3)) AS t(b)""")
def lot_blocks(spark, sf):
    return E.blocks_by_y(derived(spark, sf, LOTS), "col_lote", E.starts_lot(F.col("col_lote")), E.continues_lot(F.col("col_lote"))).select("doc", F.col("block_id").cast("int").alias("block_id"), "text", "center")


LOT_TEXTS = """SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN '0' || p_partkey || '-20' WHEN 1 THEN CAST(1900000 + p_partkey AS STRING) WHEN 2 THEN 'M07' || p_partkey WHEN 3 THEN 'M0' || p_partkey || ' (envase mediato)' WHEN 4 THEN (8000 + p_partkey) || '*' WHEN 5 THEN (4000 + p_partkey) || '**' WHEN 6 THEN 'LOTE' WHEN 7 THEN 'MO' || p_partkey || '5' WHEN 8 THEN '03/20' || (10 + p_size % 20) WHEN 9 THEN p_type WHEN 10 THEN p_name END AS s FROM {part}"""


@query("lot_rules", f"""SELECT id, id % 12 IN (0, 1, 2, 3, 4, 5, 7) AS starts, id % 12 IN (0, 1, 2, 7) AS valid, CASE WHEN id % 12 IN (0, 1, 2, 3) THEN s WHEN id % 12 IN (4, 5) THEN replace(s, '*', '') WHEN id % 12 = 7 THEN 'M0' || id || '5' ELSE s END AS repaired FROM ({LOT_TEXTS})""")
def lot_rules(spark, sf):
    return derived(spark, sf, LOT_TEXTS).select("id", E.starts_lot(F.col("s")).alias("starts"), E.is_lot(F.col("s")).alias("valid"), E.repaired_lot(F.col("s")).alias("repaired"))


MAKERS = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Lab ' || p_type || ' S.A. / Ecuador' WHEN 1 THEN 'Laboratorio ' || p_type || ' S.A.C. Perú' WHEN 2 THEN p_name || ' Geneva / UK (Reino Unido)' WHEN 3 THEN 'Lab ' || p_name WHEN 5 THEN 'Francia ' || p_type || ' incautados...' END AS s FROM {part}"""


@query("maker_country", """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'Lab ' || p_type || ' S.A.' WHEN 1 THEN 'Laboratorio ' || p_type || ' S.A.C.' WHEN 2 THEN p_name || ' Geneva' WHEN 3 THEN 'Lab ' || p_name WHEN 5 THEN p_type || ' incautados...' END AS maker, CASE p_partkey % 6 WHEN 0 THEN 'Ecuador' WHEN 1 THEN 'Perú' WHEN 2 THEN 'UK (Reino Unido)' WHEN 5 THEN 'Francia' END AS country, CASE WHEN p_partkey % 6 = 5 THEN 'Francia' END AS prefix FROM part""")
def maker_country(spark, sf):
    v = spread(derived(spark, sf, MAKERS)).select("id", E.maker_and_country(F.col("s")).alias("m"), E.country_prefix(F.col("s")).alias("p"))
    m, p = F.col("m"), F.col("p")
    return v.select("id", m.maker.alias("maker"), m.country.alias("country"), p.country.alias("prefix"))


HOLDERS = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'DROGUERÍA ' || p_type || ' S.A.C. No conforme para el ensayo de' WHEN 1 THEN 'DROGUERÍA  ' || p_name || ' S.A.C.' WHEN 3 THEN p_brand || ' *' END AS h, CASE p_partkey % 4 WHEN 0 THEN 'Contenido de ' || p_name WHEN 1 THEN 'No conforme' WHEN 2 THEN ' * ' || p_type || ' * ' END AS r FROM {part}"""


@query("holder_repair", """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'DROGUERÍA ' || p_type || ' S.A.C.' WHEN 1 THEN 'DROGUERÍA ' || p_name || ' S.A.C.' WHEN 3 THEN p_brand END AS holder, CASE p_partkey % 4 WHEN 0 THEN 'No conforme para el ensayo de Contenido de ' || p_name WHEN 1 THEN 'No conforme' WHEN 2 THEN p_type END AS result FROM part""")
def holder_repair(spark, sf):
    x = E.holder_and_result(F.col("h"), F.col("r"))
    return derived(spark, sf, HOLDERS).select("id", x.holder.alias("holder"), x.result.alias("result"))


PRODUCTS = """SELECT p_partkey AS doc, CASE p_partkey % 5 WHEN 0 THEN 'Folio de aluminio ' || p_name WHEN 2 THEN '' ELSE p_name END AS product_name, CASE p_partkey % 7 WHEN 0 THEN 'FECHA DE' WHEN 1 THEN NULL ELSE 'A' || p_partkey END AS lot_number, CASE p_partkey % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.5 ELSE 0.8 END AS confidence FROM {part}"""


@query("product_quality", f"""SELECT doc, doc % 5 IN (0, 2) AS suspicious, CASE WHEN doc % 5 IN (0, 2) THEN least(confidence, 0.6) ELSE confidence END::DOUBLE AS confidence, product_name = '' OR doc % 7 < 2 OR confidence <= 0.65 AS low FROM ({PRODUCTS})""")
def product_quality(spark, sf):
    v = derived(spark, sf, PRODUCTS).withColumn("confidence", F.col("confidence").cast("double"))
    return v.select("doc", E.is_suspicious(F.col("product_name")).alias("suspicious"), E.capped_confidence(F.col("product_name"), F.col("confidence")).alias("confidence"), E.is_low_quality(F.col("product_name"), F.col("lot_number"), F.lit(""), F.lit(""), F.col("confidence")).alias("low"))


@query("layout_fallback", f"""WITH x AS (SELECT *, product_name = '' OR doc % 7 < 2 OR confidence <= 0.65 AS low FROM ({PRODUCTS}) WHERE doc % 4 <> 0), l AS (SELECT p_partkey AS doc FROM part WHERE p_partkey % 3 <> 0),
b AS (SELECT l.doc FROM l LEFT JOIN x USING (doc) WHERE l.doc % 5 <> 1 AND coalesce(x.low, true)) SELECT doc, 'text' AS origin FROM x WHERE doc NOT IN (SELECT doc FROM b) UNION ALL SELECT doc, 'layout' FROM b""")
def layout_fallback(spark, sf):
    add = lambda d, o: d.withColumns({"manufacturer": F.lit(""), "manufacturer_country": F.lit(""), "origin": F.lit(o), "confidence": F.col("confidence").cast("double")})
    texts = add(derived(spark, sf, PRODUCTS).filter("doc % 4 <> 0"), "text")
    lay = add(derived(spark, sf, "SELECT p_partkey AS doc, 'L' AS product_name, 'B1' AS lot_number, 0.9 AS confidence FROM {part} WHERE p_partkey % 3 <> 0"), "layout")
    types = derived(spark, sf, "SELECT p_partkey AS doc, CASE WHEN p_partkey % 5 = 1 THEN 'otro' ELSE 'producto_falsificado' END AS alert_type FROM {part}")
    return E.with_layout_fallback(texts, lay, types).select("doc", "origin")


NAMED_LOTS = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'Ibuprofeno ' || p_type || ' A1' || (1000 + p_partkey) || '* caja B777' WHEN 1 THEN 'Crema ' || p_name || ' B' || (7000 + p_partkey) || ' 100 ML' WHEN 2 THEN 'solo ' || p_name WHEN 3 THEN 'Jarabe ' || (1000000 + p_partkey) END AS name FROM {part}"""


@query("lot_in_name", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'A1' || (1000 + p_partkey) || '*' WHEN 1 THEN 'B' || (7000 + p_partkey) WHEN 3 THEN (1000000 + p_partkey)::VARCHAR END AS lot FROM part")
def lot_in_name(spark, sf):
    return derived(spark, sf, NAMED_LOTS).select("id", F.when(E.lot_in_name(F.regexp_replace("name", r"\*", "")).isNotNull() & F.contains("name", F.lit("*")), F.concat(E.lot_in_name(F.regexp_replace("name", r"\*", "")), F.lit("*"))).otherwise(E.lot_in_name(F.col("name"))).alias("lot"))


ACTIONS = """SELECT p_partkey AS doc, CASE p_partkey % 4 WHEN 0 THEN 'Se recomienda:;- No comprar ' || p_name || ';en la calle;2) Avisar a ' || p_brand || ';• no comprar ' || upper(p_name) || ' en la calle;Fuente: x;- fuera' WHEN 1 THEN '- nada;' || p_name WHEN 2 THEN p_name || ';Se recomienda:;- Revisar el lote ' || p_size || ';' || p_type ELSE p_type END AS body FROM {part}"""


@query("recommended_actions", """SELECT p_partkey AS doc, 1 AS b, 'No comprar ' || p_name || ' en la calle' AS action FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_partkey, 2, 'Avisar a ' || p_brand FROM part WHERE p_partkey % 4 = 0
UNION ALL SELECT p_partkey, 1, 'Revisar el lote ' || p_size || ' ' || p_type FROM part WHERE p_partkey % 4 = 2""")
def recommended_actions(spark, sf):
    rows = derived(spark, sf, ACTIONS).select("doc", F.posexplode(F.split("body", ";")).alias("line_no", "line"))
    return E.recommended_actions(rows).select("doc", F.col("b").cast("int").alias("b"), "action")


QUALITY_LINES = """SELECT p_partkey AS doc, CASE p_partkey % 4 WHEN 0 THEN 'Nombre del producto;Nº de lote;Resultados analíticos;' || p_name || ';' || p_size || ' mg;' || 'M0' || lpad(CAST(p_partkey AS STRING), 4, '0') || ';EE-1' || p_size || ';Laboratorio ' || p_type || ';PERU;DROGUERIA X' || p_size || ' S.A.C.;No conforme;Lima, 3' WHEN 1 THEN p_name WHEN 2 THEN 'Resultados analíticos;' || p_name || ' crema' END AS body FROM {part}"""


@query("quality_products", """SELECT p_partkey AS doc, CASE p_partkey % 4 WHEN 0 THEN p_name || ' ' || p_size || ' mg' WHEN 2 THEN p_name || ' crema' END AS product_name, CASE WHEN f THEN 'M0' || lpad(p_partkey::VARCHAR, 4, '0') END AS lot_number, CASE WHEN f THEN 'EE-1' || p_size END AS sanitary_registration, CASE WHEN f THEN 'Laboratorio ' || p_type END AS manufacturer, CASE WHEN f THEN 'PERU' END AS manufacturer_country,
  CASE WHEN f THEN 'DROGUERIA X' || p_size || ' S.A.C.' END AS registration_holder, CASE WHEN f THEN 'No conforme' END AS analytical_result, NULL::VARCHAR AS expiry_date, NULL::VARCHAR AS department, NULL::VARCHAR AS intervention_address, CASE p_partkey % 4 WHEN 0 THEN 0.86 WHEN 2 THEN 0.55 ELSE 0 END::DOUBLE AS confidence, CASE p_partkey % 4 WHEN 0 THEN 'ok' WHEN 2 THEN 'no_lot' ELSE 'no_header' END AS status
FROM (SELECT *, p_partkey % 4 = 0 AS f FROM part)""")
def quality_products(spark, sf):
    rows = derived(spark, sf, QUALITY_LINES).select("doc", F.split("body", ";").alias("rows"))
    return rows.lateralJoin(E.QualityProducts(F.col("rows").outer())).drop("rows")


LABEL_LINES = """SELECT p_partkey AS doc, CASE p_partkey % 3 WHEN 0 THEN 'Datos de productos farmacéuticos falsificados;Nombre;' || p_name || ';' || p_type || ';Lote;A' || p_partkey || ';Fabricante/País;Lab ' || p_type || ' / Perú;Nombre;' || p_brand || ';Lote;B1;Lima, 3;Nombre;no' WHEN 1 THEN 'Nombre;' || p_name END AS body FROM {part}"""


@query("falsified_products", """SELECT p_partkey AS doc, p_name || ' ' || p_type AS product_name, 'A' || p_partkey AS lot_number, NULL::VARCHAR AS sanitary_registration, 'Lab ' || p_type AS manufacturer, 'Perú' AS manufacturer_country, NULL::VARCHAR AS registration_holder, NULL::VARCHAR AS analytical_result, NULL::VARCHAR AS expiry_date, NULL::VARCHAR AS department, NULL::VARCHAR AS intervention_address, 0.84::DOUBLE AS confidence, 'ok' AS status FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, p_brand, 'B1', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0.84, 'ok' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, 'no_header' FROM part WHERE p_partkey % 3 <> 0""")
def falsified_products(spark, sf):
    rows = derived(spark, sf, LABEL_LINES).select("doc", F.split("body", ";").alias("rows"))
    return rows.lateralJoin(E.FalsifiedProducts(F.col("rows").outer())).drop("rows")


COMPARED_LINES = """SELECT p_partkey AS doc, CASE WHEN p_partkey % 2 = 0 THEN 'Frasco;' || p_name || ';Vidrio;Caja:;' || p_type || ';Etiqueta;' || p_brand || ';b' ELSE p_name || ';' || p_type END AS body FROM {part}"""


@query("compared_products", """SELECT p_partkey AS doc, 'FRASCO' AS name, p_name AS without_rs, 'Vidrio' AS with_rs FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'CAJA', p_type, NULL FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'ETIQUETA', p_brand, 'b' FROM part WHERE p_partkey % 2 = 0""")
def compared_products(spark, sf):
    rows = derived(spark, sf, COMPARED_LINES).select("doc", F.split("body", ";").alias("rows"))
    return rows.lateralJoin(E.ComparedCharacteristics(F.col("rows").outer())).drop("rows")


NARRATED = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'El producto ' || p_name || ', lote N° AB' || p_partkey || 'X, fabricado por Lab ' || p_type || ', de India' WHEN 1 THEN 'denominado "' || p_name || '" sin lote conocido; fabricante: ' || p_brand || '.' WHEN 2 THEN p_type || ' de Chile' END AS body FROM {part}"""


@query("narrative_products", """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 < 2 THEN p_name END AS product_name, CASE p_partkey % 4 WHEN 0 THEN 'AB' || p_partkey || 'X' WHEN 1 THEN 'conocido' END AS lot_number, CASE p_partkey % 4 WHEN 0 THEN 'Lab ' || p_type WHEN 1 THEN p_brand END AS manufacturer, CASE p_partkey % 4 WHEN 0 THEN 'India' WHEN 2 THEN 'Chile' END AS manufacturer_country,
  CASE WHEN p_partkey % 4 < 2 THEN 0.92 ELSE 0.76 END::DOUBLE AS confidence FROM part""")
def narrative_products(spark, sf):
    return spread(derived(spark, sf, NARRATED)).select("id", F.inline(F.array(E.narrative_product(F.col("body")))))


_ALERT = [
    "Comercialización ilegal del producto OPDIVO", "Nivolumab 100 mg / 10 mL solución inyectable en polvo", "R.S. BE-01234 en el Perú es la empresa ACME SA, el titular", "El producto original es manufacturado y acondicionado por Lab Uno,", "con ubicación en Manati, Puerto Rico - Estados Unidos de America", "No cuenta con registro sanitario en el país. Fin",
    "Frasco", "Plástico", "Vidrio", "Caja", "a", "b", "Etiqueta", "c", "d", "Concentraciones", "e", "f", "Almacenamiento", "g", "h", "Forma farmacéutica", "i", "j",
]


NARRATIVES = """SELECT p_partkey AS doc_id, CASE p_partkey %% 4 WHEN 0 THEN replace(replace(replace('%s', 'BE-01234', 'BE-0' || (1000 + p_partkey)), 'ACME SA', 'ACME ' || p_size || ' SA'), 'Lab Uno', 'Lab ' || p_type) WHEN 1 THEN 'Alerta de calidad;producto ABC ' || p_name WHEN 2 THEN 'Alerta por presunta falsificación del producto ' || p_name || '.;Fabricante: ' || p_type END AS body FROM {part}""" % ";".join(_ALERT)


@query("narrative_alerts", """SELECT p_partkey AS doc_id, CASE WHEN o THEN 'OPDIVO' ELSE p_name END AS product_name, CASE WHEN o THEN 'nivolumab' END AS active_ingredient, CASE WHEN o THEN '100 mg / 10 mL' END AS concentration, CASE WHEN o THEN 'BE-0' || (1000 + p_partkey) END AS sanitary_registration, CASE WHEN o THEN 'ACME ' || p_size || ' SA' END AS registration_holder, CASE WHEN o THEN 'Lab ' || p_type ELSE p_type END AS manufacturer,
  CASE WHEN o THEN 'Puerto Rico / Estados Unidos de América' END AS manufacturer_country, CASE WHEN o THEN 'solución inyectable / polvo' END AS dosage_form, CASE WHEN o THEN 'No cuenta con registro sanitario en el país' ELSE 'presunta falsificación del producto ' || p_name END AS risk_summary, 'comercialización ilegal / producto sin registro sanitario en Perú' || CASE WHEN o THEN '' ELSE ' / presunta falsificación' END AS alert_reason,
  o AS without_registration, CASE WHEN o THEN 6 ELSE 0 END AS rows_complete, CASE WHEN o THEN 0.92 ELSE 0.76 END::DOUBLE AS confidence, NOT o AS manual_review, CASE WHEN o THEN 'El comparativo muestra más de una forma farmacéutica reportada.' END AS dosage_observation FROM (SELECT *, p_partkey % 4 = 0 AS o FROM part) WHERE p_partkey % 4 IN (0, 2)""")
def narrative_alerts(spark, sf):
    found = E.narrative_alerts(derived(spark, sf, NARRATIVES).select("doc_id", F.split("body", ";").alias("lines")))
    return found.withColumn("rows_complete", F.col("rows_complete").cast("int")).drop("rows")


BOXES = "SELECT * FROM (VALUES (1, 1, 10, 10, 20, 10, 'Hola'), (1, 1, 40, 12, 20, 10, 'mundo'), (1, 1, 10, 40, 10, 10, '1.'), (1, 1, 30, 52, 50, 10, 'punto'), (1, 1, 10, 90, 50, 10, 'Indice'), (1, 1, 300, 90, 10, 10, '12')) AS t(doc, page, `left`, top, width, height, text)"


@query("rebuilt_pages", """SELECT * FROM (VALUES (1, 1, 'Hola mundo' || chr(10) || '1. punto' || chr(10) || 'Indice .......... 12')) AS t(doc, page, text)""")
def rebuilt_pages(spark, sf):
    return L.rebuilt_pages(spark.sql(BOXES))


@query("editable_tables", """SELECT * FROM (VALUES (1, 'Antes' || chr(10) || '----- VISTA PREVIA TABLA 1 -----' || chr(10) || '| a   | b   |' || chr(10) || '| --- | --- |' || chr(10) || '| 1   | x:y |' || chr(10) || '----- FIN VISTA PREVIA TABLA 1 -----' || chr(10) || '===== TABLA 1 =====' || chr(10) || '-- Fila 1 --' || chr(10) || 'a: 1' || chr(10) || 'b: x:y' || chr(10) || '===== FIN TABLA 1 =====' || chr(10) || 'Despues', true), (2, 'sin tabla', true)) AS t(id, editable, round_trip)""")
def editable_tables(spark, sf):
    t = "Antes\\n| a   | b   |\\n| --- | --- |\\n| 1   | x:y |\\nDespues"
    v = spark.sql(f"SELECT 1 AS id, '{t}' AS body UNION ALL SELECT 2, 'sin tabla'")
    e = v.withColumn("editable", L.editable_udf("body"))
    return e.select("id", "editable", (L.rebuilt_udf("editable") == F.col("body")).alias("round_trip"))


@query("manual_review", """SELECT * FROM (VALUES ('DS-1-2020', 1, 'nuevo texto', 1.0::DOUBLE, 'revision_manual', true, true), ('DS-1-2020', 2, 'otro', 0.9::DOUBLE, 'plain', true, false)) AS t(document_key, page_number, text, quality_score, extraction_method, revisado_manual, tabla_verificada)""")
def manual_review(spark, sf):
    pages = spark.sql("SELECT * FROM VALUES ('DS-1-2020', 1, 'viejo', 0.2D, 'ocr', false, false), ('DS-1-2020', 2, 'otro', 0.9D, 'plain', true, false) AS t(document_key, page_number, text, quality_score, extraction_method, revisado_manual, tabla_verificada)")
    files = spark.sql("SELECT '# NORMA: DS-1-2020\\n\\n### PAGINA 1 (baja)\\nnuevo texto\\n### PAGINA 9 (x)\\n\\n' AS content")
    return L.reviewed_pages(pages, files, F.expr("TIMESTAMP '2024-01-01'")).drop("revisado_en")


@query("replaced_text", """SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN 'nuevo ' || lang ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN 0.9 ELSE 0.25 END::DOUBLE AS quality_score, CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') END AS "before" FROM documents""")
def replaced_text(spark, sf):
    d = table(spark, sf, "documents")
    pages = d.select(F.col("doc_id").alias("page_id"), "text", F.lit(0.25).alias("quality_score"), F.create_map(F.lit("k"), F.coalesce("source", F.lit(""))).alias("metadata"))
    r = L.replaced_text(pages, d.filter("doc_id % 3 = 0").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("nuevo "), "lang").alias("text")), F.expr("TIMESTAMP '2024-01-01'"))
    return r.select("page_id", "text", "quality_score", F.col("metadata").getItem("texto_anterior").alias("before"))


OBJECTS = """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN o || '"a": ' || o || '"x": ' || p_size || ', "y": 2' || c || ', "b": "' || p_name || '"' || c WHEN 2 THEN 'broken' END AS base, CASE p_partkey % 3 WHEN 0 THEN o || '"a": ' || o || '"y": 3' || c || ', "c": [' || p_size || ']' || c WHEN 1 THEN o || '"z": ' || p_size || c END AS patch
  FROM (SELECT *, chr(123) AS o, chr(125) AS c FROM {part}) AS x"""


@query("deep_merge", """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN '{"a": {"x": ' || p_size || ', "y": 3}, "b": "' || p_name || '", "c": [' || p_size || ']}' WHEN 1 THEN '{"z": ' || p_size || '}' ELSE '{}' END AS merged FROM part""")
def deep_merge(spark, sf):
    return derived(spark, sf, OBJECTS).select("id", L.merge_json("base", "patch").alias("merged"))


# --- html -----------------------------------------------------------------------------------------------

_A = """regexp_extract_all(html, '(?is)(<a\\b[^>]*\\bhref\\s*=\\s*["''][^"'']*["''][^>]*>.*?</a>)', 1)"""
_LINKS = f"""l AS (SELECT page_id, url, unnest({_A}) AS a, generate_subscripts({_A}, 1) - 1 AS pos FROM pages), links AS (SELECT page_id, url, pos, trim(regexp_extract(a, '(?is)\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href, trim(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '[\\s\\x{{a0}}]+', ' ', 'g')) AS text FROM l)"""


@query("html_links", f"WITH {_LINKS} SELECT page_id, pos::INT AS pos, href, text FROM links")
def html_links(spark, sf):
    return H.anchors(table(spark, sf, "pages")).select("page_id", "pos", "href", "text")


@query("html_absolute", f"WITH {_LINKS} SELECT page_id, pos::INT AS pos, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href AS link FROM links WHERE href LIKE '/%'")
def html_absolute(spark, sf):
    a = H.anchors(table(spark, sf, "pages")).filter("href LIKE '/%'")
    return a.select("page_id", "pos", H.absolute(F.col("url"), F.col("href")).alias("link"))


_H1 = """replace(replace(regexp_replace(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), 'DIGEMID', ''), '|', '')"""


@query("html_title", f"""SELECT page_id, nullif(trim(trim(regexp_replace({_H1}, '[\\s\\x{{a0}}]+', ' ', 'g')), ' -'), '') AS title FROM pages""")
def html_title(spark, sf):
    return H.detail(table(spark, sf, "pages")).select("page_id", "title")


@query("html_longest_text", f"WITH {_LINKS} SELECT page_id, arg_min(text, row(-length(text), pos)) AS title FROM links WHERE text <> '' AND NOT contains(lower(href), '.pdf') GROUP BY page_id")
def html_longest_text(spark, sf):
    return H.longest_text(H.anchors(table(spark, sf, "pages")))


DETAIL_URLS = """SELECT page_id % 60 AS k, CASE page_id % 5 WHEN 0 THEN 'http://x.pe/normas-legales/' WHEN 1 THEN 'http://x.pe/normas-legales/2024/rm-' || page_id || '/' WHEN 2 THEN 'http://x.pe/normas-legales/2024/rm-' || page_id || '-larga/' WHEN 3 THEN 'http://x.pe/otro' || page_id ELSE 'http://x.pe/normas-legales/page/' || (2 + page_id % 30) END AS url, page_id % 5 AS form FROM {pages}"""


@query("canonical_url", f"SELECT k, arg_min(url, (form IN (0, 4), form NOT IN (1, 2), length(url), url)) AS canonical FROM ({DETAIL_URLS}) GROUP BY k")
def canonical_url(spark, sf):
    return H.canonical_url(derived(spark, sf, DETAIL_URLS), "k")


HTML = """<div><a href="/alertas-modificaciones/2026/alerta-digemid-no-41-2026/">Alerta DIGEMID 41-2026 del 05/03/2026</a></div><article><a href="http://x.pe/archivos/normatividad/a.pdf">PDF</a> <a href="b.pdf?x=1">Otro</a> <a href="/alertas-modificaciones/2025/comunicado/">Comunicado</a></article><h2 class="x">Leer más</h2><div class="entry-title big">Retiro | DIGEMID</div>"""


def _page(spark):
    return spark.createDataFrame([(1, "http://x.pe/alertas/lista", HTML)], "page_id int, url string, html string")


LISTED = """SELECT page_id, 'http://x.pe/alertas/lista' AS url, replace(replace(replace('%s', '41-2026', (1 + page_id %% 90) || '-2026'), '05/03/2026', lpad(CAST(1 + page_id %% 28 AS STRING), 2, '0') || '/03/2026'), 'comunicado', 'comunicado-' || page_id) AS html FROM {pages}""" % HTML



@query("html_alerts", """SELECT page_id, true AS strict, true AS near, (1 + page_id % 90) || '-2026' AS document_key, '2026-03-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0') AS published_date, 'http://x.pe/alertas-modificaciones/2026/alerta-digemid-no-' || (1 + page_id % 90) || '-2026/' AS detail_url FROM pages
UNION ALL SELECT page_id, false, true, 'comunicado-' || page_id, NULL, 'http://x.pe/alertas-modificaciones/2025/comunicado-' || page_id || '/' FROM pages""")
def html_alerts(spark, sf):
    return H.alerts(H.anchors(derived(spark, sf, LISTED))).select("page_id", "strict", "near", "document_key", "published_date", "detail_url")


@query("html_detail", """SELECT page_id, 'Retiro | DIGEMID' AS title, lpad((1 + page_id % 28)::VARCHAR, 2, '0') || '/03/2026' AS published_date_display, '2026-03-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0') AS published_date, 'http://x.pe/archivos/normatividad/a.pdf' AS file_url FROM pages""")
def html_detail(spark, sf):
    return H.detail(derived(spark, sf, LISTED))


@query("html_pdf", "SELECT page_id, 'http://x.pe/archivos/normatividad/a.pdf' AS pdf FROM pages")
def html_pdf(spark, sf):
    return H.chosen_pdf(H.anchors(derived(spark, sf, LISTED)))


@query("html_inventory")
def html_inventory(spark, sf):
    return table(spark, sf, "pages").select("page_id", "html").lateralJoin(H.Inventory(F.col("html").outer())).drop("html")


# --- files ----------------------------------------------------------------------------------------------

SEEDS = """SELECT p_partkey % 16 AS file, p_partkey, CASE WHEN p_partkey % 9 = 4 THEN ' ' WHEN p_partkey % 9 <> 5 THEN 'DS-' || p_partkey || '-2020' END AS document_key, CASE WHEN p_partkey % 7 <> 3 THEN p_name END AS titulo, 'DS' AS tipo, CAST(p_size AS STRING) AS numero FROM {part}"""


def _lists(rows, path, template="%s"):
    """JSON lists in a few files, as other programs leave them."""
    listed = rows.groupBy("file").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*[c for c in rows.columns if c != "file"])))).alias("x"))
    listed.select(F.format_string(template, "x").alias("value")).coalesce(1).write.text(path)


@query("seed_import", f"""SELECT document_key, titulo, tipo, numero, CASE WHEN trim(coalesce(document_key, '')) = '' THEN 'no key' WHEN titulo IS NULL THEN 'no title' END AS rejected FROM ({SEEDS})""")
def seed_import(spark, sf):
    """SRC7: seeds written as JSON lists and read with what is wrong with them."""
    path = _folder(spark, "seeds")
    for n in range(4):  # a file holds one list
        _lists(derived(spark, sf, SEEDS).filter(F.col("file") % 4 == n).withColumn("file", F.lit(0)), f"{path}/{n}")
    return R.checked_seeds(spark, f"{path}/*").select("document_key", "titulo", "tipo", "numero", "rejected")


@query("inventory_import", """SELECT 'DS-' || p_partkey || '-2020' AS document_key, p_name AS title, p_brand AS tipo, ['http://x.pe/' || p_partkey || '.pdf', p_type] AS pdf_urls FROM part WHERE p_partkey % 3 = 0""")
def inventory_import(spark, sf):
    """SRC6: an inventory written as one JSON object and read back."""
    path = _folder(spark, "inventory")
    rows = derived(spark, sf, "SELECT 0 AS file, 'DS-' || p_partkey || '-2020' AS document_key, p_name AS title, p_brand AS tipo, array('http://x.pe/' || p_partkey || '.pdf', p_type) AS pdf_urls FROM {part} WHERE p_partkey % 3 = 0")
    _lists(rows, path, '{"source": "x", "items": %s}')
    return R.read_inventory(spark, path).select("document_key", "title", "tipo", "pdf_urls")


@query("report_files", """SELECT 'markdown' AS file, '- ' || coalesce(p_brand, 'SIN_TIPO') || ': ' || count(*) AS line FROM (SELECT CASE WHEN p_size % 5 <> 0 THEN p_brand END AS p_brand FROM part) GROUP BY p_brand
UNION ALL SELECT 'json', 'DS-' || p_partkey || ' ' || p_name FROM part UNION ALL SELECT 'csv', 'DS-' || p_partkey || ' ' || p_name FROM part""")
def report_files(spark, sf):
    """SNK12: the three files of a report, read back."""
    path = _folder(spark, "report")
    p = table(spark, sf, "part").select(F.concat(F.lit("DS-"), F.col("p_partkey").cast("string")).alias("document_key"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("tipo"))
    R.write_report(p.withColumns({c: F.lit(None).cast("string") for c in R.FIELDS[3:]}), path)
    both = lambda d: F.concat_ws(" ", d["document_key"], d["title"])
    j, c, m = spark.read.schema("document_key string, title string").json(f"{path}/json"), spark.read.csv(f"{path}/csv", header=True), spark.read.text(f"{path}/markdown")
    out = m.select(F.lit("markdown").alias("file"), F.col("value").alias("line")).unionByName(j.select(F.lit("json").alias("file"), both(j).alias("line")))
    return out.unionByName(c.select(F.lit("csv").alias("file"), both(c).alias("line")))


@query("log_rows", "SELECT o_orderkey, (o_orderkey % 2)::INT AS batch FROM orders")
def log_rows(spark, sf):
    """SNK14: two batches of a log, the second run twice."""
    path, o = _folder(spark, "log"), table(spark, sf, "orders").select("o_orderkey")
    for batch in (0, 1, 1):
        R.append_log(o.filter(F.col("o_orderkey") % 2 == batch), path, batch)
    return spark.read.parquet(path).select("o_orderkey", "batch")


# --- streams --------------------------------------------------------------------------------------------


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("stream_dedup", "SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, sf):
    return I.run_to_table(I.first_seen(_stream(spark, sf), "user_id", delay="60 days"), _folder(spark, "seen")).select("user_id")


@query("stream_quota", "SELECT (ts - INTERVAL 5 HOUR)::DATE AS dia, user_id AS chat_id, count(*) AS consultas FROM events GROUP BY 1, 2")
def stream_quota(spark, sf):
    return I.run_to_table(I.daily_quota(_stream(spark, sf).withColumnRenamed("user_id", "chat_id"), delay="60 days"), _folder(spark, "quota"), "complete")


@query("stream_recent", "WITH d AS (SELECT unnest(range(TIMESTAMP '2023-12-20', TIMESTAMP '2024-02-10', INTERVAL 1 DAY)) AS s) SELECT s::TIMESTAMP AS start, (s + INTERVAL 7 DAY)::TIMESTAMP AS \"end\", count(*) AS n FROM d JOIN events ON ts >= s AND ts < s + INTERVAL 7 DAY GROUP BY 1, 2")
def stream_recent(spark, sf):
    return I.run_to_table(I.sliding_counts(_stream(spark, sf), delay="60 days"), _folder(spark, "recent"), "complete")


@contextlib.contextmanager
def _keyed_state(spark):
    """The state store that timers need, for the streams inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@query("stream_uploads", """WITH e AS (SELECT user_id AS chat_id, event_id AS id, ts, event_type IN ('click', 'view') AS asks FROM events),
l AS (SELECT *, lead(ts) OVER w AS t2, lead(id) OVER w AS i2, lead(asks) OVER w AS a2, (SELECT max(ts) FROM e) AS clock FROM e WINDOW w AS (PARTITION BY chat_id ORDER BY ts, id)),
k AS (SELECT *, CASE WHEN t2 < ts + INTERVAL 2 HOUR THEN CASE WHEN a2 THEN 'replaced' ELSE 'matched' END WHEN t2 IS NOT NULL OR ts + INTERVAL 2 HOUR <= clock THEN 'expired' END AS state FROM l WHERE asks)
SELECT chat_id, id, CASE WHEN state = 'matched' THEN i2 END AS answer_id, state FROM k WHERE state IS NOT NULL""")
def stream_uploads(spark, sf):
    """FLT18 by timers: a question waits two hours for its answer."""
    e = _stream(spark, sf).select(F.col("user_id").cast("long").alias("chat_id"), F.col("event_id").cast("long").alias("id"), F.col("event_type").isin("click", "view").alias("asks"), "ts")
    with _keyed_state(spark):
        return I.run_to_table(M.uploads(e, "0 seconds", minutes=120), _folder(spark, "uploads"))


@query("stream_silence", """WITH l AS (SELECT user_id || ':' || event_type AS source, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) AS t2, (SELECT max(ts) FROM events) AS clock FROM events)
SELECT source, ts AS since FROM l WHERE coalesce(t2, clock) >= ts + INTERVAL 5 DAY""")
def stream_silence(spark, sf):
    """AGG19 by timers: since when a source is silent."""
    e = _stream(spark, sf).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("source"), "ts")
    with _keyed_state(spark):
        return I.run_to_table(M.silences(e, "0 seconds"), _folder(spark, "silence"))


@query("stream_upsert", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def stream_upsert(spark, sf):
    """SNK2, SNK6: the last event of each user, merged into buckets batch by batch; the second half comes twice."""
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    last = lambda old, new: G.last_wins(old.unionByName(new), ["user_id"], ["ts", "event_id"])
    t = T.BucketTable(spark, _folder(spark, "upsert"), e.schema, ["user_id"], last, 16)
    for number in (0, 1, 1):
        t.merge(e.filter(F.col("event_id") % 2 == number), number)
    return t.read()


@query("stream_outbox", "SELECT event_id, event_id % 2 AS batch FROM events WHERE event_type = 'purchase' AND event_id % 3 = 0 AND event_id % 2 = 1")
def stream_outbox(spark, sf):
    """STM9: two batches of messages, of which some are refused at first; the first batch is sent again, the second waits."""
    e = table(spark, sf, "events").filter("event_type = 'purchase'").select("event_id")
    box = T.Outbox(spark, _folder(spark, "outbox"), e.schema, "event_id")
    box.queue(e.filter("event_id % 2 = 0"), 0)
    box.send(lambda rows: rows.filter("event_id % 3 <> 0"))
    box.send(lambda rows: rows)
    box.queue(e.filter("event_id % 2 = 1"), 1)
    box.send(lambda rows: rows.filter("event_id % 3 <> 0"))
    return box.pending().select("event_id", "batch")


@query("real_tables", "SELECT conv_id, count(*) >= 2 AND len(list_filter(list(trim(text)), lambda c: c <> '')) >= 3 AND sum(length(trim(text))) + 4 * count(*) >= 20 AS real FROM conversations GROUP BY conv_id")
def real_tables(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.array("text", F.lit("cell"))).alias("g"))
    return c.select("conv_id", (Q.is_real_table(F.col("g")) & (F.size(F.filter(F.flatten(F.transform("g", lambda r: F.slice(r, 1, 1))), lambda x: F.trim(x) != "")) >= 3)).alias("real"))

"""Queries of the text, key, date, URL and quality functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions import keys as K
from tidewell.functions import quality as Q
from tidewell.functions import text as X
from tidewell.operators import search as S
from tidewell.plans.base import PAGES_SQL, SIGNS, STRIPPED, derived, norm_pages, quality_sql, query, spread, table, values

FOLD = f"translate({{}}, '{X.ACCENTED}', '{X.PLAIN}')"
CLEAN = "trim(regexp_replace(coalesce({}, ''), '[\\s\\x{{a0}}]+', ' ', 'g'))"
TITLES = """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'ALERTA DIGEMID N ' || k WHEN 1 THEN 'Alerta Sanitaria N° ' || k || ': Retiro del producto ' || p_name WHEN 2 THEN '' WHEN 3 THEN 'Alerta DIGEMID Nº ' || k WHEN 4 THEN 'Decreto  Supremo   que modifica ' || p_type WHEN 6 THEN 'ALERTA de ' || p_size || ' 2023' WHEN 7 THEN p_name END AS title, CASE WHEN p_partkey % 48 <> 4 THEN k END AS doc_key
  FROM (SELECT *, p_size || '-' || (2000 + p_partkey % 26) AS k FROM {part}) AS x"""


@query("text_normalise", f"SELECT doc_id, {CLEAN.format('text')} AS cleaned, upper(replace({FOLD.format(CLEAN.format('text'))}, 'ß', 'SS')) AS folded FROM documents")
def text_normalise(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.clean(F.col("text")).alias("cleaned"), F.upper(F.translate(X.clean(F.col("text")), X.ACCENTED, X.PLAIN)).alias("folded"))


@query("fold_match", f"SELECT conv_id, turn, trim(regexp_replace(upper(replace({FOLD.format('text')}, 'ß', 'SS')), '[\\s\\x{{a0}}]+', ' ', 'g')) AS folded FROM conversations")
def fold_match(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.fold(F.col("text")).alias("folded"))


@query("generic_title", f"""
SELECT id, len(list_filter(string_split_regex(regexp_replace(regexp_replace(lower({FOLD.format("coalesce(title, '')")}), '[^\\x00-\\x7F]', '', 'g'), '[^a-z0-9_]+', ' ', 'g'), ' '),
  lambda w: w <> '' AND w NOT IN ('alerta', 'digemid', 'n', 'no', 'sanitaria', 'de') AND NOT list_contains(string_split_regex(lower(coalesce(doc_key, '')), '[-\\s]+'), w))) = 0 AS generic
FROM ({TITLES})""")
def generic_title(spark, sf):
    return derived(spark, sf, TITLES).select("id", X.is_generic_title(F.col("title"), F.col("doc_key")).alias("generic"))


@query("title_keys", f"""
SELECT id, trim(regexp_replace(regexp_replace(replace(replace(lower({CLEAN.format('title')}), 'n°', 'n'), 'nº', 'n'), '[^a-z0-9áéíóúüñ ]+', ' ', 'g'), '\\s+', ' ', 'g')) AS title_key,
  translate(upper(trim(regexp_replace(coalesce(title, ''), '[ \\t]+', ' ', 'g'))), 'ÁÉÍÓÚÑ°', 'AEIOUNº') AS header FROM ({TITLES})""")
def title_keys(spark, sf):
    return derived(spark, sf, TITLES).select("id", X.title_key(F.col("title")).alias("title_key"), X.header(F.col("title")).alias("header"))


@query("html_escape", "SELECT page_id, replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages")
def html_escape(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.html_escape(F.col("html")).alias("escaped"))


@query("hash_columns", "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, upper(substr(sha1(coalesce(text, '')), 1, 8)) AS short FROM documents")
def hash_columns(spark, sf):
    t = X.blank(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.sha2(t, 256).alias("sha256"), X.short_hash(t).alias("short"))


@query("percentages", "SELECT source, CASE WHEN count(*) = 0 THEN '0%' ELSE printf('%.1f', round(count(*) FILTER (lang = 'en') * 100.0::DOUBLE / count(*), 1)) || '%' END AS english FROM documents GROUP BY source")
def percentages(spark, sf):
    g = table(spark, sf, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("a"), F.count(F.lit(1)).alias("b"))
    return g.select("source", X.percentage(F.col("a"), F.col("b")).alias("english"))


PAGE_TEXTS = """SELECT doc_id AS id, CASE doc_id % 5 WHEN 1 THEN replace(text, '. ', ' .' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || chr(9)) WHEN 2 THEN '  ' || replace(text, ' ', '  ') || ' ! ' WHEN 3 THEN replace(text, ', ', chr(9) || ',' || chr(10)) WHEN 4 THEN text END AS body FROM {documents}"""
_PT = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce(body, ''), chr(160), ' '), '\\r\\n?', chr(10), 'g'), '(?m)^[ \\t]+|[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@query("page_texts", f"SELECT id, {_PT} AS normal, regexp_replace(regexp_replace(regexp_replace({_PT}, '[ \\t]+', ' ', 'g'), '[ \\t]+([,.;:!?])', '\\1', 'g'), '^\\s+|\\s+$', '', 'g') AS cautious FROM ({PAGE_TEXTS})")
def page_texts(spark, sf):
    return derived(spark, sf, PAGE_TEXTS).select("id", X.page_text(F.col("body")).alias("normal"), X.cautious_page_text(F.col("body")).alias("cautious"))


FILES = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'DS-14-' || (1990 + o_orderkey % 30) ELSE (o_orderkey % 90) || '-' || (2000 + o_orderkey % 26) END AS k, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderdate AS DATE) END AS day,
  CASE o_orderkey % 4 WHEN 0 THEN 'Clerk ' || o_custkey || ':b/c*d.pdf' WHEN 1 THEN '  x  ' || o_orderstatus || ' ?.pdf ' WHEN 2 THEN 'Clerk ' || o_custkey || '.pdf' END AS name FROM {orders}"""
_FN = "trim(regexp_replace(regexp_replace(coalesce(name, ''), '[\\\\/:*?\"<>|]+', '_', 'g'), '\\s+', ' ', 'g'))"


@query("file_names", f"SELECT id, {_FN} AS clean_name, k || '__' || coalesce(strftime(day, '%Y-%m-%d'), 'sin-fecha') || '__' || {_FN} AS copy_name, coalesce(year(day), regexp_extract(k, '(\\d{{4}})', 1)::INT)::INT AS year FROM ({FILES})")
def file_names(spark, sf):
    v = derived(spark, sf, FILES)
    return v.select("id", X.file_name(F.col("name")).alias("clean_name"), X.copy_name(F.col("k"), F.col("day"), F.col("name")).alias("copy_name"), K.inferred_year(F.col("day"), F.col("k")).alias("year"))


DATES = """SELECT o_orderkey AS id, CASE o_orderkey % 11 WHEN 0 THEN 'publicado el ' || d || '/' || m || '/' || y || ' hoy' WHEN 1 THEN '31/02/' || y WHEN 2 THEN d || ' de ' || mes || ' de ' || y WHEN 3 THEN '31 de febrero de ' || y WHEN 4 THEN 'pedido ' || 'Clerk ' || o_custkey WHEN 5 THEN NULL WHEN 6 THEN d || '-' || m || '-' || (y - 2000)
  WHEN 7 THEN d || '/' || m || '/' || y || ' y 1/1/2020' WHEN 8 THEN d || ' de ' || mes || ' del ' || y WHEN 9 THEN lpad(CAST(d AS STRING), 2, '0') || '/' || lpad(CAST(m AS STRING), 2, '0') || '/' || y ELSE 'Lima, ' || d || ' de ' || mes || ' de ' || y || '.' END AS body
  FROM (SELECT *, day(o_orderdate) AS d, month(o_orderdate) AS m, year(o_orderdate) + 20 AS y, trim(substr('enero     febrero   marzo     abril     mayo      junio     julio     agosto    setiembre octubre   noviembrediciembre ', month(o_orderdate) * 10 - 9, 10)) AS mes FROM {orders}) AS x"""
_MON = "map {'enero': 1, 'febrero': 2, 'marzo': 3, 'abril': 4, 'mayo': 5, 'junio': 6, 'julio': 7, 'agosto': 8, 'setiembre': 9, 'septiembre': 9, 'octubre': 10, 'noviembre': 11, 'diciembre': 12}"


@query("date_parse", f"""
WITH a AS (SELECT id, coalesce(body, '') AS b FROM ({DATES})), p AS (
  SELECT id, b, regexp_extract(b, '\\b(\\d{{1,2}})/(\\d{{1,2}})/(20\\d{{2}})\\b', ['d', 'm', 'y']) AS s, regexp_extract(b, '\\b(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{2,4}})\\b', ['d', 'm', 'y']) AS l,
    regexp_extract(b, '(?i)\\b(\\d{{1,2}})\\s+de\\s+([a-záéíóú]+)\\s+(?:de|del)\\s+(\\d{{4}})\\b', ['d', 'm', 'y']) AS t, regexp_extract(b, '\\b\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{2,4}}\\b') AS lt,
    regexp_extract(b, '(?i)\\b\\d{{1,2}}\\s+de\\s+[a-záéíóú]+\\s+(?:de|del)\\s+\\d{{4}}\\b') AS tt FROM a)
SELECT id, CASE WHEN s.y <> '' THEN s.y || '-' || lpad(s.m, 2, '0') || '-' || lpad(s.d, 2, '0') END AS loose,
  strftime(CASE WHEN lt <> '' THEN try_cast(printf('%04d-%02d-%02d', CASE WHEN try_cast(l.y AS INT) < 100 THEN try_cast(l.y AS INT) + 2000 ELSE try_cast(l.y AS INT) END, try_cast(l.m AS INT), try_cast(l.d AS INT)) AS DATE)
    WHEN tt <> '' THEN try_cast(printf('%04d-%02d-%02d', try_cast(t.y AS INT), {_MON}[lower(t.m)], try_cast(t.d AS INT)) AS DATE) END, '%Y-%m-%d') AS checked,
  nullif(CASE WHEN lt <> '' THEN lt ELSE tt END, '') AS shown FROM p""")
def date_parse(spark, sf):
    v = derived(spark, sf, DATES)
    info = K.date_info(F.col("body"))
    return v.select("id", K.iso_date(F.col("body")).alias("loose"), info.iso.alias("checked"), info.shown.alias("shown"))


CARDS = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN d || ' ' || substr(mes, 1, 3) WHEN 1 THEN d || ' ' || substr(mes, 1, 3) || '. noticia' WHEN 2 THEN (d + 20) || ' ' || upper(substr(mes, 1, 3)) WHEN 3 THEN mes ELSE lpad(CAST(d AS STRING), 2, '0') || ' ' || mes END AS body, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 90) || '-' || y END AS k
  FROM (SELECT *, day(o_orderdate) AS d, year(o_orderdate) + 20 AS y, trim(substr('enero     febrero   marzo     abril     mayo      junio     julio     agosto    setiembre octubre   noviembrediciembre ', month(o_orderdate) * 10 - 9, 10)) AS mes FROM {orders}) AS x"""


@query("card_dates", f"""
WITH p AS (SELECT id, regexp_extract(lower(body), '\\b(\\d{{1,2}})\\s+(ene|feb|mar|abr|may|jun|jul|ago|set|sep|oct|nov|dic)', ['d', 'm']) AS x, regexp_extract(coalesce(k, ''), '(20\\d{{2}})\\b', 1) AS y FROM ({CARDS}))
SELECT id, CASE WHEN x.d <> '' AND try_cast(x.d AS INT) BETWEEN 1 AND 31 AND y <> '' THEN y || '-' || lpad(map {{'ene': 1, 'feb': 2, 'mar': 3, 'abr': 4, 'may': 5, 'jun': 6, 'jul': 7, 'ago': 8, 'set': 9, 'sep': 9, 'oct': 10, 'nov': 11, 'dic': 12}}[x.m]::VARCHAR, 2, '0') || '-' || lpad(x.d, 2, '0') END AS day FROM p""")
def card_dates(spark, sf):
    return derived(spark, sf, CARDS).select("id", K.day_month(F.col("body"), F.col("k")).alias("day"))


ALERTS = """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'alerta-digemid-no-' || n || '-' || y WHEN 1 THEN 'Alerta DIGEMID N° ' || n || '-' || y WHEN 2 THEN n || '-' || y WHEN 3 THEN 'Retiro del producto ' || p_name WHEN 4 THEN 'Título único: Ñandú ' || p_brand WHEN 6 THEN 'ALERTA DIGEMID Nº ' || lpad(CAST(n AS STRING), 3, '0') || '/' || y WHEN 7 THEN p_type END AS title,
  CASE p_partkey % 4 WHEN 2 THEN 'http://x.pe/a/' || lpad(CAST(n AS STRING), 3, '0') || '-' || y || '/' WHEN 3 THEN 'http://x.pe/alertas/retiro-' || lower(replace(p_name, ' ', '-')) || '/' END AS url FROM (SELECT *, 1 + p_partkey % 120 AS n, 2005 + p_partkey % 22 AS y FROM {part}) AS x"""
_BOTH = "lower(coalesce(title, '') || ' ' || coalesce(url, ''))"
_NAMED = f"regexp_extract({_BOTH}, 'alerta[-_\\s]*digemid[-_\\s]*(?:n[o°º.]*)?[-_\\s]*(\\d{{1,4}})[-_/](20\\d{{2}})', ['n', 'y'])"
_PLAIN = f"regexp_extract({_BOTH}, '\\b(\\d{{1,4}})[-/](20\\d{{2}})\\b', ['n', 'y'])"


@query("alert_key", f"""
WITH a AS (SELECT *, {_NAMED} AS n1, {_PLAIN} AS n2, regexp_extract(regexp_replace(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '/+$', ''), '://[^/]*/(?:.*/)?([^/]*)$', 1) AS slug,
  regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({FOLD.format(CLEAN.format("coalesce(nullif(title, ''), 'documento-digemid')"))}, '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g') AS t FROM ({ALERTS})),
b AS (SELECT *, CASE WHEN n1.n <> '' THEN try_cast(n1.n AS INT) || '-' || n1.y WHEN n2.n <> '' THEN try_cast(n2.n AS INT) || '-' || n2.y END AS number FROM a)
SELECT id, number, coalesce(number, nullif(substr(slug, 1, 120), ''), nullif(substr(t, 1, 120), ''), 'documento-digemid') AS document_key FROM b""")
def alert_key(spark, sf):
    v = derived(spark, sf, ALERTS)
    return v.select("id", K.alert_number(F.col("title"), F.col("url")).alias("number"), K.document_key(F.col("title"), F.col("url")).alias("document_key"))


NORMS = """SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'Resolución Ministerial N° ' || z || '-' || y || '/MINSA' WHEN 1 THEN 'DS N° ' || z || '-' || y || '-SA que aprueba ' || p_type WHEN 2 THEN 'Ley N° ' || (20000 + p_partkey) WHEN 3 THEN 'Norma técnica ' || y WHEN 4 THEN 'D.L. ' || (1000 + p_partkey % 500) WHEN 5 THEN 'RD ' || n || '-' || y || '-DIGEMID' WHEN 6 THEN 'R.S. N° ' || z || '-' || y WHEN 7 THEN p_name ELSE 'DECRETO SUPREMO N° ' || z || '-' || y || '-SA' END AS title,
  CASE WHEN p_partkey % 10 <> 3 THEN 'http://x.pe/' || lower(replace(p_brand, '#', '-')) || '/' || p_partkey END AS url FROM (SELECT *, 1 + p_partkey % 300 AS n, lpad(CAST(1 + p_partkey % 300 AS STRING), 3, '0') AS z, 2000 + p_partkey % 26 AS y FROM {part}) AS x"""


def _norm_case(kinds: list[tuple[str, str, bool]], text: str, what: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN {what.format(kind=k, p=p, year='true' if y else 'false')}" for k, p, y in kinds) + " END"


_SIGN = "(?:N[°Oº.]*)?"
_KINDS = [("RM", f"(?:R\\.?\\s*M\\.?|RESOLUCI[ÓO]N\\s+MINISTERIAL)\\s*{_SIGN}\\s*(\\d{{1,4}})[-/](20\\d{{2}})", True), ("DS", f"(?:D\\.?\\s*S\\.?|DECRETO\\s+SUPREMO)\\s*{_SIGN}\\s*(\\d{{1,4}})[-/](20\\d{{2}})", True), ("RD", f"(?:R\\.?\\s*D\\.?|RESOLUCI[ÓO]N\\s+DIRECTORAL)\\s*{_SIGN}\\s*(\\d{{1,4}})[-/](20\\d{{2}})", True), ("RS", f"(?:R\\.?\\s*S\\.?|RESOLUCI[ÓO]N\\s+SUPREMA)\\s*{_SIGN}\\s*(\\d{{1,4}})[-/](20\\d{{2}})", True), ("LEY", f"\\bLEY\\s*{_SIGN}\\s*(\\d{{1,6}})(?:[-/](20\\d{{2}}))?", True), ("DL", f"(?:D\\.?\\s*L\\.?|DECRETO\\s+LEGISLATIVO)\\s*{_SIGN}\\s*(\\d{{1,4}})(?:[-/](20\\d{{2}}))?", True), ("DU", f"(?:D\\.?\\s*U\\.?|DECRETO\\s+DE\\s+URGENCIA)\\s*{_SIGN}\\s*(\\d{{1,4}})(?:[-/](20\\d{{2}}))?", True)]


@query("norm_identity", f"""
WITH a AS (SELECT id, title, url, upper({CLEAN.format('title')}) AS u FROM ({NORMS})), b AS (SELECT *, {_norm_case(_KINDS, 'u', "'{kind}'")} AS tipo, {_norm_case(_KINDS, 'u', "regexp_extract(u, '{p}', 1)")} AS n, {_norm_case(_KINDS, 'u', "nullif(regexp_extract(u, '{p}', 2), '')")} AS anio FROM a)
SELECT id, tipo, n::INT::VARCHAR AS numero, anio, CASE WHEN tipo IS NOT NULL THEN tipo || '-' || n::INT || coalesce('-' || anio, '') ELSE 'NORM-' || upper(substr(sha1(coalesce(title, '') || '|' || coalesce(url, '')), 1, 10)) END AS inventory_key FROM b""")
def norm_identity(spark, sf):
    v = derived(spark, sf, NORMS).withColumn("w", K.norm_identity(F.col("title")))
    return v.select("id", "w.tipo", "w.numero", "w.anio", K.inventory_key(F.col("w.tipo"), F.col("w.numero"), F.col("w.anio"), F.col("title"), F.col("url")).alias("inventory_key"))


_SUF = "([/\\-][A-Z0-9\\-]+)?"
_KINDS2 = [(k, ("\\b" + p if not p.startswith("\\b") else p).replace("[ÓO]", "O").replace("(?:[-/](20\\d{2}))?", "") + _SUF, k in ("RM", "DS", "RD", "RS")) for k, p, _ in [x for x in _KINDS if x[0] != "LEY"] + [x for x in _KINDS if x[0] == "LEY"]]
_S2 = "CASE WHEN {year} THEN '-' || regexp_extract(u, '{p}', 2) || coalesce('-' || nullif(upper(trim(replace(replace(regexp_extract(u, '{p}', 3), '/', '-'), '--', '-'), '-')), ''), '') WHEN '{kind}' <> 'LEY' THEN coalesce('-' || nullif(upper(trim(replace(replace(regexp_extract(u, '{p}', 2), '/', '-'), '--', '-'), '-')), ''), '') ELSE '' END"


@query("norm_key", f"""
WITH a AS (SELECT id, upper(trim(regexp_replace(coalesce(title, '') || ' ' || coalesce(url, ''), '\\s+', ' ', 'g'))) AS u FROM ({NORMS}))
SELECT id, coalesce({_norm_case([k for k in _KINDS2 if k[2]] + [k for k in _KINDS2 if not k[2]], 'u', "'{kind}-' || regexp_extract(u, '{p}', 1)::INT").replace(' END', ' END')}
  || {_norm_case([(k, p, y) for k, p, y in _KINDS2 if y], 'u', "'-' || regexp_extract(u, '{p}', 2) || coalesce('-' || nullif(upper(trim(replace(replace(regexp_extract(u, '{p}', 3), '/', '-'), '--', '-'), '-')), ''), '')")[:-4]}
  {' '.join(f"WHEN regexp_matches(u, '{p}') THEN " + ("''" if k == 'LEY' else f"coalesce('-' || nullif(upper(trim(replace(replace(regexp_extract(u, '{p}', 2), '/', '-'), '--', '-'), '-')), ''), '')") for k, p, y in _KINDS2 if not y)} END,
  'NORM-NORMAS-' || coalesce(nullif(regexp_extract(u, '\\b(20\\d{{2}})\\b', 1), ''), '0000') || '-' || upper(substr(sha1(u), 1, 8))) AS norm_key FROM a""")
def norm_key(spark, sf):
    return derived(spark, sf, NORMS).select("id", K.norm_key(F.col("title"), F.col("url"), F.lit("normas"), F.lit(None).cast("string")).alias("norm_key"))


KEYS = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'RM' WHEN 2 THEN 'Decreto Supremo' WHEN 3 THEN 'LEY' WHEN 5 THEN 'Resolución  Directoral' END AS tipo, CASE p_partkey % 6 WHEN 0 THEN z WHEN 2 THEN z || '-' || y || '-SA' WHEN 3 THEN '2' || z || '9' END AS numero, CASE p_partkey % 6 WHEN 0 THEN CAST(y AS STRING) WHEN 2 THEN 'año ' || y END AS anio,
  CASE p_partkey % 6 WHEN 0 THEN 'RM-' || n || '-' || y || '-MINSA' WHEN 1 THEN 'DS-' || z || '-' || y || '-SA' WHEN 2 THEN 'x' WHEN 5 THEN 'RD-0' || z || '-' || y END AS k FROM (SELECT *, 1 + p_partkey % 300 AS n, lpad(CAST(1 + p_partkey % 300 AS STRING), 3, '0') AS z, 1990 + p_partkey % 36 AS y FROM {part}) AS x"""
_RAWT = f"trim(regexp_replace(regexp_replace(upper({FOLD.format('{}')}), '[^A-Z0-9 ]+', ' ', 'g'), '\\s+', ' ', 'g'))"


def _type_sql(x: str) -> str:
    r = _RAWT.format(f"coalesce({x}, '')")
    return f"CASE WHEN {r} = '' THEN NULL WHEN {r} IN ('RM', 'RD', 'DS', 'DU', 'DL', 'LEY', 'RS') THEN {r} WHEN {r} LIKE '%RESOLUCION MINISTERIAL%' THEN 'RM' WHEN {r} LIKE '%RESOLUCION DIRECTORAL%' THEN 'RD' WHEN {r} LIKE '%RESOLUCION SUPREMA%' THEN 'RS' WHEN {r} LIKE '%DECRETO SUPREMO%' THEN 'DS' WHEN {r} LIKE '%DECRETO DE URGENCIA%' OR {r} LIKE '%DECRETO URGENCIA%' THEN 'DU' WHEN {r} LIKE '%DECRETO LEGISLATIVO%' OR {r} LIKE '%DECRETO LEY%' THEN 'DL' WHEN {r} LIKE '%LEY%' THEN 'LEY' ELSE {r} END"


@query("identity_parse", f"""
WITH a AS (SELECT *, list_filter(string_split(upper(coalesce(k, '')), '-'), lambda t: t <> '') AS toks FROM ({KEYS})),
b AS (SELECT *, list_filter(list_transform(toks[2:], lambda t: regexp_replace(t, '\\D+', '', 'g')), lambda t: t <> '') AS rest FROM a),
c AS (SELECT *, list_filter(rest, lambda t: regexp_full_match(t, '(19|20)\\d{{2}}'))[1] AS ky FROM b),
d AS (SELECT *, list_filter(rest, lambda t: t IS DISTINCT FROM ky)[1] AS kn FROM c),
e AS (SELECT id, coalesce({_type_sql('tipo')}, {_type_sql('toks[1]')}) AS tipo, coalesce(nullif(regexp_extract(coalesce(numero, ''), '(\\d+)', 1), '')::BIGINT::VARCHAR, kn::BIGINT::VARCHAR) AS numero, coalesce(nullif(regexp_extract(coalesce(anio, ''), '((?:19|20)\\d{{2}})', 1), ''), ky) AS anio FROM d)
SELECT id, tipo, numero, anio, CASE WHEN tipo IS NOT NULL AND numero IS NOT NULL THEN tipo || '-' || numero || coalesce('-' || anio, '') END AS normalized_key FROM e""")
def identity_parse(spark, sf):
    v = derived(spark, sf, KEYS).withColumn("w", K.identity(F.col("tipo"), F.col("numero"), F.col("anio"), F.col("k")))
    return v.select("id", "w.tipo", "w.numero", "w.anio", F.col("w.key").alias("normalized_key"))


PATHS = """SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'Alertas/ALERTA DIGEMID N ' || n || '-' || (10 + p_partkey % 17) || '.pdf' WHEN 1 THEN 'normas/DS ' || z || '-' || y || '-SA texto.pdf' WHEN 2 THEN 'RM_' || z || '-' || y || '/MINSA.pdf' WHEN 3 THEN 'varios/Ley ' || (20000 + p_partkey) || '.pdf' WHEN 4 THEN 'otros/' || p_name || '.png' WHEN 6 THEN 'x/ALERTA_' || z || '_' || y || '.pdf' WHEN 7 THEN p_type END AS path
  FROM (SELECT *, 1 + p_partkey % 120 AS n, lpad(CAST(1 + p_partkey % 120 AS STRING), 3, '0') AS z, 2000 + p_partkey % 26 AS y FROM {part}) AS x"""
_UP = "regexp_replace(upper(coalesce(path, '')), '\\s+', '', 'g')"
_AL = f"regexp_extract({_UP}, 'ALERTA(?:DIGEMID)?N?\\D*?(\\d{{1,3}})[-_ ]?(\\d{{2,4}})', ['n', 'y'])"
_NP = f"trim(regexp_replace(upper({FOLD.format("coalesce(path, '')")}), '[^A-Z0-9]+', '-', 'g'), '-')"


def _path_case() -> str:
    out = []
    for kind, issuers in K.PATH_NORMS.items():
        p = f"\\b({kind})-?(\\d{{1,4}})-?(\\d{{4}})-?({issuers})\\b" if issuers else f"\\b({kind})-?(\\d{{{'4,6' if kind == 'LEY' else '1,4'}}})\\b"
        parts = " || '-' || ".join(f"regexp_extract(p, '{p}', {g})" for g in range(1, 5 if issuers else 3))
        out.append(f"WHEN regexp_matches(p, '{p}') THEN {parts}")
    return "CASE " + " ".join(out) + " END"


@query("path_keys", f"""WITH a AS (SELECT id, {_AL} AS x, {_NP} AS p FROM ({PATHS}))
SELECT id, CASE WHEN x.n <> '' THEN try_cast(x.n AS INT) || '-' || CASE WHEN length(x.y) = 2 THEN '20' || x.y ELSE x.y END END AS alert_key, {_path_case()} AS norm_key FROM a""")
def path_keys(spark, sf):
    return derived(spark, sf, PATHS).select("id", K.file_alert_key(F.col("path")).alias("alert_key"), K.file_norm_key(F.col("path")).alias("norm_key"))


PDFS = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'http://x.pe/a/RM_' || z || '-' || y || '-MINSA.pdf' WHEN 1 THEN 'http://x.pe/DS' || z || '-' || y || '-SA.pdf?x=' || p_size WHEN 2 THEN 'http://x.pe/LEY-' || (20000 + p_partkey) || '.pdf' WHEN 3 THEN 'http://x.pe/' || lower(replace(p_name, ' ', '-')) || '.pdf' WHEN 4 THEN 'http://x.pe/RD-' || n || '-' || y || '-DIGEMID.pdf#p2' END AS url
  FROM (SELECT *, 1 + p_partkey % 120 AS n, lpad(CAST(1 + p_partkey % 120 AS STRING), 3, '0') AS z, 2000 + p_partkey % 26 AS y FROM {part}) AS x"""
_PN = "upper(regexp_replace(regexp_extract(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '([^/]*)$', 1), '\\.[^.]*$', ''))"


def _pdf_case() -> str:
    out = []
    for kind in K.KEY_ORDER:
        dated = kind in ("RM", "DS", "RD", "RS")
        p = f"\\b{kind}[_\\-]?(\\d{{1,{6 if kind == 'LEY' else 4}}})" + ("[-_](20\\d{2})" if dated else "") + "(?:[-_]?([A-Z0-9]+))?"
        value = f"'{kind}-' || regexp_extract(n, '{p}', 1)::INT" + (f" || '-' || regexp_extract(n, '{p}', 2) || coalesce('-' || nullif(regexp_extract(n, '{p}', 3), ''), '')" if dated else "" if kind == "LEY" else f" || coalesce('-' || nullif(regexp_extract(n, '{p}', 2), ''), '')")
        out.append(f"WHEN regexp_matches(n, '{p}') THEN {value}")
    return "CASE " + " ".join(out) + " END"


@query("pdf_keys", f"WITH a AS (SELECT id, {_PN} AS n FROM ({PDFS})) SELECT id, {_pdf_case()} AS pdf_key FROM a")
def pdf_keys(spark, sf):
    return derived(spark, sf, PDFS).select("id", K.pdf_key(F.col("url")).alias("pdf_key"))


STUBS = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'ds' WHEN 1 THEN 'RM' WHEN 2 THEN p_brand END AS tipo, CASE WHEN p_partkey % 3 <> 1 THEN CAST(p_size AS STRING) END AS numero, CASE WHEN p_partkey % 5 <> 2 THEN 1990 + p_partkey % 36 END AS anio, CASE p_partkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN NULL WHEN 2 THEN 'Ley General de Salud, artículo ' || p_size ELSE p_type || ', ' || p_name END AS descr FROM {part}"""


@query("stub_keys", f"""SELECT id, CASE WHEN tipo IS NOT NULL AND numero IS NOT NULL AND anio IS NOT NULL THEN upper(tipo) || '-' || numero || '-' || anio ELSE 'NORM-' || coalesce(nullif(upper(substr(trim(regexp_replace(coalesce(descr, ''), '[^A-Za-z0-9]+', '-', 'g'), '-'), 1, 40)), ''), upper(substr(sha1(concat_ws('|', tipo, numero, descr)), 1, 8))) END AS stub,
  CASE WHEN tipo IS NOT NULL AND numero IS NOT NULL AND anio IS NOT NULL THEN upper(tipo) || '-' || regexp_extract(numero, '(\\d+)', 1)::INT || '-' || anio END AS candidate FROM ({STUBS})""")
def stub_keys(spark, sf):
    v = derived(spark, sf, STUBS)
    return v.select("id", K.stub_key(F.col("tipo"), F.col("numero"), F.col("anio"), F.col("descr")).alias("stub"), K.candidate_key(F.col("tipo"), F.col("numero"), F.col("anio")).alias("candidate"))


_PATH = "regexp_replace(regexp_replace(coalesce(url, ''), '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', '')"


@query("url_parts", f"""SELECT page_id, {_PATH} AS path, string_split(regexp_replace({_PATH}, '/+$', ''), '/')[-1] AS slug,
  lower(regexp_extract(coalesce(url, ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || regexp_replace(regexp_replace({_PATH}, '/+$', ''), '/{{2,}}', '/', 'g') AS compared,
  regexp_extract(regexp_replace(url, '#.*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1) || CASE WHEN {_PATH} = '' THEN '/' ELSE regexp_replace({_PATH}, '/{{2,}}', '/', 'g') END || regexp_extract(regexp_replace(url, '#.*$', ''), '(\\?.*)$', 1) AS crawled FROM pages""")
def url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", K.url_path(u).alias("path"), K.slug(u).alias("slug"), K.compared_url(u).alias("compared"), K.crawl_url(u).alias("crawled"))


URLS = """SELECT page_id AS id, CASE page_id % 8 WHEN 0 THEN url || '/webdigemid/author/admin/' WHEN 1 THEN 'http://x.pe/publicaciones/normas-legales/page/' || page_id || '/' WHEN 2 THEN 'http://x.pe/publicaciones/normas-legales/' WHEN 3 THEN 'http://x.pe/publicaciones/normas-legales/decreto-supremo/' WHEN 4 THEN 'http://x.pe/publicaciones/normas-legales/2024/rm-' || page_id || '-2024/' WHEN 5 THEN 'http://x.pe//a//' || page_id WHEN 6 THEN url END AS url FROM {pages}"""
_LP = "regexp_replace(regexp_replace(lower(" + _PATH + "), '/{2,}', '/', 'g'), '/+$', '')"
_IGN = f"CASE WHEN list_contains(string_split({_LP}, '/'), 'author') THEN 'author' WHEN regexp_matches({_LP}, '/page/\\d+$') THEN 'listing_page' WHEN regexp_matches({_LP}, '/normas-legales$') THEN 'navigation' WHEN regexp_extract({_LP}, '^.*?/normas-legales/(.*)$', 1) IN ({', '.join(repr(s) for s in K.CATEGORY_SLUGS)}) THEN 'category' END"


@query("url_classify", f"SELECT id, {_IGN} AS ignored, ({_IGN}) IS NULL AND regexp_matches({_LP}, '/normas-legales/20\\d{{2}}/[^/]+/?$') AS detail FROM ({URLS})")
def url_classify(spark, sf):
    return derived(spark, sf, URLS).select("id", K.ignored_url(F.col("url")).alias("ignored"), F.coalesce(K.is_detail_url(F.col("url")), F.lit(False)).alias("detail"))


@query("page_candidates", """SELECT page_id, n AS page, CASE WHEN n <= 1 THEN url ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') || '/page/' || n || '/' || ' ' || regexp_replace(url, '[?#].*$', '') || '?' || CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) <> '' THEN regexp_extract(url, '\\?([^#]*)', 1) || '&' ELSE '' END || 'paged=' || n END AS candidates FROM pages, (VALUES (1), (2)) AS t(n)""")
def page_candidates(spark, sf):
    p = table(spark, sf, "pages").withColumn("page", F.explode(F.array(F.lit(1), F.lit(2))))
    return p.select("page_id", "page", F.array_join(K.page_candidates(F.col("url"), F.col("page")), " ").alias("candidates"))


@query("quality_score", f"SELECT doc_id, round({quality_sql('t')}, 6) AS quality FROM (SELECT doc_id, {STRIPPED} AS t FROM documents)")
def quality_score(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(Q.quality_score(F.col("text")), 6).alias("quality"))


@query("formula_flag", f"SELECT doc_id, (length(t) - length(translate(t, '{SIGNS}', '')) >= 1) AND (length(t) - length(translate(t, '{SIGNS}', '')))::DOUBLE / greatest(length(t), 1) > 0 AS formula FROM (SELECT doc_id, {STRIPPED} AS t FROM documents)")
def formula_flag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Q.maybe_formula(F.col("text"), 1, 0.0).alias("formula"))


_LINES = "string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10))"


@query("table_like", f"SELECT doc_id, len(list_filter({_LINES}, lambda s: trim(s) <> '' AND regexp_matches(s, '\\t|\\||\\s{{2,}}\\S+\\s{{2,}}|\\b\\d[\\d.,]*\\s{{2,}}\\d[\\d.,]*\\b'))) >= 1 AS table_like FROM documents")
def table_like(spark, sf):
    return table(spark, sf, "documents").select("doc_id", Q.is_table_like(F.col("text"), 1).alias("table_like"))


LINES = """SELECT o_orderkey AS id, CASE o_orderkey % 11 WHEN 0 THEN 'Artículo ' || o_custkey || ' De la venta' WHEN 1 THEN substr('IVXLCDM', CAST(1 + o_orderkey % 7 AS INT), 2) || '. Titulo ' || 'Clerk ' || o_custkey WHEN 2 THEN (o_orderkey % 9) || '.' || (o_custkey % 30) || '.1 Alcance' WHEN 3 THEN '- ' || o_orderstatus WHEN 4 THEN 'a) literal' WHEN 5 THEN '   ' WHEN 6 THEN 'Clerk ' || o_custkey || ' ' || o_orderstatus WHEN 7 THEN (o_orderkey % 40) || ') tres' WHEN 8 THEN ' articulo ' || o_custkey WHEN 9 THEN '• bala' ELSE o_orderstatus END AS s FROM {orders}"""
_KIND = "CASE WHEN trim(s) = '' THEN 'blank' WHEN regexp_matches(s, '(?i)^\\s*art[íi]culo\\s+\\d+') OR regexp_matches(s, '^\\s*[IVXLCDM]{1,8}[.)]\\s+') OR regexp_matches(s, '^\\s*\\d+(?:\\.\\d+){1,4}\\.?\\s+') THEN 'heading' WHEN regexp_matches(s, '^\\s*(?:[-*•]|[a-zA-Z]\\)|\\d+\\)|\\d+\\.)\\s+') THEN 'list_item' ELSE 'paragraph' END"


@query("line_kinds", f"SELECT id, {_KIND} AS kind, CASE WHEN regexp_matches(s, '(?i)^\\s*art[íi]culo\\s+\\d+') THEN 'article_heading' WHEN regexp_matches(s, '^\\s*[IVXLCDM]{{1,8}}[.)]\\s+') THEN 'roman_heading' WHEN regexp_matches(s, '^\\s*\\d+(?:\\.\\d+){{1,4}}\\.?\\s+') THEN 'numeric_heading' END AS heading FROM ({LINES})")
def line_kinds(spark, sf):
    return derived(spark, sf, LINES).select("id", Q.line_kind(F.col("s")).alias("kind"), Q.heading_kind(F.col("s")).alias("heading"))


@query("line_kind_counts", f"SELECT doc_id, count(*) FILTER (k = 'heading') AS headings, count(*) FILTER (k = 'paragraph') AS paragraphs, count(*) FILTER (k = 'list_item') AS list_items, count(*) FILTER (k = 'blank') AS blanks FROM (SELECT doc_id, {_KIND} AS k FROM (SELECT doc_id, unnest({_LINES}) AS s FROM documents)) GROUP BY doc_id")
def line_kind_counts(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.transform(Q.lines(F.col("text")), lambda s: Q.line_kind(s)).alias("k"))
    n = lambda kind, name: F.size(F.filter("k", lambda x: x == kind)).cast("long").alias(name)
    return d.select("doc_id", n("heading", "headings"), n("paragraph", "paragraphs"), n("list_item", "list_items"), n("blank", "blanks"))


VALUES_ = """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Guardar a ' || t || ' °C y ' || (t + 5) || ' °C segun articulo ' || o_custkey || ' del ' || d || '/' || m || '/2024, numeral 3.' || m || '.1 y articulo ' || o_custkey WHEN 2 THEN 'nada ' || o_orderstatus WHEN 3 THEN 'de 2-' || t || ' C el ' || d || '-' || m || '-21; ver 1.' || d END AS body
  FROM (SELECT *, o_orderkey % 40 AS t, day(o_orderdate) AS d, month(o_orderdate) AS m FROM {orders}) AS x"""


@query("sensitive_values", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'temperature=' || t || ' °C y ' || (t + 5) || ' °C;date=' || d || '/' || m || '/2024;article=articulo ' || o_custkey || ';numeral=3.' || m || '.1' WHEN 3 THEN 'temperature=' || t || ' C;date=' || d || '-' || m || '-21;numeral=1.' || d ELSE '' END AS found
  FROM (SELECT *, o_orderkey % 40 AS t, day(o_orderdate) AS d, month(o_orderdate) AS m FROM orders)""")
def sensitive_values(spark, sf):
    return derived(spark, sf, VALUES_).select("id", F.array_join(F.transform(Q.sensitive_values(F.col("body")), lambda s: F.concat_ws("=", s.kind, s.value)), ";").alias("found"))


@query("review_flags", f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(list_transform({_LINES}, lambda s: trim(s)), lambda s: s <> '') AS ls FROM documents),
b AS (SELECT *, string_split_regex(t, '[^\\p{{L}}\\p{{N}}_]+') AS ws, regexp_replace(t, '([^\\p{{L}}\\p{{N}}_/-])', '\\1\\1', 'g') AS apart FROM a)
SELECT doc_id, len(list_filter(ls, lambda s: length(s) <= 3)) AS short_fragments, len(list_filter(ws, lambda w: regexp_full_match(w, '[0-9]+[A-Za-z]|[A-Za-z][0-9]+'))) > 0 AS numeric_error,
  regexp_matches(t, '(^|[^0-9])-?[0-9]{{1,3}}\\s*[°º]?\\s*[Cc]') AS temperature_value, doc_id % 2 = 0 AS list_split, false AS layout_order, len(list_distinct(list_filter(ws, lambda w: regexp_full_match(w, '[IVXLCDM]{{1,8}}')))) AS romans,
  len(list_filter(ws, lambda w: regexp_full_match(w, '[IVXLCDMil1]{{1,8}}') AND regexp_matches(w, '[a-z1]'))) > 0 AS roman_error,
  len(list_filter(ls[1:40], lambda s: regexp_matches(s, '^[IVXLCDMil1]{{1,8}}[.)]\\s+\\S+') AND NOT regexp_matches(s, '^[IVXLCDM]{{1,8}}[.)]\\s+'))[1:12]) AS malformed,
  len(list_distinct(regexp_extract_all(apart, '(^|[^\\p{{L}}\\p{{N}}_])([0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}})($|[^\\p{{L}}\\p{{N}}_])', 2))) AS dates FROM b""")
def review_flags(spark, sf):
    layout = F.struct((F.col("doc_id") % 2 == 0).alias("possible_numbered_list_split"), F.lit(None).cast("boolean").alias("possible_index_alignment_issue"), F.lit(False).alias("possible_bad_layout_order"))
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", Q.review_flags(F.col("text"), F.lit(True), layout=layout).alias("f"))
    return d.select("doc_id", F.col("f.short_fragments").cast("long").alias("short_fragments"), "f.numeric_error", "f.temperature_value", "f.list_split", "f.layout_order", F.size("f.matches.roman_numerals").cast("long").alias("romans"), "f.roman_error", F.size("f.malformed_heading_lines").cast("long").alias("malformed"), F.size("f.matches.dates").cast("long").alias("dates"))


LAYERS = """SELECT doc_id AS id, CASE WHEN doc_id % 6 IN (1, 3, 4) THEN '' WHEN doc_id % 6 = 2 THEN replace(text, ' ', '') || ' x' ELSE text END AS plain, CASE WHEN doc_id % 6 = 2 THEN text WHEN doc_id % 6 = 3 THEN 'x' ELSE '' END AS second, CASE WHEN doc_id % 6 IN (3, 4) THEN text ELSE '' END AS ocr,
  CASE WHEN doc_id % 12 = 3 THEN 0.8 WHEN doc_id % 6 = 0 THEN 0.9 END AS conf, CASE WHEN doc_id % 6 = 1 THEN 255.0 ELSE 10.0 END AS px FROM (SELECT doc_id, coalesce(text, '') AS text FROM {documents}) AS x"""


@query("page_method", f"""WITH a AS (SELECT *, {quality_sql('plain')} AS q1, {quality_sql('second')} AS q2, {quality_sql('ocr')} AS q3 FROM ({LAYERS})),
b AS (SELECT *, q1 < 0.75 AND second <> '' AND q2 > q1 AS two FROM a), c AS (SELECT *, CASE WHEN two THEN q2 ELSE q1 END AS q, CASE WHEN two THEN length(second) ELSE length(plain) END AS n, q3 * coalesce(conf, 0.6) AS qo FROM b)
SELECT id, CASE WHEN plain = '' AND px > 250 THEN 'blank' WHEN (q < 0.5 OR n < 25) AND ocr <> '' AND qo > q THEN 'ocr' WHEN two THEN 'second' ELSE 'plain' END AS method,
  round(CASE WHEN plain = '' AND px > 250 THEN 1.0 WHEN (q < 0.5 OR n < 25) AND ocr <> '' AND qo > q THEN qo ELSE q END, 3) AS quality FROM c""")
def page_method(spark, sf):
    m = Q.page_method(F.col("plain"), F.col("second"), F.col("ocr"), F.col("conf").cast("double"), F.col("px"))
    return spread(derived(spark, sf, LAYERS)).select("id", m.alias("m")).select("id", "m.method", F.round("m.quality", 3).alias("quality"))


@query("mean_confidence", "SELECT vec_id, round(list_avg(list_filter(embedding, lambda x: x >= 0)::DOUBLE[]) / 100, 6) AS confidence FROM embeddings")
def mean_confidence(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(Q.mean_confidence(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("confidence"))


@query("chart_flag", "SELECT vec_id, len(list_filter(embedding, lambda x: x::DOUBLE BETWEEN 0.04 AND 0.75)) > 0 AS chart FROM embeddings")
def chart_flag(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", Q.maybe_chart(F.transform("embedding", lambda x: x.cast("double"))).alias("chart"))


_CELLS = [["'Producto'", "'Lote'"], ["p_name || '|' || p_size", "'M0' || p_partkey"], ["p_type", "''"]]
_MARKED = [[f"replace({c}, '|', chr(92) || '|')" for c in row] for row in _CELLS]
_WIDE = [f"greatest({', '.join(f'length({row[i]})' for row in _MARKED)})" for i in (0, 1)]
_LINE = lambda row: " || ' | ' || ".join(f"rpad({c}, ({w})::INT, ' ')" for c, w in zip(row, _WIDE, strict=True))
_RULE = " || ' | ' || ".join(f"repeat('-', {w})" for w in _WIDE)
_MARKDOWN = " || chr(10) || ".join(f"'| ' || {x} || ' |'" for x in (_LINE(_MARKED[0]), _RULE, _LINE(_MARKED[1]), _LINE(_MARKED[2])))


@query("table_markdown", f"""SELECT p_partkey AS id, true AS real, m AS markdown, 'Tabla 1:' || chr(10) || m || chr(10) || chr(10) || 'Tabla 2:' || chr(10) || m AS "all" FROM (SELECT p_partkey, {_MARKDOWN} AS m FROM part)""")
def table_markdown(spark, sf):
    """QLT6, QLT7: a table of each part, with a bar in a cell."""
    grid = F.array(*[F.array(*[F.expr(c) for c in row]) for row in _CELLS])
    v = spread(table(spark, sf, "part")).select(F.col("p_partkey").alias("id"), grid.alias("g"))
    return v.select("id", Q.is_real_table(F.col("g")).alias("real"), Q.table_markdown(F.col("g")).alias("markdown"), Q.tables_markdown(F.array("g", "g")).alias("all"))


SAID = """SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN j WHEN 1 THEN '```json ' || j || ' ```' WHEN 2 THEN 'said: ' || j || ' end' WHEN 3 THEN p_type END AS body FROM (SELECT *, chr(123) || '"a": "' || p_name || '"' || chr(125) AS j FROM {part}) AS x"""


@query("tolerant_json", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 < 3 THEN p_name END AS a FROM part")
def tolerant_json(spark, sf):
    return derived(spark, sf, SAID).select("id", X.tolerant_json(F.col("body"), "a string").a.alias("a"))


_SHORT = "SELECT 900001 AS item_id, 'of the' AS text UNION ALL SELECT 900002, 'zz' UNION ALL SELECT 900003, 'e la' UNION ALL SELECT 900004, 'n  the  A' UNION ALL SELECT 900005, ' ' UNION ALL SELECT 900006, 'no such words stand here'"


@query("quote_verify", f"""SELECT b.item_id, d.doc_id FROM (SELECT item_id, text FROM benchmark UNION ALL {_SHORT}) b JOIN documents d ON contains(lower({CLEAN.format('d.text')}), lower({CLEAN.format('b.text')})) AND {CLEAN.format('b.text')} <> ''""")
def quote_verify(spark, sf):
    """FTS8 over all documents: fragments of the benchmark and some of a few words."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").cast("long"), "text").unionByName(values(spark, _SHORT).select(F.col("item_id").cast("long"), "text"))
    return S.documents_with(b.withColumnRenamed("text", "fragment"), table(spark, sf, "documents"))


@query("bands", f"WITH {PAGES_SQL} SELECT doc_id, CASE WHEN quality_score >= 0.85 THEN 'alta' WHEN quality_score >= 0.5 THEN 'media' ELSE 'baja' END AS band FROM pages")
def bands(spark, sf):
    return norm_pages(spark, sf).select("doc_id", Q.band(F.col("quality_score")).alias("band"))

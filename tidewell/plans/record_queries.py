"""Queries over records: search, merging, matching, reports, queues and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.quality import quality_score
from tidewell.functions.spanish import stem
from tidewell.operators import matching as M
from tidewell.operators import merge as G
from tidewell.operators import queues as U
from tidewell.operators import reports as R
from tidewell.operators import search as S
from tidewell.operators import states as Z
from tidewell.plans.base import COUNTS_SQL, HIGH, LOW, PAGES_SQL, derived, norm_pages, query, spread, table, values
from tidewell.plans.stems import stems_sql
from tidewell.plans.text_queries import CLEAN

QUERY = "that with heron enau lichen aux que"
_WORDS = S.tokens_of(QUERY)


def ranked_sql(rows: str, asked: str = QUERY) -> str:
    """CTEs from rows (``id, body``) to ``ranked(id, r)``: the mean over the stems of the query's words of 0.1 times the
    sum of 1/i^2 over a stem's places."""
    words = ", ".join(f"('{w}')" for w in S.tokens_of(asked))
    return f"""toks AS (SELECT id, unnest(string_split_regex(lower(coalesce(body, '')), '{S.BETWEEN}')) AS w FROM ({rows})),
  asked AS (SELECT w FROM (VALUES {words}) AS t(w)), {stems_sql("SELECT w FROM toks WHERE w <> '' UNION SELECT w FROM asked")},
  wanted AS (SELECT DISTINCT stem FROM stems JOIN asked USING (w) WHERE stem <> ''),
  places AS (SELECT id, stem, least(count(*), 255) AS n FROM toks JOIN stems USING (w) JOIN wanted USING (stem) GROUP BY ALL),
  ranked AS (SELECT id, round(list_sum(list(list_sum(list_transform(range(1, 1 + n), lambda i: 1.0::DOUBLE / (i * i))) * 0.1 / 1.64493406685 ORDER BY stem)) / (SELECT count(*) FROM wanted), 12) AS r FROM places GROUP BY id)"""


def plain_rank_sql(text: str) -> str:
    """The same for whole tokens."""
    toks = f"string_split_regex(lower(coalesce({text}, '')), '{S.BETWEEN}')"
    one = "coalesce(list_sum(list_transform(range(1, 1 + least(len(list_filter({t}, lambda w: w = '{w}')), 255)), lambda i: 1.0::DOUBLE / (i * i))), 0.0) * 0.1 / 1.64493406685"
    return "round((" + " + ".join(one.format(t=toks, w=w) for w in _WORDS) + f") / {len(_WORDS)}, 12)"


_TOPK = f"""WITH {ranked_sql('SELECT doc_id AS id, text AS body FROM documents')}
SELECT doc_id, source AS document_key, round(r, 6) AS rank FROM documents JOIN ranked ON id = doc_id ORDER BY r DESC, source, doc_id LIMIT 10"""


@query("search_topk", _TOPK)
def search_topk(spark, sf):
    d = table(spark, sf, "documents").select(F.col("text").alias("text_content"), F.col("doc_id").alias("page_number"), F.col("source").alias("document_key"))
    found = S.search(d, None, QUERY, 10)
    return found.select(F.col("page_number").alias("doc_id"), "document_key", F.round("rank", 6).alias("rank"))


@query("search_indexed", _TOPK)
def search_indexed(spark, sf):
    d = spread(table(spark, sf, "documents").select(F.col("text").alias("text_content"), F.col("doc_id").alias("page_number"), F.col("source").alias("document_key")))
    return S.search_terms(S.term_table(d), QUERY, 10).select(F.col("page_number").alias("doc_id"), "document_key", F.round("rank", 6).alias("rank"))


_U = """SELECT source AS document_key, doc_id AS page_number, 'd' || doc_id AS id, text AS body, NULL::VARCHAR AS detail_url, contains(text, '|') AS has_tables FROM documents
  UNION ALL SELECT 'page', page_id, 'p' || page_id, html, url, false FROM pages"""
_UNION = f"""WITH u AS ({_U}), {ranked_sql('SELECT id, body FROM u')}
SELECT document_key, page_number, detail_url, has_tables, round(r, 6) AS rank FROM u JOIN ranked USING (id) ORDER BY r DESC, document_key, page_number LIMIT 20"""


@query("search_union", _UNION)
def search_union(spark, sf):
    d = table(spark, sf, "documents").select(F.col("text").alias("text_content"), F.col("doc_id").alias("page_number"), F.col("source").alias("document_key"), F.contains("text", F.lit("|")).alias("has_tables"))
    p = table(spark, sf, "pages").select(F.col("html").alias("text_content"), F.col("page_id").alias("page_number"), F.lit("page").alias("document_key"), F.col("url").alias("detail_url"))
    return S.search(d, p, QUERY, 20).select("document_key", "page_number", "detail_url", "has_tables", F.round("rank", 6).alias("rank"))


_VERSIONS = f"""WITH {ranked_sql('SELECT doc_id AS id, text AS body FROM documents')}, sources AS (SELECT version, side FROM range(1, 5) v(version), range(1, 3) s(side) WHERE version > 1 OR side = 1),
  placed AS (SELECT version, source AS document_key, doc_id AS page_number, row_number() OVER (PARTITION BY version ORDER BY r DESC, source, doc_id) AS n FROM documents JOIN ranked ON id = doc_id CROSS JOIN sources)
SELECT version::INTEGER AS version, document_key, page_number FROM placed WHERE n <= 4"""


@query("search_versions", _VERSIONS)
def search_versions(spark, sf):
    """SET2: the first version lacks the norms; the others find both kinds, here the same table twice."""
    d = table(spark, sf, "documents").select(F.col("text").alias("text_content"), F.col("doc_id").alias("page_number"), F.col("source").alias("document_key"))
    out = [S.search(d, d, QUERY, 4, version=v).select(F.lit(v).alias("version"), "document_key", "page_number") for v in (1, 2, 3, 4)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("search_nothing", "SELECT doc_id FROM documents WHERE false")
def search_nothing(spark, sf):
    d = table(spark, sf, "documents").select(F.col("text").alias("text_content"), F.col("doc_id").alias("page_number"), F.col("source").alias("document_key"))
    return S.search(d, None, "que paso con la").select(F.col("page_number").alias("doc_id"))


@query("search_plain", f"SELECT doc_id, source AS document_key, round(r, 6) AS rank FROM (SELECT *, {plain_rank_sql('text')} AS r FROM documents) WHERE r > 0 ORDER BY r DESC, source, doc_id LIMIT 10")
def search_plain(spark, sf):
    """The search without stems: whole tokens."""
    d = table(spark, sf, "documents").select(F.col("text").alias("text_content"), F.col("doc_id").alias("page_number"), F.col("source").alias("document_key"))
    return S.search(d, None, QUERY, 10, stem=False).select(F.col("page_number").alias("doc_id"), "document_key", F.round("rank", 6).alias("rank"))


SPANISH = "asciones rapidamente ciónes, lasmente ñecitas doados miez"


@query("search_stemmed", f"""WITH {ranked_sql('SELECT doc_id AS id, text AS body FROM documents', SPANISH)}
SELECT doc_id AS page_number, round(r, 6) AS rank FROM documents JOIN ranked ON id = doc_id ORDER BY r DESC, source, doc_id LIMIT 10""")
def search_stemmed(spark, sf):
    """Words in forms of their own find the texts that hold other forms."""
    d = table(spark, sf, "documents").select(F.col("text").alias("text_content"), F.col("doc_id").alias("page_number"), F.col("source").alias("document_key"))
    return S.search(d, None, SPANISH, 10).select("page_number", F.round("rank", 6).alias("rank"))


@query("token_stems", f"""WITH toks AS (SELECT unnest(string_split_regex(lower(coalesce(text, '')), '{S.BETWEEN}')) AS w FROM documents), {stems_sql("SELECT w FROM toks WHERE w <> ''")}
SELECT stem, count(*) AS tokens, min(w) AS first FROM stems GROUP BY stem""")
def token_stems(spark, sf):
    """FTS2: every token of the corpus, stemmed once."""
    tokens = table(spark, sf, "documents").select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), S.BETWEEN)).alias("w")).filter("w <> ''").distinct()
    return tokens.groupBy(stem(F.col("w")).alias("stem")).agg(F.count("*").alias("tokens"), F.min("w").alias("first"))


@query("search_sources", """SELECT url AS detail_url, arg_min('page', page_id) AS document_key, min(page_id) AS page_number FROM pages GROUP BY url""")
def search_sources(spark, sf):
    p = table(spark, sf, "pages").select(F.col("url").alias("detail_url"), F.lit("page").alias("document_key"), F.col("page_id").alias("page_number"), F.lit(1.0).alias("rank"))
    return S.sources(p)


@query("search_context_warnings", f"""WITH {PAGES_SQL}, w AS (SELECT doc_id, CASE WHEN posible_grafico THEN 'derogada' WHEN has_tables THEN 'modificada' ELSE 'vigente' END AS e, coalesce(revisado_manual, false) AS r, quality_score AS q, has_tables, posible_formula FROM pages)
SELECT doc_id, array_to_string(list_filter([CASE WHEN e = 'modificada' THEN 'norm_modified' WHEN e <> 'vigente' THEN 'norm_repealed' END, CASE WHEN NOT r AND q < 0.95 THEN 'low_reliability' WHEN NOT r AND q < 0.99 THEN 'medium_reliability' END,
  CASE WHEN NOT r AND has_tables THEN 'flattened_table' END, CASE WHEN NOT r AND posible_formula THEN 'possible_formula' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM w""")
def search_context_warnings(spark, sf):
    p = norm_pages(spark, sf).withColumn("estado_vigencia", F.when(F.col("posible_grafico"), "derogada").when(F.col("has_tables"), "modificada").otherwise("vigente"))
    p = p.withColumns({"document_key": F.col("norma_id"), "title": F.lit("t"), "text_content": F.col("text"), "detail_url": F.lit("u")})
    return S.context(p, LOW, HIGH).select("doc_id", "warnings")


QUESTIONS = """SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN '¿Cuántas alertas hubo hoy?' WHEN 1 THEN 'alertas de esta semana de ' || p_name WHEN 2 THEN 'las ' || p_size || ' últimas alertas' WHEN 3 THEN 'la última alerta de ' || p_type WHEN 4 THEN '¿Qué dice la norma de ' || p_name || '?' WHEN 5 THEN 'cuantas alertas este mes' WHEN 6 THEN 'alertas nuevas ' || p_size WHEN 8 THEN 'cuántas alertas hay sobre ' || p_brand WHEN 9 THEN (1 + p_size % 12) || ' alertas recientes' WHEN 10 THEN p_name END AS q FROM {part}"""
_QF = f"lower(translate(coalesce(q, ''), '{S.ACCENTED}', '{S.PLAIN}'))"
_WHEN = f"CASE WHEN regexp_matches({_QF}, '\\bhoy\\b') THEN 'today' WHEN regexp_matches({_QF}, '\\bsemana\\b') THEN 'week' WHEN regexp_matches({_QF}, '\\bmes\\b') THEN 'month' END"


@query("query_router", f"""SELECT id, CASE WHEN regexp_matches({_QF}, '\\bcuant[oa]s?\\b') AND contains({_QF}, 'alerta') AND ({_WHEN}) IS NOT NULL THEN 'count_' || ({_WHEN}) WHEN contains({_QF}, 'alerta') AND ({_WHEN}) IS NOT NULL THEN 'list_' || ({_WHEN})
  WHEN contains({_QF}, 'alerta') AND regexp_matches({_QF}, '\\b(ultima|ultimas|ultimo|ultimos|reciente|recientes|nueva|nuevas|nuevo|nuevos)\\b') THEN 'latest' ELSE 'full_text' END AS route,
  coalesce(try_cast(nullif(regexp_extract({_QF}, '\\b(10|[1-9])\\b', 1), '') AS INT), CASE WHEN regexp_matches({_QF}, '\\b(ultimas|ultimos|recientes|nuevas|nuevos)\\b') THEN 5 WHEN regexp_matches({_QF}, '\\b(ultima|ultimo|reciente|nueva|nuevo)\\b') THEN 1 ELSE 5 END)::INT AS asked FROM ({QUESTIONS})""")
def query_router(spark, sf):
    return derived(spark, sf, QUESTIONS).select("id", S.route(F.col("q")).alias("route"), S.asked_limit(F.col("q")).alias("asked"))


_TOK = "list_filter(string_split_regex(lower({}), '[^a-záéíóúñü0-9]+'), lambda w: length(w) >= 3 AND w NOT IN (" + ", ".join(f"'{w}'" for w in S.STOP_WORDS) + "))"


@query("query_tokens", f"SELECT item_id, array_to_string(list_sort(list_distinct({_TOK.format('text')})), ' ') AS tokens FROM benchmark")
def query_tokens(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(S.query_tokens(F.col("text"))), " ").alias("tokens"))


_GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(translate({}, '" + S.ACCENTED + "', '" + S.PLAIN + "')), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("fuzzy_suggest", f"""WITH q AS (SELECT {_GRAMS.format("'Andiou heron xyz'")} AS w) SELECT document_key, round(similarity, 6) AS similarity FROM (SELECT source AS document_key, max(len(list_intersect(w, {_GRAMS.format('text')}))::DOUBLE / len(w)) AS similarity FROM documents, q GROUP BY source) WHERE similarity > 0.15 ORDER BY similarity DESC, document_key LIMIT 3""")
def fuzzy_suggest(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("document_key"), F.col("text").alias("text_content"))
    return S.suggestions(d, "Andiou heron xyz", by_words=False).select("document_key", F.round("similarity", 6).alias("similarity"))


@query("similar_alerts")
def similar_alerts(spark, sf):
    d = spread(table(spark, sf, "documents").select(F.col("source").alias("document_key"), F.col("text").alias("text_content")))
    return S.suggestions(d, "Andiou heron xyz").select("document_key", F.round("similarity", 6).alias("similarity"))


_SEQUENCE = _GRAMS.removeprefix("list_distinct(").removesuffix(")")


@query("word_similarity", f"""WITH q AS (SELECT unnest({_GRAMS.format("'Andiou heron xyz'")}) AS g), lists AS (SELECT item_id, {_SEQUENCE.format('text')} AS gs FROM benchmark),
seq AS (SELECT item_id, unnest(gs) AS g, generate_subscripts(gs, 1) AS p FROM lists), hits AS (SELECT item_id, p FROM seq WHERE g IN (SELECT g FROM q)),
stretches AS (SELECT a.item_id, a.p AS i, b.p AS j, count(DISTINCT s.g) AS u, count(DISTINCT s.g) FILTER (s.g IN (SELECT g FROM q)) AS c
  FROM hits a JOIN hits b ON b.item_id = a.item_id AND b.p >= a.p JOIN seq s ON s.item_id = a.item_id AND s.p BETWEEN a.p AND b.p GROUP BY ALL)
SELECT item_id, round(coalesce(max(c::DOUBLE / ((SELECT count(*) FROM q) + u - c)), 0), 6) AS similarity FROM lists LEFT JOIN stretches USING (item_id) GROUP BY item_id""")
def word_similarity(spark, sf):
    """FTS5: the SQL tries every stretch between two of the query's trigrams."""
    return table(spark, sf, "benchmark").select("item_id", F.round(S.word_similarity_udf("Andiou heron xyz")("text"), 6).alias("similarity"))


@query("similar_indexed")
def similar_indexed(spark, sf):
    """FTS5, AGG7 by the trigram table: the same suggestions as similar_alerts."""
    d = spread(table(spark, sf, "documents").select(F.col("source").alias("document_key"), F.col("doc_id").alias("page_number"), F.col("text").alias("text_content")))
    return S.suggestions_indexed(S.gram_table(d), d, "Andiou heron xyz").select("document_key", F.round("similarity", 6).alias("similarity"))


@query("word_diff")
def word_diff(spark, sf):
    """Each turn against the one before it."""
    c = table(spark, sf, "conversations")
    a, b = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("a")), c.select("conv_id", "turn", F.col("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.round(S.changed_ratio("a", "b"), 6).alias("changed"))


# --- Merging --------------------------------------------------------------------------------------------


@query("dedup_last_wins", "SELECT source, max(doc_id) AS doc_id, min(doc_id) AS first_seen FROM documents GROUP BY source")
def dedup_last_wins(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    return G.last_wins(d, ["source"], ["doc_id"]).select("source", "doc_id", "first_seen")


@query("dedup_first_wins", "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def dedup_first_wins(spark, sf):
    return G.first_wins(table(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"])


@query("dedup_fingerprint", "SELECT min(doc_id) AS doc_id, sha1(text) AS fp FROM documents GROUP BY sha1(text)")
def dedup_fingerprint(spark, sf):
    return G.by_fingerprint(table(spark, sf, "documents").select("doc_id", "text"), F.col("text"), ["doc_id"]).select("doc_id", "fp")


_SPLIT = "TIMESTAMP '1996-01-01'"


@query("insert_new_only", f"WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate < {_SPLIT} AS old FROM orders), k AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM o WHERE old GROUP BY 1), n AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM o WHERE NOT old GROUP BY 1) SELECT * FROM k UNION ALL SELECT * FROM n WHERE o_custkey NOT IN (SELECT o_custkey FROM k)")
def insert_new_only(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderdate") < F.expr(_SPLIT)).alias("old"))
    known = o.filter("old").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    found = o.filter("NOT old").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return G.insert_new(known, found, "o_custkey")


@query("new_documents", f"SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= {_SPLIT} AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1994-06-01')")
def new_documents(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate")
    return G.new_rows(o.filter(F.col("o_orderdate") >= F.expr(_SPLIT)).select("o_custkey").distinct(), o.filter("o_orderdate < TIMESTAMP '1994-06-01'"), "o_custkey")


@query("upsert_merge", f"""WITH o AS (SELECT o_custkey AS k, max_by(o_orderpriority, o_orderkey) AS title, max(o_orderdate) AS d FROM orders WHERE o_orderdate < {_SPLIT} GROUP BY 1),
n AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE max_by(o_orderstatus, o_orderkey) END AS title FROM orders WHERE o_orderdate >= {_SPLIT} GROUP BY 1)
SELECT coalesce(o.k, n.k) AS document_key, coalesce(nullif(n.title, ''), o.title) AS title, CASE WHEN o.k IS NOT NULL AND n.k IS NOT NULL THEN 'updated' WHEN n.k IS NOT NULL THEN 'new' ELSE 'kept' END AS action,
  coalesce(o.d, CASE WHEN n.k IS NOT NULL THEN TIMESTAMP '2000-01-01' END) AS first_seen_at, CASE WHEN n.k IS NOT NULL THEN TIMESTAMP '2000-01-01' ELSE o.d END AS last_seen_at FROM o FULL JOIN n ON o.k = n.k""")
def upsert_merge(spark, sf):
    o = table(spark, sf, "orders")
    old = o.filter(F.col("o_orderdate") < F.expr(_SPLIT)).groupBy(F.col("o_custkey").alias("document_key")).agg(F.max_by("o_orderpriority", "o_orderkey").alias("title"), F.max("o_orderdate").alias("first_seen_at"), F.max("o_orderdate").alias("last_seen_at"))
    new = o.filter(F.col("o_orderdate") >= F.expr(_SPLIT)).groupBy(F.col("o_custkey").alias("document_key")).agg(F.max_by("o_orderstatus", "o_orderkey").alias("title"))
    new = new.withColumn("title", F.when(F.col("document_key") % 3 == 0, "").otherwise(F.col("title")))
    return G.upsert(old, new, "document_key", F.expr("TIMESTAMP '2000-01-01'")).select("document_key", "title", "action", "first_seen_at", "last_seen_at")


@query("replace_per_doc", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT l_orderkey, l_linenumber, l_quantity * 2 FROM lineitem WHERE l_returnflag = 'R'")
def replace_per_doc(spark, sf):
    l = table(spark, sf, "lineitem")
    new = l.filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("l_quantity"))
    return G.replace_by(l.select("l_orderkey", "l_linenumber", "l_quantity"), new, "l_orderkey")


FLAGS = """SELECT o_orderkey, o_orderkey % 2 = 0 AS existing, o_orderkey % 4 >= 2 AS norm, o_orderkey % 3 = 0 AS force_, o_custkey % 2 = 0 AS app FROM {orders}"""


@query("page_action", f"""SELECT *, CASE WHEN existing AND norm THEN CASE WHEN app THEN 'updated_normalized' ELSE 'planned_update_normalized' END WHEN existing AND NOT force_ THEN 'reused' WHEN existing THEN CASE WHEN app THEN 'updated' ELSE 'planned_update' END
  WHEN norm THEN 'skipped_update_normalized_missing' WHEN app THEN 'inserted' ELSE 'planned_insert' END AS action FROM ({FLAGS})""")
def page_action(spark, sf):
    return derived(spark, sf, FLAGS).withColumn("action", G.page_action(F.col("existing"), F.col("norm"), F.col("force_"), F.col("app")))


@query("stamp_keys", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2000-01-01' ELSE o_orderdate END AS at FROM orders")
def stamp_keys(spark, sf):
    o = table(spark, sf, "orders")
    return G.stamped(o.select("o_orderkey", F.col("o_orderdate").alias("at")), o.filter("o_orderstatus = 'F'"), "o_orderkey", "at", F.expr("TIMESTAMP '2000-01-01'"))


@query("backfill", "SELECT doc_id, coalesce(quality, toxic, CASE WHEN lang = 'en' THEN -1 END)::INT AS q FROM documents LEFT JOIN labels USING (doc_id)")
def backfill(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", "toxic").alias("q"), F.lit(-1).alias("other"), "lang")
    return G.backfilled(d, "q", "other", F.col("lang") == "en").select("doc_id", "q")


@query("merge_entries", """WITH r AS (SELECT source AS k, doc_id, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang, n_chars FROM documents)
SELECT k, arg_min(lang, row(-n_chars, doc_id)) FILTER (lang IS NOT NULL) AS lang, array_to_string(list_sort(list_distinct(list(doc_id % 7))), ',') AS tags FROM r GROUP BY k""")
def merge_entries(spark, sf):
    r = table(spark, sf, "documents").select(F.col("source").alias("k"), "doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang"), "n_chars", F.array(F.col("doc_id") % 7).alias("tags"))
    return G.merged_entries(r, "k", [-F.col("n_chars"), F.col("doc_id")], ["lang"], ["tags"]).select("k", "lang", F.array_join("tags", ",").alias("tags"))


@query("capped_sources", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10")
def capped_sources(spark, sf):
    return G.capped_per(table(spark, sf, "documents").select("source", "doc_id"), "source", ["doc_id"], 10)


ASSETS = """SELECT p_partkey AS id, 'n' || (p_partkey % 500) AS norma_id, CASE p_partkey % 3 WHEN 0 THEN 'img' ELSE 'pdf' END AS asset_tipo, CASE p_partkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN '' END AS asset_subtipo, CASE WHEN p_partkey % 7 <> 0 THEN 'f' || (p_partkey % 20) || '.pdf' END AS file_name, CASE WHEN p_partkey % 5 <> 0 THEN 'd' || (p_partkey % 300) END AS drive_file_id FROM {part}"""
WANTED = """SELECT c_custkey AS wanted_id, 'n' || (c_custkey % 600) AS norma_id, CASE c_custkey % 3 WHEN 0 THEN 'img' ELSE 'pdf' END AS asset_tipo, CASE c_custkey % 4 WHEN 0 THEN 'main' END AS asset_subtipo, CASE WHEN c_custkey % 9 <> 0 THEN 'f' || (c_custkey % 25) || '.pdf' END AS file_name, CASE WHEN c_custkey % 2 <> 0 THEN 'd' || (c_custkey % 400) END AS drive_file_id FROM {customer}"""


@query("asset_reuse", f"""SELECT w.wanted_id, min(a.id) AS asset_id, CASE WHEN min(a.id) IS NULL THEN 'insert' ELSE 'reuse' END AS action FROM ({WANTED}) w LEFT JOIN ({ASSETS}) a ON a.norma_id = w.norma_id AND a.asset_tipo = w.asset_tipo AND ((a.file_name = w.file_name AND coalesce(a.asset_subtipo, '') = coalesce(w.asset_subtipo, '')) OR a.drive_file_id = w.drive_file_id) GROUP BY 1""")
def asset_reuse(spark, sf):
    return G.reused_assets(derived(spark, sf, WANTED), derived(spark, sf, ASSETS)).select("wanted_id", "asset_id", "action")


@query("folder_paths", "WITH RECURSIVE t AS (SELECT r_regionkey AS id, r_name::VARCHAR AS path FROM region UNION ALL SELECT 100 + n_nationkey, r.path || '/' || n_name FROM nation JOIN t r ON r.id = n_regionkey AND r.id < 100) SELECT * FROM t UNION ALL SELECT * FROM (VALUES (900, NULL), (901, NULL), (902, NULL), (903, 'solo')) AS c(id, path)")
def folder_paths(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, sf, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    cycle = spark.sql("SELECT * FROM VALUES (900, 901, 'a'), (901, 900, 'b'), (902, 900, 'c'), (903, 999, 'solo') AS t(id, parent, name)")
    return G.folder_paths(r.unionByName(n).unionByName(cycle))


# --- Matching -------------------------------------------------------------------------------------------

ITEMS = "SELECT p_partkey AS item_id, 'LEY-' || (p_size * 1000) AS document_key, 'LEY' AS tipo, (p_size * 1000)::VARCHAR AS numero, NULL AS anio, p_name AS titulo, 'http://x.pe/' || p_brand AS source_url FROM part"


LEFT_ITEMS = """SELECT p_partkey AS item_id, CASE p_partkey % 6 WHEN 0 THEN 'DS-' || p_partkey || '-' || y WHEN 1 THEN 'DS-0' || p_partkey || '-' || y || '-SA' WHEN 2 THEN 'DS-' || (p_partkey + 1000000) || '-' || y WHEN 3 THEN 'X' END AS document_key, CASE WHEN p_partkey % 6 IN (0, 2) THEN 'DS' END AS tipo, CASE p_partkey % 6 WHEN 0 THEN CAST(p_partkey AS STRING) WHEN 2 THEN CAST(p_partkey + 1000000 AS STRING) END AS numero, CASE WHEN p_partkey % 6 IN (0, 2) THEN CAST(y AS STRING) END AS anio,
  CASE p_partkey % 6 WHEN 0 THEN 'Norma ' || p_name || ' ' || p_partkey WHEN 1 THEN 'Otra ' || p_partkey WHEN 2 THEN 'Nueva ' || p_partkey WHEN 3 THEN 'Nada' WHEN 4 THEN 'NORMA:  ' || p_name || ' ' || p_partkey END AS titulo, CASE p_partkey % 6 WHEN 0 THEN 'http://x.pe/e/' || p_partkey WHEN 1 THEN 'http://x.pe/z/' || p_partkey WHEN 2 THEN 'http://x.pe/v/' || p_partkey WHEN 3 THEN 'HTTP://X.pe/e/' || p_partkey || '/?q=1' END AS source_url FROM (SELECT *, 2000 + p_partkey % 25 AS y FROM {part}) AS x"""
RIGHT_ITEMS = """SELECT 'DS-' || p_partkey || '-' || y AS document_key, 'DS' AS tipo, CAST(p_partkey AS STRING) AS numero, CAST(y AS STRING) AS anio, 'norma ' || p_name || ' ' || p_partkey AS titulo, 'http://x.pe/e/' || p_partkey AS source_url FROM (SELECT *, 2000 + p_partkey % 25 AS y FROM {part}) AS x WHERE p_partkey % 4 <> 3"""


def _reasons_sql(left: str, right: str) -> str:
    """CTEs to ``h(item_id, o, reason)`` by a join for each reason, and ``c(item_id, reasons, action)``."""
    side = lambda rows: f"""(SELECT *, 'DS-' || n || coalesce('-' || y, '') AS key FROM (SELECT *, coalesce(numero, nullif(k.n, '')) AS n, nullif(regexp_extract(coalesce(anio, k.y, ''), '((?:19|20)[0-9]{{2}})', 1), '') AS y FROM (
    SELECT *, regexp_extract(document_key, '^DS-0*([0-9]+)-([0-9]+)', ['n', 'y']) AS k, lower(regexp_extract(source_url, '^([a-zA-Z]+://[^/?#]*)', 1)) || regexp_replace(regexp_replace(regexp_extract(source_url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '/{{2,}}', '/', 'g') AS u,
    trim(regexp_replace(regexp_replace(lower(titulo), '[^a-z0-9áéíóúüñ ]+', ' ', 'g'), ' +', ' ', 'g')) AS t FROM ({rows}))))"""  # noqa: E731
    return f"""l AS {side(left)}, r AS {side(right)},
  h AS (SELECT item_id, 1 AS o, 'exact_document_key' AS reason FROM l JOIN (SELECT DISTINCT document_key FROM r) USING (document_key) UNION SELECT item_id, 2, 'normalized_key' FROM l JOIN (SELECT DISTINCT key FROM r) USING (key) UNION SELECT item_id, 3, 'type_number_year' FROM l JOIN (SELECT DISTINCT n, y FROM r) USING (n, y)
    UNION SELECT item_id, 5, 'source_url' FROM l JOIN (SELECT DISTINCT u FROM r) USING (u) UNION SELECT item_id, 6, 'title_similarity' FROM l JOIN (SELECT DISTINCT t, y AS y2 FROM r) USING (t) WHERE y IS NULL OR y2 IS NULL OR y = y2),
  g AS (SELECT l.item_id, coalesce(string_agg(reason, ',' ORDER BY o), '') AS reasons, coalesce(bool_or(reason <> 'title_similarity'), false) AS strong, any_value(n) AS n, any_value(y) AS y FROM l LEFT JOIN h USING (item_id) GROUP BY l.item_id),
  c AS (SELECT item_id, reasons, CASE WHEN starts_with(reasons, 'exact_document_key') THEN 'skipped_exact_existing' WHEN strong THEN 'skipped_possible_duplicate' WHEN n IS NULL OR y IS NULL THEN 'skipped_insufficient_data' ELSE 'new_candidate' END AS action FROM g)"""


_REASONS = _reasons_sql(LEFT_ITEMS, RIGHT_ITEMS)


LISTED = """SELECT p_partkey AS item_id, 'DS-' || p_size || '-' || y AS document_key, 'DS' AS tipo, CAST(p_size AS STRING) AS numero, y AS anio, p_name AS titulo, 'http://x.pe/' || p_brand AS source_url FROM (SELECT *, '2' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') AS y FROM {part}) AS x"""
_HALVES = _reasons_sql(f"SELECT * FROM ({LISTED}) WHERE item_id % 2 = 0", f"SELECT document_key, tipo, numero, anio, titulo, source_url FROM ({LISTED}) WHERE item_id % 2 = 1")


@query("import_classify", f"WITH {_HALVES} SELECT item_id, tipo, n AS numero, y AS anio, key AS normalized_key, reasons, action FROM c JOIN l USING (item_id)")
def import_classify(spark, sf):
    """FLT16, JON7, JON8: one half of a listing against the other."""
    rows = derived(spark, sf, LISTED)
    return M.classified_items(rows.filter("item_id % 2 = 0"), rows.filter("item_id % 2 = 1").drop("item_id"))


@query("import_reasons", f"WITH {_REASONS} SELECT * FROM c")
def import_reasons(spark, sf):
    return M.classified_items(derived(spark, sf, LEFT_ITEMS), derived(spark, sf, RIGHT_ITEMS)).select("item_id", "reasons", "action")


@query("action_summary", f"""WITH {_REASONS} SELECT count(*) AS total, count(*) FILTER (action = 'skipped_exact_existing') AS existing, count(*) FILTER (action = 'skipped_possible_duplicate') AS possible, count(*) FILTER (action = 'new_candidate') AS new_candidates, count(*) FILTER (action = 'skipped_insufficient_data') AS insufficient FROM c""")
def action_summary(spark, sf):
    return R.action_summary(import_reasons(spark, sf))


_CAND = """WITH f AS (SELECT p_partkey AS file_id, p_brand AS k, p_name AS n FROM part), r AS (SELECT s_suppkey AS id, 'BRAND#' || (s_suppkey % 60) AS rk, s_name AS rn, 'LISTA ' || s_nationkey || ' (Brand#' || (s_suppkey % 60) || '.)' AS rt, s_suppkey * 7 AS did FROM supplier),
s AS (SELECT file_id, id, 100 * (file_id = did)::INT + 60 * (upper(k) = upper(rk))::INT + 40 * (upper(n) = upper(rn))::INT + 20 * contains(upper(rt), upper(k))::INT + 10 * (contains(upper(rn), upper(n)) OR contains(upper(n), upper(rn)))::INT AS score FROM f JOIN r ON file_id = did OR upper(k) = upper(rk) OR upper(n) = upper(rn) OR contains(upper(rk || ' ' || rn || ' ' || rt), upper(k)) OR contains(upper(rk || ' ' || rn || ' ' || rt), upper(n)))"""


def _files(spark, sf):
    """Parts as files, suppliers as rows of the catalogue: both whole; keys stand beside marks and inside longer ones."""
    f = table(spark, sf, "part").select(F.col("p_partkey").alias("file_id"), F.col("p_brand").alias("key"), F.col("p_name").alias("name"))
    brand = F.concat(F.lit("BRAND#"), F.col("s_suppkey") % 60)
    title = F.concat(F.lit("LISTA "), F.col("s_nationkey"), F.lit(" (Brand#"), F.col("s_suppkey") % 60, F.lit(".)"))
    r = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), brand.alias("document_key"), F.col("s_name").alias("file_name"), title.alias("title"), (F.col("s_suppkey") * 7).alias("drive_file_id"))
    return f, r


@query("scored_match", _CAND + " SELECT file_id, id, score FROM s WHERE score >= 20")
def scored_match(spark, sf):
    f, r = _files(spark, sf)
    return M.scored_candidates(f, r)


@query("ambiguity_rule", _CAND + """, w AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY score DESC, id) AS n, lead(score) OVER (PARTITION BY file_id ORDER BY score DESC, id) AS s2 FROM s WHERE score >= 20)
SELECT f.file_id, CASE WHEN s2 IS NULL OR score >= s2 + 20 THEN id END AS id, CASE WHEN id IS NULL THEN 'drive_only' WHEN s2 IS NULL OR score >= s2 + 20 THEN 'matched' ELSE 'manual_review' END AS state FROM f LEFT JOIN (SELECT * FROM w WHERE n = 1) w USING (file_id)""")
def ambiguity_rule(spark, sf):
    f, r = _files(spark, sf)
    return M.best_matches(f, r)


@query("unreferenced_rows", "WITH f AS (SELECT s_suppkey * 7 AS file_id, 'BRAND#' || (s_suppkey % 25) AS k, s_name AS n FROM supplier) SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT file_id FROM f) AND upper(p_brand) NOT IN (SELECT upper(k) FROM f) AND upper(p_name) NOT IN (SELECT upper(n) FROM f)")
def unreferenced_rows(spark, sf):
    f = table(spark, sf, "supplier").select((F.col("s_suppkey") * 7).alias("file_id"), F.concat(F.lit("BRAND#"), F.col("s_suppkey") % 25).alias("key"), F.col("s_name").alias("name"))
    r = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("document_key"), F.col("p_name").alias("file_name"), F.col("p_partkey").alias("drive_file_id"))
    return M.unreferenced(r, f).select("id")


@query("duplicate_keys", "SELECT upper(p_brand) AS key, count(*) AS files, array_to_string(list_sort(list(p_partkey)), ',') AS file_ids FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("file_id"))
    return M.repeated_keys(p).select("key", "files", F.array_join("file_ids", ",").alias("file_ids"))


RELS = """SELECT c_custkey AS relation_id, CASE c_custkey % 4 WHEN 0 THEN 'DS' WHEN 1 THEN 'RM' WHEN 2 THEN 'LEY' END AS tipo, CASE c_custkey % 3 WHEN 0 THEN lpad(CAST(c_custkey % 120 AS STRING), 3, '0') || '-2011' WHEN 1 THEN CAST(c_custkey % 120 AS STRING) END AS numero, 1990 + c_nationkey AS anio FROM {customer}"""
NORMS = """SELECT 'n' || p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'DS-' ELSE 'RM-' END || (p_partkey % 120) || '-' || (1990 + p_partkey % 25) AS document_key, CASE p_partkey % 2 WHEN 0 THEN '00' || (p_partkey % 120) ELSE (p_partkey % 120) || '-2011-SA' END AS numero, 1990 + p_partkey % 25 AS anio FROM {part}"""


@query("resolve_affected", f"""WITH r AS (SELECT *, regexp_extract(coalesce(numero, ''), '(\\d+)', 1) AS num FROM ({RELS})), n AS (SELECT *, regexp_extract(numero, '(\\d+)', 1) AS num FROM ({NORMS}))
SELECT relation_id, coalesce((SELECT min(id) FROM n WHERE n.document_key = upper(r.tipo) || '-' || try_cast(r.num AS INT) || '-' || r.anio), (SELECT min(id) FROM n WHERE n.anio = r.anio AND try_cast(n.num AS INT) = try_cast(r.num AS INT))) AS affected_id FROM r""")
def resolve_affected(spark, sf):
    return M.resolved(derived(spark, sf, RELS), derived(spark, sf, NORMS)).select("relation_id", "affected_id")


@query("nearest_join", "SELECT c_custkey, (SELECT s_suppkey FROM supplier WHERE s_nationkey = c_nationkey ORDER BY abs(s_acctbal - c_acctbal), s_suppkey LIMIT 1) AS s_suppkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def nearest_join(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("g"), F.col("c_acctbal").alias("y"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("center"))
    return M.nearest(c, s, "g", tie="s_suppkey").select("c_custkey", "s_suppkey").filter("s_suppkey IS NOT NULL")


BLOCKS = """SELECT s_nationkey AS g, s_suppkey AS block_id, s_acctbal AS center, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal - 10 * (s_suppkey % 30) END AS b_start, CASE WHEN s_suppkey % 5 <> 0 THEN s_acctbal + 300 END AS b_end FROM {supplier}"""
POINTS = """SELECT c_custkey AS id, c_nationkey AS g, c_acctbal AS y FROM {customer}"""


@query("interval_first_join", f"""WITH b AS (SELECT g, block_id, center AS c, coalesce(b_start, center) AS s, coalesce(b_end, center) AS e FROM ({BLOCKS})), p AS ({POINTS}),
held AS (SELECT id, arg_min(block_id, (c, block_id)) AS inside FROM p JOIN b USING (g) WHERE y BETWEEN s - 6 AND e + 6 GROUP BY id),
before AS (SELECT id, max(c) AS pc, arg_max(e, (c, block_id)) AS pe FROM p JOIN b USING (g) WHERE c < y GROUP BY id), first AS (SELECT id, min(block_id) AS pb FROM before JOIN p USING (id) JOIN b ON b.g = p.g AND b.c = pc GROUP BY id),
behind AS (SELECT id, arg_min(block_id, (c, block_id)) AS nb, min(c) AS nc, arg_min(s, (c, block_id)) AS ns FROM p JOIN b USING (g) WHERE c >= y GROUP BY id)
SELECT p.id, coalesce(inside, CASE WHEN nb IS NOT NULL AND (y <= ns AND ns - y <= 45 OR pc IS NOT NULL AND y BETWEEN pe AND ns) THEN nb END, CASE WHEN pc IS NULL THEN nb WHEN nb IS NULL OR y - pc <= nc - y THEN pb ELSE nb END) AS block_id
FROM p LEFT JOIN held USING (id) LEFT JOIN before USING (id) LEFT JOIN first USING (id) LEFT JOIN behind USING (id)""")
def interval_first_join(spark, sf):
    b = derived(spark, sf, BLOCKS).select("g", "block_id", F.col("center").cast("double"), F.col("b_start").cast("double").alias("start"), F.col("b_end").cast("double").alias("end"))
    return M.interval_first(derived(spark, sf, POINTS).withColumn("y", F.col("y").cast("double")), b, "g").select("id", "block_id")


PLACES = """SELECT s_nationkey AS g, s_acctbal + 20 * (s_suppkey % 3) AS cy, s_suppkey % 3 AS priority, s_name AS country FROM {supplier}"""


@query("near_country", f"""WITH p AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'x' END AS extra FROM ({POINTS})), c AS ({PLACES})
SELECT id, extra, (SELECT country FROM c WHERE c.g = p.g AND abs(cy - y) <= 45 ORDER BY abs(cy - y), priority, country LIMIT 1) AS country FROM p""")
def near_country(spark, sf):
    c = derived(spark, sf, PLACES).withColumn("cy", F.col("cy").cast("double"))
    points = derived(spark, sf, POINTS).withColumn("y", F.col("y").cast("double")).withColumn("extra", F.when(F.col("id") % 2 == 0, "x"))
    return M.near_country(points, c, "g").select("id", "extra", "country")


LINKS = """SELECT page_id AS id, CASE page_id % 6 WHEN 0 THEN url || '/archivos/a.pdf' WHEN 1 THEN url || '/ver' WHEN 2 THEN 'http://x.pe/uploads/' || page_id || '.PDF?x=1' WHEN 3 THEN NULL ELSE url END AS url, CASE page_id % 5 WHEN 0 THEN ' PDF ' WHEN 1 THEN 'Descargar documento' WHEN 2 THEN 'Ver más' WHEN 3 THEN NULL ELSE 'c' END AS t_ FROM {pages}"""


@query("link_score", f"""SELECT id, (10 * regexp_matches(u, '[.]pdf')::INT + 6 * regexp_matches(u, '/uploads?/|/archivos/|/files?/')::INT + 2 * (t = 'pdf')::INT + list_sum(list_transform(['pdf', 'descargar', 'documento', 'ver'], lambda h: 4 * (contains(t, h) OR contains(u, h))::INT)))::INTEGER AS score
FROM (SELECT id, lower(coalesce(url, '')) AS u, lower(trim(coalesce(t_, ''))) AS t FROM ({LINKS}))""")
def link_score(spark, sf):
    return derived(spark, sf, LINKS).select("id", M.link_score(F.col("url"), F.col("t_")).alias("score"))


# --- Reports --------------------------------------------------------------------------------------------


def _norms(spark, sf):
    d = table(spark, sf, "documents").select(F.col("source").alias("id")).distinct()
    extra = spark.sql("SELECT 'src_none' AS id")
    return d.unionByName(extra)


_SUMMARY = f"WITH {PAGES_SQL}, n AS (SELECT DISTINCT source AS id FROM documents UNION ALL SELECT 'src_none'), s AS (SELECT norma_id, count(*) AS total_paginas, {COUNTS_SQL} FROM (SELECT *, quality_score AS q FROM pages) GROUP BY 1)"
_NUMBERS = "total_paginas calidad_alta calidad_media calidad_baja calidad_baja_sin_revisar tablas_total tablas_sin_verificar formulas graficos revisadas_manual via_ocr".split()


@query("norm_summary", f"{_SUMMARY} SELECT n.id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _NUMBERS)} FROM n LEFT JOIN s ON n.id = s.norma_id")
def norm_summary(spark, sf):
    return R.norm_summary(_norms(spark, sf), norm_pages(spark, sf), LOW, HIGH)


@query("fidelity_global", f"WITH {PAGES_SQL} SELECT count(*) AS total_paginas, {COUNTS_SQL} FROM (SELECT *, quality_score AS q FROM pages)")
def fidelity_global(spark, sf):
    return R.fidelity_global(norm_pages(spark, sf), LOW, HIGH)


@query("fidelity_per_norm", f"WITH {PAGES_SQL} SELECT norma_id, count(*) AS total_paginas, {COUNTS_SQL} FROM (SELECT *, coalesce(CASE WHEN doc_id % 5 <> 0 THEN quality_score END, 0) AS q FROM pages) GROUP BY 1")
def fidelity_per_norm(spark, sf):
    return R.fidelity_of_norms(norm_pages(spark, sf).withColumn("quality_score", F.when(F.col("doc_id") % 5 != 0, F.col("quality_score"))), LOW, HIGH)


@query("norm_verdict", f"""{_SUMMARY} SELECT n.id AS document_key, CASE WHEN n.id = 'src3' THEN 0 WHEN coalesce(total_paginas, 0) = 0 THEN 1 WHEN n.id = 'src4' THEN 1 WHEN calidad_baja_sin_revisar > 0 OR formulas > 0 OR graficos > 0 THEN 2
  WHEN tablas_sin_verificar > 0 OR via_ocr > 0 OR calidad_media > 0 THEN 3 ELSE 4 END AS prioridad FROM n LEFT JOIN s ON n.id = s.norma_id""")
def norm_verdict(spark, sf):
    s = norm_summary(spark, sf).withColumns({"document_key": F.col("id"), "pdf_url": F.when(F.col("id") != "src3", "u"), "file_storage_path": F.lit(None).cast("string"), "process_status": F.when(F.col("id") == "src4", "text_extraction_error").otherwise("text_extracted")})
    return R.verdict(s).select("document_key", "prioridad")


_ST = "CASE o_orderstatus WHEN 'F' THEN 'text_extracted' WHEN 'P' THEN 'text_extraction_error' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'registered' END END"


@query("status_census", f"WITH n AS (SELECT {_ST} AS s, CASE WHEN o_custkey % 3 <> 0 THEN 'u' ELSE '' END AS p FROM orders) SELECT count(*) AS total, count(*) FILTER (s = 'text_extracted') AS with_text, count(*) FILTER ((s IS NULL OR s = 'registered') AND p <> '') AS pending_with_pdf, count(*) FILTER (s = 'text_extraction_error' AND p <> '') AS errors_with_pdf, count(*) FILTER (s IS DISTINCT FROM 'text_extracted' AND p = '') AS no_pdf_no_text FROM n")
def status_census(spark, sf):
    return R.status_census(table(spark, sf, "orders").select(F.expr(_ST).alias("process_status"), F.when(F.col("o_custkey") % 3 != 0, "u").otherwise("").alias("pdf_url")))


@query("certainty_level", f"""WITH {PAGES_SQL}, c AS (SELECT norma_id, avg(quality_score) AS m, count(*) FILTER (quality_score < 0.95) AS low, coalesce(bool_or(extraction_method LIKE '%ocr%'), false) AS o, coalesce(bool_or(has_tables), false) AS t, coalesce(bool_or(posible_formula OR posible_grafico), false) AS f FROM pages GROUP BY 1)
SELECT norma_id, round(m, 6) AS mean_quality, low AS low_pages, CASE WHEN m >= 0.95 THEN 'text_extracted' ELSE 'text_extracted_baja_calidad' END AS status, CASE WHEN low > 0 OR m < 0.95 THEN 'baja' WHEN m < 0.99 OR o OR t OR f THEN 'media' ELSE 'alta' END AS certainty FROM c""")
def certainty_level(spark, sf):
    return R.certainty(norm_pages(spark, sf), LOW, HIGH).select("norma_id", F.round("mean_quality", 6).alias("mean_quality"), "low_pages", "status", "certainty")


@query("counts_by_type", "SELECT coalesce(nullif(CASE WHEN doc_id % 9 = 0 THEN '' ELSE lang END, ''), 'SIN_TIPO') AS value, count(*) AS n FROM documents GROUP BY 1")
def counts_by_type(spark, sf):
    return R.counts_by(table(spark, sf, "documents").withColumn("tipo", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("lang"))), "tipo", "SIN_TIPO")


@query("extraction_summary", """WITH a AS (SELECT l_orderkey AS n, l_linenumber AS id, 3 AS p, (l_quantity::INT % 4)::INT AS t, (l_linenumber % 2)::INT AS o, (l_tax > 0.07)::INT AS e, l_returnflag = 'A' AS h FROM lineitem)
SELECT n AS norma_id, count(*) AS assets, sum(p)::BIGINT AS pages, sum(t)::BIGINT AS text_pages, sum(o)::BIGINT AS ocr_pages, sum(e)::BIGINT AS errors, bool_or(h) AS has_tables, CASE WHEN sum(e) > 0 THEN 'error' WHEN sum(t) = 0 THEN 'ocr_required' WHEN sum(t) < sum(p) THEN 'partial_text' WHEN sum(o) > 0 THEN 'text_extracted_ocr' ELSE 'text_extracted' END AS status FROM a GROUP BY 1""")
def extraction_summary(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("norma_id"), F.col("l_linenumber").alias("asset_id"), F.lit(3).alias("pages"), (F.col("l_quantity").cast("int") % 4).alias("text_pages"), (F.col("l_linenumber") % 2).alias("ocr_pages"), (F.col("l_tax") > 0.07).cast("int").alias("errors"), (F.col("l_returnflag") == "A").alias("has_tables"), F.lit("f").alias("file_name"))
    return R.extraction_summary(l).drop("first_file")


@query("operation_rollup", "SELECT split_part(event_type, '_', 1) AS family, count(*) AS operations, count(DISTINCT user_id) AS documents FROM events GROUP BY 1")
def operation_rollup(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("document_key"), F.array("event_type").alias("operations"))
    return R.operation_rollup(e)


_PLAN = "CASE c_mktsegment WHEN 'BUILDING' THEN 'basico' WHEN 'MACHINERY' THEN 'consultoria' WHEN 'AUTOMOBILE' THEN 'empresarial' ELSE 'gratis' END"
_SUBS = f"SELECT c_custkey AS telegram_chat_id, {_PLAN} AS nivel, CASE WHEN c_custkey % 5 = 0 THEN 'pendiente_pago' WHEN c_custkey % 7 = 0 THEN 'cancelado' ELSE 'activo' END AS estado, DATE '1997-01-01' + ((c_custkey % 400)::INT) AS fecha_fin, DATE '1996-06-01' + ((c_custkey % 60)::INT) AS fecha_inicio FROM customer"


def _subscriptions(spark, sf):
    c = table(spark, sf, "customer")
    state = F.when(F.col("c_custkey") % 5 == 0, "pendiente_pago").when(F.col("c_custkey") % 7 == 0, "cancelado").otherwise("activo")
    plan = F.expr(_PLAN)
    return c.select(F.col("c_custkey").alias("telegram_chat_id"), plan.alias("nivel"), state.alias("estado"), F.expr("date_add(DATE '1997-01-01', cast(c_custkey % 400 as int))").alias("fecha_fin"), F.expr("date_add(DATE '1996-06-01', cast(c_custkey % 60 as int))").alias("fecha_inicio"))


def _users(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("telegram_chat_id"), F.when(F.col("c_custkey") % 4 == 0, "activa").when(F.col("c_custkey") % 4 == 1, "finalizada").alias("prueba_estado"), (F.col("c_custkey") % 11 == 0).alias("plan_gratis_legado"), F.col("c_name").alias("nombre"))


_USERS = "SELECT c_custkey AS telegram_chat_id, CASE WHEN c_custkey % 4 = 0 THEN 'activa' WHEN c_custkey % 4 = 1 THEN 'finalizada' END AS prueba_estado, c_custkey % 11 = 0 AS plan_gratis_legado, c_name AS nombre FROM customer"
_TODAY = "DATE '1997-08-01'"
_EFF = f"CASE WHEN s.estado = 'activo' AND s.fecha_fin < {_TODAY} THEN 'vencido' ELSE s.estado END"


@query("access_tier", f"SELECT u.telegram_chat_id, CASE WHEN s.estado = 'activo' AND (s.fecha_fin IS NULL OR s.fecha_fin >= {_TODAY}) THEN s.nivel ELSE 'gratis' END AS nivel, u.plan_gratis_legado OR coalesce(u.prueba_estado = 'activa', false) OR (s.estado = 'activo' AND s.fecha_fin >= {_TODAY} AND s.nivel <> 'gratis') AS acceso FROM ({_USERS}) u LEFT JOIN ({_SUBS}) s USING (telegram_chat_id)")
def access_tier(spark, sf):
    return R.access(_users(spark, sf), _subscriptions(spark, sf), F.expr(_TODAY))


@query("directory_segments", f"""SELECT u.telegram_chat_id, CASE WHEN {_EFF} = 'activo' THEN 'plan_activo' WHEN u.prueba_estado = 'activa' THEN 'prueba_activa' WHEN u.plan_gratis_legado THEN 'gratis_permanente' WHEN {_EFF} = 'vencido' THEN 'vencido' WHEN {_EFF} = 'cancelado' THEN 'cancelado' WHEN {_EFF} = 'pendiente_pago' THEN 'pago_pendiente' WHEN u.prueba_estado = 'finalizada' THEN 'prueba_finalizada' ELSE 'sin_nada' END AS segmento
FROM ({_USERS}) u LEFT JOIN (SELECT * FROM ({_SUBS}) WHERE telegram_chat_id % 3 <> 0) s USING (telegram_chat_id)""")
def directory_segments(spark, sf):
    return R.directory(_users(spark, sf), _subscriptions(spark, sf).filter("telegram_chat_id % 3 != 0"), F.expr(_TODAY))


@query("subscription_census", f"SELECT {_EFF} AS estado_efectivo, CASE WHEN {_EFF} = 'activo' THEN nivel END AS nivel, count(*) AS n FROM ({_SUBS}) s GROUP BY 1, 2")
def subscription_census(spark, sf):
    return R.subscription_census(_subscriptions(spark, sf), F.expr(_TODAY))


@query("follow_up", f"SELECT telegram_chat_id, nivel, {_EFF} AS estado_efectivo FROM ({_SUBS}) s WHERE {_EFF} IN ('pendiente_pago', 'vencido') ORDER BY telegram_chat_id LIMIT 20")
def follow_up(spark, sf):
    return R.follow_up(_subscriptions(spark, sf), F.expr(_TODAY)).select("telegram_chat_id", "nivel", "estado_efectivo")


@query("memberships", f"SELECT s.telegram_chat_id, {_EFF} AS seccion, coalesce(u.nombre, s.telegram_chat_id::VARCHAR) AS referencia, nivel FROM ({_SUBS}) s LEFT JOIN (SELECT * FROM ({_USERS}) WHERE telegram_chat_id % 2 = 0) u USING (telegram_chat_id)")
def memberships(spark, sf):
    s = _subscriptions(spark, sf).withColumn("telegram_username", F.lit(None).cast("string"))
    return R.memberships(s, _users(spark, sf).filter("telegram_chat_id % 2 = 0"), F.expr(_TODAY))


@query("latest_subscription", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_subscription(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return R.latest_per(o, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("revenue_month", f"SELECT nivel, count(*) AS cantidad, (count(*) * CASE nivel WHEN 'basico' THEN 29 WHEN 'consultoria' THEN 79 WHEN 'empresarial' THEN 199 ELSE 0 END)::BIGINT AS subtotal FROM ({_SUBS}) WHERE nivel <> 'gratis' AND date_trunc('month', fecha_inicio) = DATE '1996-07-01' GROUP BY nivel")
def revenue_month(spark, sf):
    return R.revenue(_subscriptions(spark, sf), F.expr("DATE '1996-07-01'"))


@query("payments_month", "SELECT round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS total_confirmado, count(*) FILTER (o_orderstatus = 'F') AS confirmados, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 0), 2) AS total_pendiente, count(*) FILTER (o_orderstatus = 'P') AS pendientes, count(*) FILTER (o_orderstatus = 'O') AS rechazados FROM orders WHERE date_trunc('month', o_orderdate - INTERVAL 5 HOUR) = DATE '1996-03-01'")
def payments_month(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_totalprice").alias("monto_esperado"), F.expr("CASE o_orderstatus WHEN 'F' THEN 'confirmado' WHEN 'P' THEN 'pendiente' ELSE 'rechazado' END").alias("estado"), F.col("o_orderdate").alias("creado_at"))
    r = R.payments(o, F.expr("DATE '1996-03-01'"))
    return r.withColumns({c: F.round(c, 2) for c in ("total_confirmado", "total_pendiente")})


@query("daily_quota", "WITH o AS (SELECT (ts - INTERVAL 5 HOUR)::DATE AS dia, user_id AS chat_id, count(*) AS consultas FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT *, (sum(consultas) OVER (PARTITION BY dia))::BIGINT AS global FROM o")
def daily_quota(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("chat_id"), F.col("event_type").alias("command"), F.col("ts").alias("created_at"))
    return R.daily_usage(e, "view")


_QP = "CASE user_id % 4 WHEN 0 THEN 'gratis' WHEN 1 THEN 'basico' WHEN 2 THEN 'consultoria' ELSE 'empresarial' END"


@query("quota_decisions", f"""WITH e AS (SELECT event_id AS id, user_id AS chat_id, (ts - INTERVAL 5 HOUR)::DATE AS dia, {_QP} AS plan, row_number() OVER (PARTITION BY (ts - INTERVAL 5 HOUR)::DATE ORDER BY ts, event_id) AS g, row_number() OVER (PARTITION BY (ts - INTERVAL 5 HOUR)::DATE, user_id ORDER BY ts, event_id) AS o FROM events)
SELECT id, chat_id, dia, CASE WHEN g > 300 THEN 'global_limit' WHEN o > CASE plan WHEN 'gratis' THEN 5 WHEN 'basico' THEN 30 WHEN 'consultoria' THEN 100 END THEN 'own_limit' ELSE 'ok' END AS decision FROM e""")
def quota_decisions(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("chat_id"), F.lit("/consulta").alias("command"), F.col("ts").alias("created_at"), "user_id")
    return R.quota_decisions(e, "/consulta", F.expr(_QP))


@query("burn_rate", """WITH m AS (SELECT max(ts) AS now FROM events), e AS (SELECT user_id, event_id, ts, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events, m WHERE ts >= now - INTERVAL 14 DAY),
s AS (SELECT *, max(CASE WHEN value > p THEN row(ts, event_id) END) OVER (PARTITION BY user_id) AS since FROM e), t AS (SELECT * FROM s WHERE since IS NULL OR row(ts, event_id) >= since),
g AS (SELECT user_id, count(*) AS n, arg_min(value, row(ts, event_id)) AS f, arg_max(value, row(ts, event_id)) AS l, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM t GROUP BY 1)
SELECT user_id, round(CASE WHEN n >= 2 AND us > 0 AND f > l THEN l / ((f - l) / (us / 86400000000.0::DOUBLE)) END, 4) AS days_left FROM g""")
def burn_rate(spark, sf):
    e = table(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    h = e.select("user_id", F.col("event_id").alias("id"), "ts", F.col("value").alias("balance")).crossJoin(F.broadcast(now))  # one row
    return R.burn_rate(h, "user_id", F.col("now")).select("user_id", F.round("days_left", 4).alias("days_left"))


@query("staleness", "SELECT event_type, floor((epoch(TIMESTAMP '2024-02-03 12:00:00') - epoch(max(ts))) / 86400)::BIGINT AS days, floor((epoch(TIMESTAMP '2024-02-03 12:00:00') - epoch(max(ts))) / 86400) >= 5 AS stale FROM events GROUP BY event_type")
def staleness(spark, sf):
    return R.staleness(table(spark, sf, "events"), "ts", F.expr("TIMESTAMP '2024-02-03 12:00:00'"), by=("event_type",))


@query("doc_concat_cap", "SELECT conv_id, substr(string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (trim(text) <> ''), 1, 500) AS text FROM conversations GROUP BY conv_id")
def doc_concat_cap(spark, sf):
    return R.concatenated(table(spark, sf, "conversations"), "conv_id", "turn", "text", 500)


@query("export_summary", "SELECT source AS norma_id, lang AS asset_id, count(*) AS pages_exported, count(*) FILTER (doc_id % 2 = 0) AS ocr_pages, sum(length(text))::BIGINT AS total_chars FROM documents GROUP BY 1, 2")
def export_summary(spark, sf):
    return R.exported(table(spark, sf, "documents").select(F.col("source").alias("norma_id"), F.col("lang").alias("asset_id"), (F.col("doc_id") % 2 == 0).alias("ocr_used"), "text"))


@query("trial_counts", f"WITH s AS (SELECT o_custkey AS c, count(*) AS sent FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1) SELECT telegram_chat_id, (telegram_chat_id % 2 + coalesce(sent, 0))::BIGINT AS enviadas, CASE WHEN telegram_chat_id % 2 + coalesce(sent, 0) >= 3 THEN 'finalizada' ELSE prueba_estado END AS prueba_estado FROM ({_USERS}) LEFT JOIN s ON c = telegram_chat_id")
def trial_counts(spark, sf):
    sent = table(spark, sf, "orders").filter("o_orderkey % 5 = 0").groupBy(F.col("o_custkey").alias("telegram_chat_id")).agg(F.count(F.lit(1)).alias("sent"))
    return R.trial_counts(_users(spark, sf).withColumn("prueba_alertas_enviadas", F.col("telegram_chat_id") % 2), sent)


# --- Queues ---------------------------------------------------------------------------------------------


@query("pending_queue", "SELECT o_orderkey AS document_key FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0 ORDER BY o_orderdate, o_orderkey LIMIT 50")
def pending_queue(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_key"), F.col("o_orderstatus").alias("source_type"), F.when(F.col("o_orderkey") % 2 == 1, F.col("o_orderdate")).alias("notified_at"), F.col("o_orderdate").alias("created_at"))
    return U.pending_notification(o, "O").select("document_key")


_DOCQ = "SELECT doc_id AS document_id, 'k' || doc_id AS document_key, quality, toxic, n_chars FROM documents LEFT JOIN labels USING (doc_id)"


@query("limit_then_anti", f"SELECT document_id FROM (SELECT * FROM ({_DOCQ}) ORDER BY n_chars DESC, document_id LIMIT 100) WHERE document_id NOT IN (SELECT doc_id FROM labels)")
def limit_then_anti(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "n_chars")
    return U.without_pages(d, table(spark, sf, "labels").select(F.col("doc_id").alias("document_id")), 100, [F.col("n_chars").desc(), F.col("document_id")]).select("document_id")


@query("filter_then_limit", "SELECT o_orderkey::VARCHAR AS document_key FROM orders WHERE o_custkey % 3 <> 0 AND (o_orderstatus = 'O' OR o_orderkey % 7 = 0) ORDER BY year(o_orderdate) DESC, o_orderkey::VARCHAR LIMIT 40")
def filter_then_limit(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("document_key"), F.when(F.col("o_custkey") % 3 != 0, "u").alias("pdf_url"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("process_status"), F.year("o_orderdate").alias("anio"))
    return U.pending_norms(o, ["O"], 40).select("document_key")


@query("incomplete_rows", "SELECT o_orderkey AS document_key FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500) WHERE o_orderkey % 5 = 0 OR o_custkey % 4 = 0 OR o_orderstatus <> 'F'")
def incomplete_rows(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_key"), F.when(F.col("o_orderkey") % 5 == 0, "ALERTA").otherwise("Ibuprofeno").alias("title"), F.when(F.col("o_custkey") % 4 != 0, F.to_date("o_orderdate")).alias("published_date"), F.lit("x").alias("published_date_display"), F.lit("u").alias("file_url"), (F.col("o_orderstatus") == "F").alias("has_file"))
    return U.to_enrich(o.withColumn("document_key", F.col("document_key")), 500, [F.col("document_key")]).select("document_key")


@query("archive_candidates", "SELECT o_orderkey AS document_key FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate::DATE < DATE '1998-01-01' - 360 ORDER BY o_orderdate, o_orderkey LIMIT 100")
def archive_candidates(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_key"), F.col("o_orderdate").alias("published_date"), F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).alias("archived_at"))
    return U.archive_candidates(o, F.expr("DATE '1998-01-01'"), 12, 100).select("document_key")


@query("expired_trials", f"SELECT telegram_chat_id FROM ({_USERS}) WHERE prueba_estado = 'activa' AND TIMESTAMP '2024-01-01' + telegram_chat_id * INTERVAL 1 HOUR <= TIMESTAMP '2024-02-01' - INTERVAL 14 DAY")
def expired_trials(spark, sf):
    u = _users(spark, sf).withColumn("prueba_inicio", F.expr("TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, cast(telegram_chat_id as int))"))
    return U.expired_trials(u, F.expr("TIMESTAMP '2024-02-01'")).select("telegram_chat_id")


@query("reminder_eligible", f"""WITH p AS (SELECT telegram_chat_id, telegram_chat_id % 8 AS n, TIMESTAMP '1997-07-25' + (telegram_chat_id % 10) * INTERVAL 1 DAY AS since FROM ({_USERS})), s AS ({_SUBS})
SELECT telegram_chat_id FROM p WHERE n < 5 AND since <= TIMESTAMP '1997-08-01' - INTERVAL 2 DAY AND telegram_chat_id NOT IN (SELECT telegram_chat_id FROM s WHERE estado = 'activo' AND nivel <> 'gratis' AND fecha_fin >= {_TODAY})""")
def reminder_eligible(spark, sf):
    p = _users(spark, sf).select("telegram_chat_id", (F.col("telegram_chat_id") % 8).alias("recordatorios"), F.lit(None).cast("timestamp").alias("ultimo_recordatorio_at"), F.expr("TIMESTAMP '1997-07-25' + make_interval(0, 0, 0, cast(telegram_chat_id % 10 as int))").alias("referencia_at"))
    return U.reminder_due(p, _subscriptions(spark, sf), F.expr("TIMESTAMP '1997-08-01'"), F.expr(_TODAY)).select("telegram_chat_id")


@query("review_pages", f"WITH {PAGES_SQL} SELECT doc_id FROM pages WHERE (quality_score < 0.95 AND NOT coalesce(revisado_manual, false)) OR (has_tables AND NOT coalesce(tabla_verificada, false))")
def review_pages(spark, sf):
    return U.review_pages(norm_pages(spark, sf), "either", LOW).select("doc_id")


@query("broken_pdfs", "SELECT o_orderkey::VARCHAR AS document_key, CASE WHEN o_custkey % 9 = 0 THEN 'missing' ELSE 'broken' END AS need FROM orders WHERE o_custkey % 9 = 0 OR o_orderstatus = 'P' ORDER BY year(o_orderdate) DESC, o_orderkey::VARCHAR LIMIT 30")
def broken_pdfs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("document_key"), F.when(F.col("o_custkey") % 9 != 0, "u").alias("pdf_url"), F.when(F.col("o_orderstatus") == "P", "pdf_download_error").alias("process_status"), F.year("o_orderdate").alias("anio"))
    return U.broken_pdfs(o).select("document_key", "need")


@query("pending_storage", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 2 = 0 AND o_orderkey % 3 = 0")
def pending_storage(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("has_file"), F.when(F.col("o_custkey") % 2 == 0, "u").alias("file_url"), F.when(F.col("o_orderkey") % 3 != 0, "x").alias("file_storage_path"))
    return U.pending_target(o, "file_storage_path").select("o_orderkey")


ADMIT = """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'resolucion-ministerial' WHEN 1 THEN 'decreto-supremo' ELSE 'otros' END AS section, CASE o_orderkey % 8 WHEN 0 THEN 'Resolución Ministerial N° ' || o_custkey || '-2021' WHEN 1 THEN 'Decreto Supremo que aprueba ' || o_custkey WHEN 2 THEN 'Aprueba decreto supremo' WHEN 3 THEN 'Portal de trámites' WHEN 4 THEN 'Ley' WHEN 5 THEN 'Ley ' || o_custkey || ' de productos' WHEN 6 THEN 'Descripción: ' || o_orderstatus ELSE 'RM ' || o_custkey END AS title, 'x ' || o_orderstatus AS ctx,
  CASE o_orderkey % 5 WHEN 0 THEN 'http://x/resolucion-ministerial/a' WHEN 1 THEN 'http://x/ds ' ELSE 'http://x/' || o_custkey END AS url, o_orderkey % 7 < 4 AS dated, o_orderkey % 11 < 5 AS in_section, o_orderkey % 13 < 9 AS normative, o_custkey % 3 = 0 AS numbered, o_custkey % 17 = 0 AS listing FROM {orders}"""


@query("admission", f"""WITH a AS (SELECT *, translate(lower(title), 'áéíóú', 'aeiou') AS t, lower(url) AS u FROM ({ADMIT})), b AS (SELECT *, t || ' ' || ctx || ' ' || u AS words FROM a)
SELECT id, NOT (regexp_matches(lower(words), '{"|".join(U.BLOCKED)}') OR t IN ({", ".join(f"'{x}'" for x in U.CATEGORY_TITLES)}) OR starts_with(t, 'descripcion:') OR listing) AND (dated OR numbered)
  AND CASE section WHEN 'resolucion-ministerial' THEN normative AND (in_section OR regexp_matches(t || ' ' || u, 'resolucion ministerial|r[.]m[.]|rm ')) WHEN 'decreto-supremo' THEN normative AND starts_with(t, 'decreto supremo') AND (in_section OR regexp_matches(t || ' ' || u, 'decreto supremo|d[.]s[.]|ds ')) ELSE in_section OR normative END AS admitted FROM b""")
def admission(spark, sf):
    c = F.col
    return derived(spark, sf, ADMIT).select("id", U.admitted(c("section"), c("title"), c("ctx"), c("url"), c("dated"), c("in_section"), c("normative"), c("numbered"), c("listing")).alias("admitted"))


@query("blocked_pages", "SELECT page_id, page_id % 10 = 3 OR contains(lower(html), 'cf-browser-verification') AS blocked FROM pages")
def blocked_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.is_blocked(F.when(F.col("page_id") % 10 == 3, 429).otherwise(200), F.col("html")).alias("blocked"))


@query("open_uploads", "SELECT event_id FROM events WHERE ts + INTERVAL 30 MINUTE > TIMESTAMP '2024-01-15'")
def open_uploads(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("expira_en"))
    return U.still_open(e, F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).select("event_id")


@query("valid_documents", "SELECT page_id FROM pages WHERE page_id % 4 <> 0 AND coalesce(url, '') <> ''")
def valid_documents(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 4 != 0, "k").alias("document_key"), F.col("url").alias("detail_url")).filter(U.valid_document()).select("page_id")


@query("title_search", "SELECT p_partkey AS document_key FROM part WHERE contains(lower(p_name), '1') ORDER BY p_size DESC, p_partkey LIMIT 10")
def title_search(spark, sf):
    return U.titled(table(spark, sf, "part").select(F.col("p_partkey").alias("document_key"), F.col("p_name").alias("title"), F.col("p_size").alias("published_date")), " 1 ").select("document_key")


@query("latest_n", "SELECT o_orderkey AS document_key FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def latest_n(spark, sf):
    return U.newest(table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_key"), F.col("o_orderdate").alias("published_date")), 5).select("document_key")


@query("week_window", "WITH w AS (SELECT o_orderkey AS document_key, o_orderdate::DATE AS d FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1996-03-04' AND DATE '1996-03-10') SELECT document_key, (SELECT count(*) FROM w) AS total FROM w ORDER BY d DESC, document_key DESC LIMIT 10")
def week_window(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_key"), F.to_date("o_orderdate").alias("published_date"))
    return U.week_window(o, F.expr("DATE '1996-03-07'"), 10).select("document_key", "total")


@query("month_window", "SELECT o_orderkey AS document_key FROM orders WHERE date_trunc('month', o_orderdate) = DATE '1996-03-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def month_window(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_key"), F.col("o_orderdate").alias("published_date"))
    return U.month_window(o, F.expr("DATE '1996-03-07'")).select("document_key")


@query("recent_7d", "SELECT event_id AS document_key FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAY ORDER BY ts DESC, event_id DESC LIMIT 10")
def recent_7d(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("document_key"), F.col("ts").alias("created_at"), F.to_date("ts").alias("published_date"))
    return U.recent(e, F.expr("TIMESTAMP_NTZ '2024-01-30 00:00:00'"), 10).select("document_key")


# --- States ---------------------------------------------------------------------------------------------


@query("document_states", """SELECT event_id, CASE event_type WHEN 'view' THEN 'metadata_enriched' WHEN 'click' THEN 'text_extracted' WHEN 'purchase' THEN 'structured_extracted' ELSE s END AS alert_state,
  CASE WHEN s IN ('registered', 'pdf_detection_error') AND event_type = 'view' THEN 'pdf_detected' WHEN s IN ('registered', 'pdf_detection_error') AND event_type = 'click' THEN 'pdf_not_found' ELSE s END AS listing_state
FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'registered' WHEN event_id % 3 = 1 THEN 'pdf_detected' ELSE 'pdf_detection_error' END AS s FROM events)""")
def document_states(spark, sf):
    e = table(spark, sf, "events").withColumn("s", F.expr("CASE WHEN event_id % 3 = 0 THEN 'registered' WHEN event_id % 3 = 1 THEN 'pdf_detected' ELSE 'pdf_detection_error' END"))
    a = F.expr("CASE event_type WHEN 'view' THEN 'enriched' WHEN 'click' THEN 'text' WHEN 'purchase' THEN 'products' ELSE '-' END")
    b = F.expr("CASE event_type WHEN 'view' THEN 'pdf' WHEN 'click' THEN 'no_pdf' ELSE '-' END")
    return e.select("event_id", Z.moved(F.col("s"), a, Z.ALERT).alias("alert_state"), Z.moved(F.col("s"), b, Z.LISTING).alias("listing_state"))


@query("norm_states", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'text_extracted' WHEN 'P' THEN 'pdf_download_error' ELSE 'registered' END AS state FROM orders")
def norm_states(spark, sf):
    ev = F.expr("CASE o_orderstatus WHEN 'F' THEN 'good_text' WHEN 'P' THEN 'download_failed' ELSE '-' END")
    return table(spark, sf, "orders").select("o_orderkey", Z.moved(F.lit("registered"), ev, Z.NORM).alias("state"))


@query("trial_state", f"""SELECT telegram_chat_id, CASE WHEN e = 'start' AND prueba_estado IS NULL THEN 'activa' WHEN prueba_estado = 'activa' AND (n >= 3 OR since <= TIMESTAMP '2024-02-01' - INTERVAL 14 DAY) THEN 'finalizada' ELSE prueba_estado END AS state
FROM (SELECT *, CASE WHEN telegram_chat_id % 3 = 0 THEN 'start' ELSE 'none' END AS e, telegram_chat_id % 6 AS n, TIMESTAMP '2024-01-01' + telegram_chat_id * INTERVAL 1 HOUR AS since FROM ({_USERS}))""")
def trial_state(spark, sf):
    u = _users(spark, sf).withColumns({"e": F.when(F.col("telegram_chat_id") % 3 == 0, "start").otherwise("none"), "n": F.col("telegram_chat_id") % 6, "since": F.expr("TIMESTAMP '2024-01-01' + make_interval(0, 0, 0, 0, cast(telegram_chat_id as int))")})
    return u.select("telegram_chat_id", Z.trial_state(F.col("prueba_estado"), F.col("since"), F.col("n"), F.col("e"), F.expr("TIMESTAMP '2024-02-01'")).alias("state"))


_PAY = "CASE o_orderstatus WHEN 'F' THEN 'confirmado' WHEN 'P' THEN 'rechazado' ELSE 'pendiente' END"


@query("payment_state", f"SELECT o_orderkey, CASE WHEN s = 'pendiente' AND o_orderkey % 3 = 0 THEN 'confirmado' WHEN s = 'pendiente' AND o_orderkey % 3 = 1 THEN 'rechazado' ELSE s END AS state FROM (SELECT *, {_PAY} AS s FROM orders)")
def payment_state(spark, sf):
    d = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'confirmar' WHEN 1 THEN 'rechazar' END")
    return table(spark, sf, "orders").select("o_orderkey", Z.payment_state(F.expr(_PAY), d).alias("state"))


@query("activations", "SELECT o_custkey AS telegram_chat_id, arg_max(o_orderpriority, row(o_orderdate, o_orderkey)) AS nivel, 'activo' AS estado, DATE '1998-01-01' AS fecha_inicio, DATE '1998-01-31' AS fecha_fin FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def activations(spark, sf):
    o = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("chat_id"), F.col("o_orderpriority").alias("nivel"), F.col("o_orderdate").alias("creado_at"), F.col("o_orderkey").alias("id"))
    return Z.activated(o, F.expr("DATE '1998-01-01'"))


INVITES = """SELECT 'c' || c_custkey AS codigo, CASE WHEN c_custkey % 6 = 0 THEN 'usada' ELSE 'pendiente' END AS estado, CASE c_custkey % 2 WHEN 0 THEN '9' || c_custkey ELSE '' END AS telefono, CASE WHEN c_custkey % 7 <> 0 THEN 'Ana ' || c_custkey END AS nombre FROM {customer}"""
USED = """SELECT 'c' || c_custkey AS codigo, c_custkey AS telegram_chat_id FROM {customer} WHERE c_custkey % 3 <> 1"""
GUESTS = """SELECT c_custkey AS telegram_chat_id, CASE WHEN c_custkey % 3 <> 0 THEN '5' || c_custkey END AS telefono, CASE WHEN c_custkey % 4 <> 0 THEN c_name END AS nombre, c_custkey % 5 = 0 AS plan_gratis_legado FROM {customer}"""


@query("invitations", f"""SELECT g.telegram_chat_id, coalesce(nullif(i.telefono, ''), g.telefono) AS telefono, coalesce(nullif(i.nombre, ''), g.nombre) AS nombre, g.plan_gratis_legado OR i.codigo IS NOT NULL AS plan_gratis_legado FROM ({GUESTS}) g LEFT JOIN (SELECT * FROM ({USED}) JOIN ({INVITES}) USING (codigo) WHERE estado = 'pendiente') i USING (telegram_chat_id)""")
def invitations(spark, sf):
    return Z.used_invitations(derived(spark, sf, GUESTS), derived(spark, sf, INVITES), derived(spark, sf, USED))


REL = """SELECT c_custkey AS relation_id, CASE WHEN c_custkey % 7 = 0 THEN 'confirmada' ELSE 'pendiente' END AS estado, CASE c_custkey % 3 WHEN 0 THEN 'deroga' WHEN 1 THEN 'modifica' ELSE 'deja_sin_efecto' END AS tipo_relacion, CASE WHEN c_custkey % 4 <> 0 THEN 'DS' END AS tipo, CASE WHEN c_custkey % 4 <> 0 THEN '0' || (1 + c_custkey % 50) END AS numero, CASE WHEN c_custkey % 4 <> 0 THEN 1990 + c_nationkey END AS anio, 'Norma ' || c_custkey AS descripcion, CASE WHEN c_custkey % 5 = 0 THEN 'n' || (c_custkey % 40) END AS affected_id FROM {customer}"""
DEC = """SELECT c_custkey AS relation_id, CASE WHEN c_custkey % 6 < 4 THEN 'confirmar' ELSE 'rechazar' END AS decision FROM {customer} WHERE c_custkey % 8 <> 1"""
KNOWN = """SELECT 'k' || p_partkey AS id, 'DS-' || (p_partkey % 40) || '-' || (1990 + p_partkey % 25) AS document_key FROM {part}"""


_DECIDED = f"""j AS (SELECT r.*, decision, CASE WHEN tipo IS NOT NULL THEN 'DS-' || try_cast(numero AS INT) || '-' || anio ELSE 'NORM-NORMA-' || relation_id END AS stub, CASE tipo_relacion WHEN 'modifica' THEN 'modificada' ELSE 'derogada' END AS validity FROM ({REL}) r LEFT JOIN ({DEC}) d USING (relation_id)),
  k AS (SELECT document_key AS stub, min(id) AS existing FROM ({KNOWN}) GROUP BY 1), x AS (SELECT *, estado = 'pendiente' AND decision IS NOT NULL AS act, estado = 'pendiente' AND coalesce(decision = 'confirmar', false) AS yes FROM j LEFT JOIN k USING (stub))"""


@query("relation_confirm", f"WITH {_DECIDED} SELECT relation_id, CASE WHEN yes THEN 'confirmada' WHEN act THEN 'rechazada' ELSE estado END AS estado, CASE WHEN yes THEN coalesce(affected_id, existing, 'stub:' || stub) ELSE affected_id END AS affected_id FROM x")
def relation_confirm(spark, sf):
    return Z.decided_relations(derived(spark, sf, REL), derived(spark, sf, DEC), derived(spark, sf, KNOWN))["relations"]


@query("relation_stubs", f"WITH {_DECIDED} SELECT stub, arg_min(validity, relation_id) AS estado_vigencia, arg_min(descripcion, relation_id) AS titulo FROM x WHERE yes AND affected_id IS NULL AND existing IS NULL GROUP BY stub")
def relation_stubs(spark, sf):
    return Z.decided_relations(derived(spark, sf, REL), derived(spark, sf, DEC), derived(spark, sf, KNOWN))["stubs"]


@query("relation_updates", f"WITH {_DECIDED} SELECT affected_id, arg_max(validity, relation_id) AS estado_vigencia FROM x WHERE yes AND affected_id IS NOT NULL GROUP BY affected_id")
def relation_updates(spark, sf):
    return Z.decided_relations(derived(spark, sf, REL), derived(spark, sf, DEC), derived(spark, sf, KNOWN))["updates"]


FOUND = """SELECT doc_id AS origin_id, CASE doc_id % 7 WHEN 0 THEN 'menciona' WHEN 1 THEN 'modifica' ELSE 'deroga' END AS tipo_relacion, CASE WHEN doc_id % 4 <> 1 THEN 'DS' END AS tipo, CASE WHEN doc_id % 4 <> 1 THEN CAST(doc_id % 120 AS STRING) END AS numero, CASE WHEN doc_id % 4 <> 1 THEN 1990 + doc_id % 25 END AS anio, CASE WHEN doc_id % 8 = 1 THEN 'Quedan derogadas todas las normas' WHEN doc_id % 11 = 0 THEN '  ' ELSE ' Norma ' || doc_id END AS descripcion, CASE doc_id % 3 WHEN 0 THEN substr(text, 5, 60) WHEN 1 THEN 'no such words ' || doc_id END AS fragmento FROM {documents}"""
SEEN = """SELECT doc_id AS origin_id, 'Norma ' || doc_id AS descripcion FROM {documents} WHERE doc_id % 6 = 0"""
TEXTS = """SELECT doc_id, text FROM {documents}"""


@query("relation_detection", f"""WITH f AS (SELECT origin_id, tipo, numero, anio, trim(descripcion) AS descripcion, coalesce(fragmento, '') AS fr FROM ({FOUND}) WHERE tipo_relacion <> 'menciona' AND trim(descripcion) <> '' AND NOT (tipo IS NULL AND starts_with(descripcion, 'Quedan'))),
  n AS (SELECT *, try_cast(regexp_extract(numero, '([0-9]+)', 1) AS INT) AS num FROM ({NORMS})), c AS (SELECT f.*, {CLEAN.format('fr')} AS fc, {CLEAN.format("text")} AS tc FROM f JOIN documents ON doc_id = origin_id WHERE (origin_id, descripcion) NOT IN (SELECT origin_id, descripcion FROM ({SEEN})))
SELECT origin_id, descripcion, fr <> '' AND contains(lower(coalesce(tc, '')), lower(fc)) AS verificado, coalesce((SELECT min(id) FROM n WHERE n.document_key = upper(c.tipo) || '-' || try_cast(c.numero AS INT) || '-' || c.anio), (SELECT min(id) FROM n WHERE n.anio = c.anio AND n.num = try_cast(c.numero AS INT))) AS affected_id FROM c""")
def relation_detection(spark, sf):
    return Z.new_relations(derived(spark, sf, FOUND), derived(spark, sf, SEEN), derived(spark, sf, NORMS), derived(spark, sf, TEXTS)).select("origin_id", "descripcion", "verificado", "affected_id")


@query("audience_fan_out", f"""SELECT telegram_chat_id, audience, o_orderkey FROM (SELECT telegram_chat_id, 'plan' AS audience FROM ({_SUBS}) WHERE estado = 'activo' AND nivel <> 'gratis' AND fecha_fin >= {_TODAY} UNION ALL SELECT telegram_chat_id, 'prueba' FROM ({_USERS}) WHERE prueba_estado = 'activa'), (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5)""")
def audience_fan_out(spark, sf):
    docs = table(spark, sf, "orders").select("o_orderkey")
    return Z.fan_out(docs, _users(spark, sf), _subscriptions(spark, sf), F.expr(_TODAY), ["o_orderkey"], 5)


@query("quality_by_language", f"WITH {PAGES_SQL} SELECT d.lang, round(avg(p.quality_score), 6) AS quality FROM pages p JOIN documents d USING (doc_id) GROUP BY 1")
def quality_by_language(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.round(F.avg(F.round(quality_score(F.col("text")), 6)), 6).alias("quality"))

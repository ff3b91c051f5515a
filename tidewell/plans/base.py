"""What the query catalogue shares: tables, fixtures, and the test tables in the domain's roles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.quality import formula_signs, quality_score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: Bands that fill on the test texts, all of which score high.
LOW, HIGH = 0.95, 0.99


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def named(sql: str) -> str:
    """SQL whose tables are written ``{table}``, for DuckDB."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows made from the tables: the same SQL text runs in both engines, its tables written ``{table}``."""
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql})


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that gives the same rows."""
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = named(sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks: a small file's rows lie in a few row groups, each read by one task, where the work on a
    row is what costs."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def values(spark: SparkSession, sql: str) -> DataFrame:
    """An inline fixture: the same SQL text runs in both engines."""
    return spark.sql(sql)


def norm_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels as pages of norms: a source is a norm, a document a page."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(l, "doc_id", "left").select(
        F.col("source").alias("norma_id"), F.col("doc_id").alias("page_number"), "doc_id", "text", F.round(quality_score(F.col("text")), 6).alias("quality_score"), F.contains("text", F.lit("|")).alias("has_tables"),
        F.when(F.col("lang") == "en", "plain").otherwise("ocr_tesseract").alias("extraction_method"), (F.col("quality") == 1).alias("revisado_manual"), (F.col("toxic") == 0).alias("tabla_verificada"),
        (formula_signs(F.col("text")) >= 1).alias("posible_formula"), (F.length("text") > 20000).alias("posible_grafico"),
    )


SIGNS = "=×÷≤≥≠≈∑∏∫√πΩ∆αβγδθλμσφ±"


def quality_sql(t: str) -> str:
    """The quality score of a stripped text in SQL."""
    w = f"list_filter(string_split_regex({t}, '[\\s\\x{{a0}}]+'), lambda w: w <> '')"
    return (
        f"CASE WHEN length({t}) < 15 THEN 0.0 ELSE greatest(0.0, least(1.0, 1.0 - 1.6 * (len(list_filter({w}, lambda w: length(w) > 25))::DOUBLE / len({w}))"
        f" - greatest(0.0, (list_sum(list_transform({w}, lambda w: length(w)))::DOUBLE / len({w}) - 12) / 22)"
        f" - greatest(0.0, 0.55 - length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))::DOUBLE / length({t})))) END"
    )


STRIPPED = "regexp_replace(coalesce(text, ''), '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g')"
PAGES_SQL = f"""
pages AS (
  SELECT source AS norma_id, d.doc_id AS page_number, d.doc_id, text, round({quality_sql('t')}, 6) AS quality_score, contains(text, '|') AS has_tables,
    CASE WHEN lang = 'en' THEN 'plain' ELSE 'ocr_tesseract' END AS extraction_method, l.quality = 1 AS revisado_manual, l.toxic = 0 AS tabla_verificada,
    length(t) - length(translate(t, '{SIGNS}', '')) >= 1 AS posible_formula, length(text) > 20000 AS posible_grafico
  FROM (SELECT *, {STRIPPED} AS t FROM documents) d LEFT JOIN labels l USING (doc_id)
)"""
COUNTS_SQL = """count(*) FILTER (q >= 0.99) AS calidad_alta, count(*) FILTER (q >= 0.95 AND q < 0.99) AS calidad_media, count(*) FILTER (q < 0.95) AS calidad_baja,
  count(*) FILTER (q < 0.95 AND NOT coalesce(revisado_manual, false)) AS calidad_baja_sin_revisar, count(*) FILTER (has_tables) AS tablas_total,
  count(*) FILTER (has_tables AND NOT coalesce(tabla_verificada, false)) AS tablas_sin_verificar, count(*) FILTER (posible_formula) AS formulas, count(*) FILTER (posible_grafico) AS graficos,
  count(*) FILTER (revisado_manual) AS revisadas_manual, count(*) FILTER (extraction_method ILIKE '%ocr%') AS via_ocr"""

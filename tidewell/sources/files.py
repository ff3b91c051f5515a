"""Inventories in, reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of an inventory in the order in which reports write them.
FIELDS = ("document_key", "title", "tipo", "numero", "anio", "fecha_publicacion", "source_url", "pdf_url")
_ITEM = "struct<" + ",".join(f"{f}:string" for f in FIELDS) + ",pdf_urls:array<string>>"


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """SRC6: one JSON object with a list ``items``; without the list it is an error."""
    whole = spark.read.schema(f"items array<{_ITEM}>").json(path, multiLine=True)
    rows = F.coalesce("items", F.raise_error(F.lit("the inventory has no list of items")).cast(f"array<{_ITEM}>"))
    return whole.select(F.inline(rows))


def checked_seeds(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: JSON lists of seeds; ``rejected`` says why a record cannot be one (null: it can). A file that is no JSON is one record."""
    fields = ("document_key", "titulo", "tipo", "numero", "anio")
    rows = spark.read.schema(", ".join(f"{f} string" for f in fields) + ", broken string").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="broken")
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    reason = F.when(F.col("broken").isNotNull(), "no JSON").when(empty("document_key"), "no key").when(empty("titulo"), "no title")
    return rows.select(*fields, reason.alias("rejected"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """SRC7: the same where a record without key or title is an error."""
    rows = checked_seeds(spark, path)
    return rows.select(F.when(F.col("rejected").isNotNull(), F.raise_error(F.concat(F.lit("a seed cannot be read: "), "rejected")).cast("string")).otherwise(F.col("document_key")).alias("document_key"), *[c for c in rows.columns if c not in ("document_key", "rejected")])


def write_report(items: DataFrame, path: str) -> None:
    """SNK12: JSON and CSV of the items, and a Markdown summary made of counts; all by Spark's writers."""
    chosen = items.select(*FIELDS)
    chosen.write.mode("overwrite").json(f"{path}/json")
    chosen.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    counts = items.groupBy(F.coalesce("tipo", F.lit("SIN_TIPO")).alias("tipo")).agg(F.count(F.lit(1)).alias("n"))
    lines = counts.select(F.concat(F.lit("- "), "tipo", F.lit(": "), F.col("n").cast("string")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(f"{path}/markdown")  # a row for each type of norm


def export_norms(pages: DataFrame, path: str) -> None:
    """SNK13: a text of each norm, its pages in order under their heads."""
    block = F.concat(F.lit("## Pagina "), F.col("page_number").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    whole = pages.groupBy("norma_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", block.alias("b")))), lambda s: s.b), "\n\n").alias("value"))
    whole.write.mode("overwrite").partitionBy("norma_id").text(path)


def append_log(rows: DataFrame, path: str, batch: int) -> None:
    """SNK14: the log's part of one batch: tasks that are tried again write once, and so does a batch that is run again."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

"""Products of alerts: each document's lines go once to the extractor that its type and headings ask for."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidewell.operators import extraction as E

NARRATIVE_FIELDS = ("product_name", "lot_number", "manufacturer", "manufacturer_country")


@udtf(returnType=E.PRODUCT)
class AlertProducts:
    """EXR3, EXR6-EXR8: the table of a recall, the labels of a falsified product, or what a narrative names, as the
    router says; any other document has no products."""

    def eval(self, extractor: str, rows: list[str], narrative: dict) -> Iterator[tuple]:
        if extractor == "retiro_mercado":
            yield from E.QualityProducts.func().eval(rows)
        elif extractor == "falsificados":
            yield from E.FalsifiedProducts.func().eval(rows)
        elif extractor == "narrativo_ilegal":
            yield E._row({f: narrative[f] for f in NARRATIVE_FIELDS}, narrative["confidence"], "ok")


def alert_products(documents: DataFrame) -> DataFrame:
    """EXR1-EXR9 over whole documents (``doc_id, title, text``; null texts have no lines): a row for each product, with
    the alert's number, type and the extractor that found it. One pass over the documents, no shuffle."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n"), lambda s: F.trim(s) != "")
    kind = E.alert_type(F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    routed = documents.select("doc_id", "title", "text", lines.alias("lines"), kind.alias("alert_type"))
    routed = routed.withColumn("extractor", E.extractor(F.col("alert_type"), F.col("lines"))).filter("extractor <> 'ninguno'")
    number = E.alert_number(F.col("title"), F.col("text"), F.lit(None).cast("string"))
    told = routed.select("doc_id", number.alias("alert_number"), "alert_type", "extractor", "lines", F.when(F.col("extractor") == "narrativo_ilegal", E.narrative_product(F.col("text"))).alias("narrative"))
    found = told.lateralJoin(AlertProducts(F.col("extractor").outer(), F.col("lines").outer(), F.col("narrative").outer()))
    return found.filter("status = 'ok'").drop("lines", "narrative", "status")

"""Queues: which rows are due. ``limit`` stands before or after a filter on purpose; see each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.text import blank, is_generic_title, lower_fold

# Words that mark pages which are no norms, and titles of whole categories (fixed values).
BLOCKED = ("informacion institucional", "gestion de calidad", "antisoborno", "formatos", "ventanilla virtual", "firma digital", "expedientes", "consultas web", "establecimientos farmaceuticos", "productos robados", "laboratorios pendientes", "especialidades farmaceuticas", "productos biologicos", "consultas", "certificacion", "tramite", "contacto", "inicio", "portal", "mapa del sitio")
CATEGORY_TITLES = ("resolucion ministerial", "decreto supremo", "resolucion directoral", "resolucion suprema", "ley", "decreto legislativo", "decreto de urgencia", "decreto ley")


def pending_notification(docs: DataFrame, kind: str, k: int = 50) -> DataFrame:
    """FLT1: not notified yet, oldest first."""
    return docs.filter((F.col("source_type") == kind) & F.col("notified_at").isNull()).orderBy("created_at", "document_key").limit(k)


def pending_norms(norms: DataFrame, states: list[str], k: int) -> DataFrame:
    """FLT2: with a PDF and a state that is null or listed; newest year first, limit after the filter."""
    due = norms.filter((blank(F.col("pdf_url")) != "") & (F.col("process_status").isNull() | F.col("process_status").isin(states)))
    return due.orderBy(F.col("anio").desc_nulls_last(), "document_key").limit(k)


def without_pages(docs: DataFrame, pages: DataFrame, k: int, order: list[Column], force: bool = False) -> DataFrame:
    """FLT3, FLT4: of the first ``k`` documents those without pages (limit before the anti-join); all of them if forced."""
    top = docs.orderBy(*order).limit(k)
    return top if force else top.join(pages.select("document_id").distinct(), "document_id", "left_anti")


def is_incomplete(title: str = "title", key: str = "document_key") -> Column:
    """FLT5: a title that says nothing, or a date, its text or a file is missing."""
    missing = F.lit(False)
    for c in ("published_date", "published_date_display", "file_url"):
        missing = missing | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    return is_generic_title(F.col(title), F.col(key)) | missing | ~F.coalesce(F.col("has_file"), F.lit(False))


def to_enrich(docs: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """FLT5: limit first, then the filter."""
    return docs.orderBy(*order).limit(k).filter(is_incomplete())


def archive_candidates(docs: DataFrame, today: Column, months: int, k: int) -> DataFrame:
    """FLT6: not archived and older than thirty days a month, oldest first."""
    old = docs.filter(F.col("archived_at").isNull() & (F.to_date("published_date") < F.date_sub(today, 30 * months)))
    return old.orderBy("published_date", "document_key").limit(k)


def expired_trials(users: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """FLT7."""
    return users.filter((F.col("prueba_estado") == "activa") & (F.col("prueba_inicio") <= now - F.make_interval(days=F.lit(days))))


def reminder_due(people: DataFrame, subscriptions: DataFrame, now: Column, today: Column, most: int = 5, gap: int = 2) -> DataFrame:
    """FLT8: fewer than ``most`` reminders, the last (or first) contact long enough ago, and no current paid plan."""
    paid = subscriptions.filter((F.col("estado") == "activo") & (F.col("nivel") != "gratis") & (F.col("fecha_fin").isNull() | (F.col("fecha_fin") >= today))).select("telegram_chat_id").distinct()
    since = F.coalesce("ultimo_recordatorio_at", "referencia_at")
    due = people.filter((F.coalesce("recordatorios", F.lit(0)) < most) & (since <= now - F.make_interval(days=F.lit(gap))))
    return due.join(paid, "telegram_chat_id", "left_anti")


def review_pages(pages: DataFrame, mode: str, low: float = 0.5) -> DataFrame:
    """FLT9, FLT10: pages of low quality, with unchecked tables, or either; worst first."""
    bad = (F.col("quality_score") < low) & ~F.coalesce("revisado_manual", F.lit(False))
    table = F.coalesce("has_tables", F.lit(False)) & ~F.coalesce("tabla_verificada", F.lit(False))
    return pages.filter({"quality": bad, "tables": table, "either": bad | table}[mode]).orderBy("quality_score", "norma_id", "page_number")


def broken_pdfs(norms: DataFrame, k: int = 30) -> DataFrame:
    """FLT11: failed or missing PDFs, newest year first, with which of the two it is."""
    missing = blank(F.col("pdf_url")) == ""
    failed = F.coalesce(F.col("process_status").endswith("_error"), F.lit(False))
    return norms.filter(missing | failed).withColumn("need", F.when(missing, "missing").otherwise("broken")).orderBy(F.col("anio").desc_nulls_last(), "document_key").limit(k)


def pending_target(docs: DataFrame, target: str) -> DataFrame:
    """FLT12: rows with a file whose target column is not filled yet."""
    return docs.filter(F.coalesce("has_file", F.lit(False)) & (blank(F.col("file_url")) != "") & F.col(target).isNull())


def admitted(section: Column, title: Column, context: Column, url: Column, dated: Column, in_section: Column, normative: Column, numbered: Column, listing: Column) -> Column:
    """FLT13: blocked words, bare category titles and listings are out; the rest needs a date or number and
    what its section asks for."""
    words = lower_fold(F.concat_ws(" ", title, context, url))
    t = F.trim(lower_fold(title))
    out = F.rlike(words, F.lit("|".join(BLOCKED))) | t.isin(*CATEGORY_TITLES) | t.startswith("descripcion:") | listing
    evidence = dated | numbered
    named = {"resolucion-ministerial": F.rlike(F.concat_ws(" ", t, lower_fold(url)), F.lit(r"resolucion ministerial|r\.m\.|rm ")), "decreto-supremo": F.rlike(F.concat_ws(" ", t, lower_fold(url)), F.lit(r"decreto supremo|d\.s\.|ds "))}
    ministerial = normative & (in_section | named["resolucion-ministerial"])
    decree = normative & t.startswith("decreto supremo") & (in_section | named["decreto-supremo"])
    other = in_section | normative
    return ~out & evidence & F.when(section == "resolucion-ministerial", ministerial).when(section == "decreto-supremo", decree).otherwise(other)


def is_blocked(status: Column, html: Column) -> Column:
    """FLT15: a refusing status or a challenge page."""
    return status.isin(401, 403, 429, 503) | F.rlike(F.lower(blank(html)), F.lit(r"attention required! \| cloudflare|cf-browser-verification|__cf_chl_"))


def still_open(rows: DataFrame, now: Column) -> DataFrame:
    """FLT18: uploads that have not expired."""
    return rows.filter(F.col("expira_en") > now)


def valid_document() -> Column:
    """FLT19."""
    return (blank(F.col("document_key")) != "") & (blank(F.col("detail_url")) != "")


def titled(docs: DataFrame, query: str, k: int = 10) -> DataFrame:
    """FLT20: titles that hold the query, case aside, newest first."""
    return docs.filter(F.contains(F.lower("title"), F.lit(query.strip().lower()))).orderBy(F.col("published_date").desc_nulls_last(), "document_key").limit(k)


def newest(docs: DataFrame, k: int, day: str = "published_date", key: str = "document_key") -> DataFrame:
    """TOP7."""
    return docs.orderBy(F.col(day).desc_nulls_last(), F.col(key).desc()).limit(k)


def week_window(docs: DataFrame, today: Column, k: int, day: str = "published_date", key: str = "document_key") -> DataFrame:
    """TOP7: Monday to Sunday of the day, the newest ``k`` with the exact number of all.

    The number is a one-row aggregate beside the top rows, not a window over the week."""
    start = F.to_date(F.date_trunc("week", today))
    inside = docs.filter(F.col(day).between(start, F.date_add(start, 6)))
    total = inside.agg(F.count(F.lit(1)).alias("total"))
    return newest(inside, k, day, key).crossJoin(F.broadcast(total))  # one row


def month_window(docs: DataFrame, today: Column, k: int = 20, day: str = "published_date", key: str = "document_key") -> DataFrame:
    """TOP7: of the day's calendar month; the limit also bounds the count, as its users see it."""
    return newest(docs.filter(F.trunc(F.col(day), "month") == F.trunc(today, "month")), k, day, key)


def recent(docs: DataFrame, now: Column, k: int, days: int = 7) -> DataFrame:
    """TOP7: created in the last days, by three keys."""
    return docs.filter(F.col("created_at") >= now - F.make_interval(days=F.lit(days))).orderBy(F.col("created_at").desc(), F.col("published_date").desc_nulls_last(), F.col("document_key").desc()).limit(k)

"""Reports: page fidelity, usage, subscriptions, revenue. One aggregate each, partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.functions.keys import lima
from tidewell.operators.store import durable

#: List prices and daily questions by plan (fixed values).
PRICES = {"gratis": 0, "basico": 29, "consultoria": 79, "empresarial": 199}
QUOTAS = {"gratis": 5, "basico": 30, "consultoria": 100, "empresarial": None}
GLOBAL_QUOTA = 300


def _count(c: Column, name: str) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False))).alias(name)


def _counts(q: Column, low: float, high: float) -> list[Column]:
    reviewed, tables = F.coalesce(F.col("revisado_manual"), F.lit(False)), F.coalesce(F.col("has_tables"), F.lit(False))
    checked = F.coalesce(F.col("tabla_verificada"), F.lit(False))
    return [
        _count(q >= high, "calidad_alta"), _count((q >= low) & (q < high), "calidad_media"), _count(q < low, "calidad_baja"), _count((q < low) & ~reviewed, "calidad_baja_sin_revisar"),
        _count(tables, "tablas_total"), _count(tables & ~checked, "tablas_sin_verificar"), _count(F.col("posible_formula"), "formulas"), _count(F.col("posible_grafico"), "graficos"),
        _count(reviewed, "revisadas_manual"), _count(F.lower("extraction_method").contains("ocr"), "via_ocr"),
    ]


def norm_summary(norms: DataFrame, pages: DataFrame, low: float = 0.5, high: float = 0.85) -> DataFrame:
    """AGG1, JON2: a row for each norm, also those without pages; a null quality is in no band."""
    counted = pages.groupBy("norma_id").agg(F.count(F.lit(1)).alias("total_paginas"), *_counts(F.col("quality_score"), low, high))
    numbers = [c for c in counted.columns if c != "norma_id"]
    return norms.join(counted, norms.id == counted.norma_id, "left").select(*norms.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers])


def fidelity_global(pages: DataFrame, low: float = 0.5, high: float = 0.85) -> DataFrame:
    """AGG2: the same counts over all pages in one pass."""
    return pages.agg(F.count(F.lit(1)).alias("total_paginas"), *_counts(F.col("quality_score"), low, high))


def fidelity_of_norms(pages: DataFrame, low: float = 0.5, high: float = 0.85) -> DataFrame:
    """AGG3: here a null quality counts as zero, so as low."""
    return pages.groupBy("norma_id").agg(F.count(F.lit(1)).alias("total_paginas"), *_counts(F.coalesce("quality_score", F.lit(0.0)), low, high))


def verdict(summary: DataFrame) -> DataFrame:
    """AGG4: 0 no PDF, 1 unprocessed or failed, 2 needs review, 3 caution, 4 reliable; sorted by it and the key."""
    no_pdf = (F.coalesce("pdf_url", F.lit("")) == "") & (F.coalesce("file_storage_path", F.lit("")) == "")
    level = (
        F.when(no_pdf, 0).when(F.col("total_paginas") == 0, 1).when(F.coalesce(F.col("process_status").contains("error"), F.lit(False)), 1)
        .when((F.col("calidad_baja_sin_revisar") > 0) | (F.col("formulas") > 0) | (F.col("graficos") > 0), 2)
        .when((F.col("tablas_sin_verificar") > 0) | (F.col("via_ocr") > 0) | (F.col("calidad_media") > 0), 3).otherwise(4)
    )
    return summary.withColumn("prioridad", level).orderBy("prioridad", "document_key")


#: States that mean done, due and to be tried again; null is due too (fixed values).
DONE, DUE, AGAIN = ("text_extracted", "text_extracted_baja_calidad"), ("registered", "inventory_imported"), ("text_extraction_error", "pdf_download_error")


def status_census(norms: DataFrame) -> DataFrame:
    """AGG5."""
    status, pdf = F.col("process_status"), F.trim(F.coalesce("pdf_url", F.lit(""))) != ""
    done = F.coalesce(status.isin(*DONE), F.lit(False))
    return norms.agg(F.count(F.lit(1)).alias("total"), _count(done, "with_text"), _count((status.isNull() | status.isin(*DUE)) & pdf, "pending_with_pdf"), _count(status.isin(*AGAIN) & pdf, "errors_with_pdf"), _count(~done & ~pdf, "no_pdf_no_text"))


def certainty(pages: DataFrame, low: float = 0.5, high: float = 0.85) -> DataFrame:
    """AGG6: page statistics and mean quality of each norm, its status and certainty."""
    q = F.col("quality_score")
    return pages.groupBy("norma_id").agg(
        F.avg(q).alias("mean_quality"), _count(q < low, "low_pages"), F.array_sort(F.collect_list(F.when(q < low, F.col("page_number")))).alias("low_page_numbers"),
        F.coalesce(F.bool_or(F.lower("extraction_method").contains("ocr")), F.lit(False)).alias("any_ocr"), F.coalesce(F.bool_or("has_tables"), F.lit(False)).alias("any_table"),
        F.coalesce(F.bool_or(F.col("posible_formula") | F.col("posible_grafico")), F.lit(False)).alias("any_sign"),
    ).withColumns({
        "status": F.when(F.col("mean_quality") >= low, "text_extracted").otherwise("text_extracted_baja_calidad"),
        "certainty": F.when((F.col("low_pages") > 0) | (F.col("mean_quality") < low), "baja").when((F.col("mean_quality") < high) | F.col("any_ocr") | F.col("any_table") | F.col("any_sign"), "media").otherwise("alta"),
    })


def counts_by(rows: DataFrame, column: str, missing: str) -> DataFrame:
    """AGG8: how many of each value, largest first, then by name."""
    return rows.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(missing)).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value")


def action_summary(actions: DataFrame) -> DataFrame:
    """AGG9."""
    a = F.col("action")
    return actions.agg(F.count(F.lit(1)).alias("total"), _count(a == "skipped_exact_existing", "existing"), _count(a == "skipped_possible_duplicate", "possible"), _count(a == "new_candidate", "new_candidates"), _count(a == "skipped_insufficient_data", "insufficient"))


def extraction_summary(assets: DataFrame) -> DataFrame:
    """AGG10, QLT15: sums and flags of a norm's assets, and the status they amount to."""
    return assets.groupBy("norma_id").agg(
        F.count(F.lit(1)).alias("assets"), F.sum("pages").alias("pages"), F.sum("text_pages").alias("text_pages"), F.sum("ocr_pages").alias("ocr_pages"), F.sum("errors").alias("errors"),
        F.bool_or("has_tables").alias("has_tables"), F.min_by("file_name", F.when(F.col("file_name").isNotNull(), F.col("asset_id"))).alias("first_file"),
    ).withColumn("status", asset_status(F.col("errors"), F.col("pages"), F.col("text_pages"), F.col("ocr_pages")))


def asset_status(errors: Column, pages: Column, text_pages: Column, ocr_pages: Column) -> Column:
    """QLT15."""
    return F.when(errors > 0, "error").when(text_pages == 0, "ocr_required").when(text_pages < pages, "partial_text").when(ocr_pages > 0, "text_extracted_ocr").otherwise("text_extracted")


def operation_rollup(docs: DataFrame) -> DataFrame:
    """AGG11: operations of each document by family (the word before the first underscore)."""
    ops = docs.select("document_key", F.explode("operations").alias("op"))
    return ops.groupBy(F.substring_index("op", "_", 1).alias("family")).agg(F.count(F.lit(1)).alias("operations"), F.count_distinct("document_key").alias("documents"))


def prices(column: Column) -> Column:
    out = None
    for plan, price in PRICES.items():
        out = F.when(column == plan, price) if out is None else out.when(column == plan, price)
    return F.coalesce(out, F.lit(0))


def revenue(subscriptions: DataFrame, month: Column) -> DataFrame:
    """AGG12: paid plans begun in the month: how many and their list prices; the free plan is left out."""
    begun = F.to_date("fecha_inicio")
    paid = subscriptions.filter((F.trunc(begun, "month") == month) & (F.col("nivel") != "gratis"))
    return paid.groupBy("nivel").agg(F.count(F.lit(1)).alias("cantidad"), F.sum(prices(F.col("nivel"))).alias("subtotal"))


def payments(rows: DataFrame, month: Column) -> DataFrame:
    """AGG13: the month's payments by state."""
    amount, state = F.coalesce(F.col("monto_esperado"), F.lit(0)), F.col("estado")
    inside = rows.filter(F.trunc(F.to_date(lima(F.col("creado_at"))), "month") == month)
    return inside.agg(F.coalesce(F.sum(F.when(state == "confirmado", amount)), F.lit(0)).alias("total_confirmado"), _count(state == "confirmado", "confirmados"), F.coalesce(F.sum(F.when(state == "pendiente", amount)), F.lit(0)).alias("total_pendiente"), _count(state == "pendiente", "pendientes"), _count(state == "rechazado", "rechazados"))


def effective_state(state: Column, end: Column, today: Column) -> Column:
    """Active past its end is expired."""
    return F.when((state == "activo") & end.isNotNull() & (end < today), "vencido").otherwise(state)


def subscription_census(subscriptions: DataFrame, today: Column) -> DataFrame:
    """AGG14: how many of each effective state, and of each plan among the active ones."""
    state = effective_state(F.col("estado"), F.col("fecha_fin"), today)
    return subscriptions.groupBy(state.alias("estado_efectivo"), F.when(state == "activo", F.col("nivel")).alias("nivel")).agg(F.count(F.lit(1)).alias("n"))


def follow_up(subscriptions: DataFrame, today: Column, k: int = 20) -> DataFrame:
    """AGG14: the first unpaid or expired ones."""
    state = effective_state(F.col("estado"), F.col("fecha_fin"), today)
    return subscriptions.withColumn("estado_efectivo", state).filter("estado_efectivo IN ('pendiente_pago', 'vencido')").orderBy("telegram_chat_id").limit(k)


def memberships(subscriptions: DataFrame, users: DataFrame, today: Column) -> DataFrame:
    """AGG15, JON4: subscriptions with their section and what the person is called."""
    state = effective_state(F.col("estado"), F.col("fecha_fin"), today)
    named = subscriptions.join(users.select("telegram_chat_id", "nombre"), "telegram_chat_id", "left")
    called = F.coalesce(F.nullif("nombre", F.lit("")), F.concat(F.lit("@"), F.nullif("telegram_username", F.lit(""))), F.col("telegram_chat_id").cast("string"))
    return named.select("telegram_chat_id", state.alias("seccion"), called.alias("referencia"), "nivel")


def latest_per(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """JON6: the row that comes first in the order, for each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def directory(users: DataFrame, subscriptions: DataFrame, today: Column) -> DataFrame:
    """AGG16: each person's segment, strictly by precedence; group chats are left out."""
    newest = latest_per(subscriptions, "telegram_chat_id", [F.col("fecha_fin").desc_nulls_last(), F.col("nivel")]).select("telegram_chat_id", "nivel", "estado", "fecha_fin")
    state = effective_state(F.col("estado"), F.col("fecha_fin"), today)
    segment = (
        F.when(state == "activo", "plan_activo").when(F.col("prueba_estado") == "activa", "prueba_activa").when(F.col("plan_gratis_legado"), "gratis_permanente")
        .when(state == "vencido", "vencido").when(state == "cancelado", "cancelado").when(state == "pendiente_pago", "pago_pendiente").when(F.col("prueba_estado") == "finalizada", "prueba_finalizada").otherwise("sin_nada")
    )
    people = users.filter(~F.col("telegram_chat_id").cast("string").startswith("-"))
    return people.join(newest, "telegram_chat_id", "left").select("telegram_chat_id", segment.alias("segmento"))


def access(users: DataFrame, subscriptions: DataFrame, today: Column) -> DataFrame:
    """FLT17: the tier (anything not current is free) and whether there is access at all."""
    current = (F.col("estado") == "activo") & (F.col("fecha_fin").isNull() | (F.col("fecha_fin") >= today))
    tier = F.coalesce(F.when(current, F.col("nivel")), F.lit("gratis"))
    joined = users.join(subscriptions.select("telegram_chat_id", "nivel", "estado", "fecha_fin"), "telegram_chat_id", "left")
    active = F.coalesce(F.col("plan_gratis_legado"), F.lit(False)) | F.coalesce(F.col("prueba_estado") == "activa", F.lit(False)) | (tier != "gratis")
    return joined.select("telegram_chat_id", tier.alias("nivel"), active.alias("acceso"))


def daily_usage(log: DataFrame, command: str, ts: str = "created_at") -> DataFrame:
    """AGG17: questions of each chat on each business day, and of all chats."""
    day = F.to_date(lima(F.col(ts)))
    own = log.filter(F.col("command") == command).groupBy(day.alias("dia"), "chat_id").agg(F.count(F.lit(1)).alias("consultas"))
    total = own.groupBy("dia").agg(F.sum("consultas").alias("global"))
    return own.join(total, "dia")


def quota_decisions(log: DataFrame, command: str, plan: Column, ts: str = "created_at", global_quota: int = GLOBAL_QUOTA) -> DataFrame:
    """AGG17: for each question whether it was within the day's global and own quota when it came.

    Of a day only the last question within the global quota is wanted: a rank with a bound, which each task applies to
    its own rows before anything is shuffled. Later questions are over it."""
    asked = log.filter(F.col("command") == command).withColumns({"dia": F.to_date(lima(F.col(ts))), "at": F.struct(ts, "id"), "plan": plan})
    first = asked.select("dia", "at").withColumn("n", F.row_number().over(W.partitionBy("dia").orderBy("at"))).filter(F.col("n") <= global_quota)
    last = first.groupBy("dia").agg(F.max(F.when(F.col("n") == global_quota, F.col("at"))).alias("last"))
    own = F.row_number().over(W.partitionBy("dia", "chat_id").orderBy("at"))
    numbered = asked.withColumn("own", own).join(last, "dia")
    limit = None
    for name, quota in QUOTAS.items():
        if quota is not None:
            limit = F.when(F.col("plan") == name, quota) if limit is None else limit.when(F.col("plan") == name, quota)
    decision = F.when(F.col("at") > F.col("last"), "global_limit").when(F.col("own") > limit, "own_limit").otherwise("ok")
    return numbered.select("id", "chat_id", "dia", decision.alias("decision"))


def burn_rate(history: DataFrame, key: str, now: Column, days: int = 14) -> DataFrame:
    """AGG18: days that the balance lasts at the pace since the last increase in the window; null without two
    points, elapsed time and consumption."""
    rows = history.filter(F.col("balance").isNotNull() & (F.col("ts") >= now - F.make_interval(days=F.lit(days))))
    w = W.partitionBy(key).orderBy("ts", "id")
    marked = rows.withColumn("up", F.col("balance") > F.lag("balance").over(w))
    since = F.max(F.when(F.col("up"), F.struct("ts", "id"))).over(W.partitionBy(key))
    tail = marked.withColumn("since", since).filter(F.col("since").isNull() | (F.struct("ts", "id") >= F.col("since")))
    at = F.struct("ts", "id")
    ends = tail.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min_by("balance", at).alias("first"), F.max_by("balance", at).alias("last"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    elapsed = (F.unix_micros(F.col("t1").cast("timestamp")) - F.unix_micros(F.col("t0").cast("timestamp"))) / 86_400_000_000
    used = F.col("first") - F.col("last")
    return ends.select(key, F.when((F.col("n") >= 2) & (elapsed > 0) & (used > 0), F.col("last") / (used / elapsed)).alias("days_left"))


def staleness(rows: DataFrame, ts: str, now: Column, limit: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """AGG19: whole days since the newest row, and whether that is too long."""
    days = F.floor((F.unix_seconds(now) - F.unix_seconds(F.max(ts).cast("timestamp"))) / 86400)
    return rows.groupBy(*by).agg(days.alias("days"), (days >= limit).alias("stale"))


def concatenated(pages: DataFrame, by: str, order: str, text: str, cap: int | None = 15_000, between: str = "\n\n") -> DataFrame:
    """AGG21, AGG22: a document's page texts in order, blank ones left out, cut at the cap."""
    rows = F.filter(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.trim(F.coalesce(text, F.lit(""))).alias("t")))), lambda r: r.t != "")
    joined = F.array_join(F.transform(rows, lambda r: r.t), between)
    return pages.groupBy(by).agg((joined if cap is None else F.substring(joined, 1, cap)).alias("text"))


def exported(pages: DataFrame) -> DataFrame:
    """SNK13: pages of each norm's assets and the summary of what was exported."""
    return pages.groupBy("norma_id", "asset_id").agg(F.count(F.lit(1)).alias("pages_exported"), _count(F.col("ocr_used"), "ocr_pages"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("total_chars"))


def trial_counts(users: DataFrame, sent: DataFrame, most: int = 3) -> DataFrame:
    """AGG26: alerts sent in a trial so far and with this batch; the trial ends at ``most``."""
    n = F.coalesce("prueba_alertas_enviadas", F.lit(0)) + F.coalesce("sent", F.lit(0))
    return users.join(sent, "telegram_chat_id", "left").select("telegram_chat_id", n.alias("enviadas"), F.when(n >= most, "finalizada").otherwise(F.col("prueba_estado")).alias("prueba_estado"))


def open_counts(pages: DataFrame, norms: DataFrame) -> DataFrame:
    """JON5: how many pages of each norm's key wait; pages without a known norm count under '?'."""
    joined = pages.join(norms.select(F.col("id").alias("norma_id"), "document_key"), "norma_id", "left")
    return joined.groupBy(F.coalesce("document_key", F.lit("?")).alias("document_key")).agg(F.count(F.lit(1)).alias("n"))


def counts_by_year(rows: DataFrame, column: str = "anio") -> DataFrame:
    """AGG8: how many of each year, those without one first, then the newest."""
    year = F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit("SIN_ANIO"))
    return rows.groupBy(year.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy((F.col("value") == "SIN_ANIO").desc(), F.col("value").desc())


def rejections(links: DataFrame, by: str) -> DataFrame:
    """SRC4: how many links of each source were taken and why others were not (``reason``, null: taken)."""
    return links.groupBy(by).agg(F.count_if(F.col("reason").isNull()).alias("taken"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.count_distinct("reason").alias("reasons"))


def layout_counts(pages: DataFrame, words: str = "words") -> DataFrame:
    """SRC11: words and lines of pages with word boxes."""
    return pages.select("*", F.size(words).alias("word_count"), F.size(F.array_distinct(F.transform(words, lambda w: F.bround(w.y0 / 3, 0)))).alias("line_count"))


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """TOP13: all rows with their ``place`` in the order, from 1. Rows are sorted by ranges and numbered inside each;
    of the ranges only their sizes are gathered, a row for each task."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id()).sortWithinPartitions(*order)
    dealt = dealt.withColumn("row_", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    dealt = durable(dealt)  # both uses below see the same ranges
    sizes = dealt.groupBy("range_").agg(F.count(F.lit(1)).alias("n")).orderBy("range_").collect()
    ahead, total = {}, 0
    for r in sizes:
        ahead[r.range_], total = total, total + r.n
    begins = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in ahead.items() for x in pair]), F.col("range_").cast("long")) if ahead else F.lit(0)
    return dealt.withColumn("place", begins + F.col("row_") + 1).drop("range_", "row_")

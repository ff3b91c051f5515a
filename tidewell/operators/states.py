"""State machines of documents, relations, trials, payments and invitations, and the norm graph's one hop.

A transition is a function of the old state and an event; states that no rule covers stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.keys import number_key, stub_key
from tidewell.functions.text import blank, quoted_in
from tidewell.operators.matching import resolved

# What an event makes of a state; None stands for any state (fixed values).
ALERT = {"enriched": (None, "metadata_enriched"), "text": (None, "text_extracted"), "text_failed": (None, "text_extraction_error"), "products": (None, "structured_extracted"), "no_products": (None, "text_extracted_no_products"), "products_failed": (None, "structured_extraction_error")}
LISTING = {"pdf": (("registered", "pdf_detection_error"), "pdf_detected"), "no_pdf": (("registered", "pdf_detection_error"), "pdf_not_found"), "failed": (("registered", "pdf_detection_error"), "pdf_detection_error")}
NORM = {"good_text": (None, "text_extracted"), "poor_text": (None, "text_extracted_baja_calidad"), "text_failed": (None, "text_extraction_error"), "download_failed": (None, "pdf_download_error")}
RELATIONS = {"deroga": "derogada", "deja_sin_efecto": "derogada", "modifica": "modificada"}
#: A closing clause that repeals nothing in particular.
CLOSING = r"(?i)disposiciones?\s+que\s+se\s+opongan|normas?\s+que\s+se\s+opongan|quedan?\s+derogad[ao]s?\s+todas\s+las"


def moved(state: Column, event: Column, machine: dict) -> Column:
    """STM1, STM2, STM3: the next state. Enrichment moves an alert back whatever it was, as its users know it."""
    out = None
    for name, (allowed, target) in machine.items():
        when = event == name
        if allowed is not None:
            when = when & F.coalesce(state.isin(*allowed), F.lit(False))
        out = F.when(when, target) if out is None else out.when(when, target)
    return out.otherwise(state)


def is_closing_clause(tipo: Column, numero: Column, anio: Column, description: Column) -> Column:
    """SCL28."""
    named = (blank(tipo) != "") | (blank(numero) != "") | anio.isNotNull()
    return ~named & F.rlike(blank(description), F.lit(CLOSING))


def new_relations(found: DataFrame, known: DataFrame, norms: DataFrame, texts: DataFrame) -> DataFrame:
    """STM5, JON13: proposals (``origin_id, tipo_relacion, tipo, numero, anio, descripcion, fragmento``) that are
    valid, specific and not registered yet, with the norm they affect and whether their quote stands in the text."""
    valid = found.filter(F.col("tipo_relacion").isin(*RELATIONS) & (F.trim(blank(F.col("descripcion"))) != "")).withColumn("descripcion", F.trim("descripcion"))
    specific = valid.filter(~is_closing_clause(F.col("tipo"), F.col("numero"), F.col("anio"), F.col("descripcion")))
    fresh = specific.join(known.select("origin_id", "descripcion").distinct(), ["origin_id", "descripcion"], "left_anti")
    quoted = fresh.join(texts.select(F.col("doc_id").alias("origin_id"), "text"), "origin_id", "left").withColumn("fragmento", F.substring(blank(F.col("fragmento")), 1, 500))
    checked = quoted.withColumn("verificado", quoted_in(F.col("fragmento"), F.col("text"))).drop("text")
    return resolved(checked, norms)


def decided_relations(relations: DataFrame, decisions: DataFrame, norms: DataFrame) -> dict[str, DataFrame]:
    """STM4: pending relations that someone confirmed or rejected. Three outputs: the relations' next state, norms
    to create as stubs (born with the new validity), and validity updates of norms that were already linked.
    A stub key that exists is linked without an update."""
    joined = relations.join(decisions, "relation_id", "left")
    act = (F.col("estado") == "pendiente") & F.col("decision").isNotNull()
    key = stub_key(F.col("tipo"), number_key(F.col("numero")), F.col("anio"), F.col("descripcion"))
    known = norms.groupBy(F.col("document_key").alias("stub")).agg(F.min("id").alias("existing"))
    rows = joined.withColumn("stub", key).join(known, "stub", "left")
    validity = None
    for kind, value in RELATIONS.items():
        validity = F.when(F.col("tipo_relacion") == kind, value) if validity is None else validity.when(F.col("tipo_relacion") == kind, value)
    validity = F.coalesce(validity, F.lit("derogada"))
    confirmed = act & (F.col("decision") == "confirmar")
    state = F.when(confirmed, "confirmada").when(act, "rechazada").otherwise(F.col("estado"))
    linked = F.when(confirmed, F.coalesce("affected_id", "existing", F.concat(F.lit("stub:"), F.col("stub")))).otherwise(F.col("affected_id"))
    stubs = rows.filter(confirmed & F.col("affected_id").isNull() & F.col("existing").isNull())
    updates = rows.filter(confirmed & F.col("affected_id").isNotNull())
    return {
        "relations": rows.select("relation_id", state.alias("estado"), linked.alias("affected_id")),
        "stubs": stubs.groupBy("stub").agg(F.min_by(validity, "relation_id").alias("estado_vigencia"), F.min_by("descripcion", "relation_id").alias("titulo")),
        "updates": updates.groupBy("affected_id").agg(F.max_by(validity, "relation_id").alias("estado_vigencia")),
    }


def trial_state(state: Column, started: Column, sent: Column, event: Column, now: Column, days: int = 14, most: int = 3) -> Column:
    """STM6: started once; finished by alerts or by time."""
    begun = (event == "start") & state.isNull()
    over = (state == "activa") & ((sent >= most) | (started <= now - F.make_interval(days=F.lit(days))))
    return F.when(begun, "activa").when(over, "finalizada").otherwise(state)


def payment_state(state: Column, decision: Column) -> Column:
    """STM7: only pending ones move."""
    return F.when((state == "pendiente") & (decision == "confirmar"), "confirmado").when((state == "pendiente") & (decision == "rechazar"), "rechazado").otherwise(state)


def activated(payments: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """STM7, SNK11: a subscription for each chat with a payment confirmed now; the last payment's plan."""
    newest = payments.groupBy("chat_id").agg(F.max_by("nivel", F.struct("creado_at", "id")).alias("nivel"))
    return newest.select(F.col("chat_id").alias("telegram_chat_id"), "nivel", F.lit("activo").alias("estado"), today.alias("fecha_inicio"), F.date_add(today, days).alias("fecha_fin"))


def used_invitations(users: DataFrame, invitations: DataFrame, used: DataFrame) -> DataFrame:
    """STM8: pending invitations that were used; flags and fills what the invitation knows."""
    hit = invitations.filter("estado = 'pendiente'").join(used, "codigo").groupBy("telegram_chat_id").agg(F.min_by(F.struct("telefono", F.col("nombre").alias("n")), "codigo").alias("i"))
    return users.join(hit, "telegram_chat_id", "left").select("telegram_chat_id", F.coalesce(F.nullif("i.telefono", F.lit("")), F.col("telefono")).alias("telefono"), F.coalesce(F.nullif("i.n", F.lit("")), F.col("nombre")).alias("nombre"), (F.coalesce("plan_gratis_legado", F.lit(False)) | F.col("i").isNotNull()).alias("plan_gratis_legado"))


def fan_out(docs: DataFrame, users: DataFrame, subscriptions: DataFrame, today: Column, order: list[str], batch: int = 50) -> DataFrame:
    """SET3: messages to paid and to trial chats; a chat in both gets both.

    A run sends the first ``batch`` documents in the order; the others wait in their queue for the next run."""
    paid = subscriptions.filter((F.col("estado") == "activo") & (F.col("nivel") != "gratis") & (F.col("fecha_fin").isNull() | (F.col("fecha_fin") >= today))).select("telegram_chat_id", F.lit("plan").alias("audience"))
    trial = users.filter("prueba_estado = 'activa'").select("telegram_chat_id", F.lit("prueba").alias("audience"))
    first = docs.orderBy(*order).limit(batch).agg(F.collect_list(F.struct(*docs.columns)).alias("docs"))  # one row of at most a batch
    return paid.unionByName(trial).join(F.broadcast(first)).select("telegram_chat_id", "audience", F.inline("docs"))

"""Registering, merging and de-duplicating records.

Tables are immutable files, so a mutation is a DataFrame: old rows and new rows in,
the table's next state out.  Keys meet in one shuffle; the state of a key is decided
by an aggregate where possible, so that hot keys combine before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.operators.store import durable


def _struct(columns: list[str]) -> Column:
    return F.struct(*columns)


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """TOP1, SNK6: the last row of each key, and where its key was first seen (``first_seen``)."""
    kept = rows.groupBy(*keys).agg(F.max_by(_struct(rows.columns), _struct(order)).alias("r"), F.min(_struct(order)).alias("first_seen"))
    return kept.select("r.*", F.col(f"first_seen.{order[0]}").alias("first_seen"))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """TOP2, TOP4: the first row of each key."""
    return rows.groupBy(*keys).agg(F.min_by(_struct(rows.columns), _struct(order)).alias("r")).select("r.*")


def by_fingerprint(rows: DataFrame, text: Column, order: list[str]) -> DataFrame:
    """TOP5, SRC3: the first row of each content, found by the SHA-1 of it."""
    return first_wins(rows.withColumn("fp", F.sha1(text)), ["fp"], order)


def new_rows(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """JON3: rows whose key is not known; rows without a key stay."""
    return found.join(known.select(key).distinct(), key, "left_anti")


def insert_new(table: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """SNK1: the table with what is new; of new rows of one key the last by all columns' order stays."""
    fresh = new_rows(found, table, key)
    return table.unionByName(fresh.select([c for c in table.columns if c in fresh.columns]), allowMissingColumns=True)


def upsert(table: DataFrame, found: DataFrame, key: str, now: Column, keep: tuple[str, ...] = ("first_seen_at",), only: tuple[str, ...] | None = None) -> DataFrame:
    """SNK2, SNK3: new values over old ones where they are not null or empty; ``keep`` fields never change;
    with ``only`` just these fields do. ``raw`` maps are merged, new entries over old. Adds ``action``."""
    def filled(c: str) -> Column:
        new = F.col(f"n.{c}")
        return F.nullif(new, F.lit("")) if dict(found.dtypes)[c] == "string" else new

    joined = table.alias("o").join(found.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    exists, given = F.col(f"o.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    out = []
    for c in table.columns:
        old = F.col(f"o.{c}")
        if c == key:
            value = F.coalesce(old, F.col(f"n.{c}"))
        elif c == "raw" and c in found.columns:
            value = F.when(exists & given, F.map_from_entries(F.concat(F.map_entries(F.map_filter(old, lambda k, _: ~F.map_contains_key(F.col("n.raw"), k))), F.map_entries(F.col("n.raw"))))).otherwise(F.coalesce(F.col("n.raw"), old))
        elif c in ("last_seen_at", "updated_at"):
            value = F.when(given, now).otherwise(old)
        elif c in keep:
            value = F.coalesce(old, F.when(given, now))
        elif c in found.columns:
            value = F.when(exists & F.lit(only is not None and c not in (only or ())), old).otherwise(F.coalesce(filled(c), old))
        else:
            value = old
        out.append(value.alias(c))
    action = F.when(exists & given, "updated").when(given, "new").otherwise("kept").alias("action")
    return joined.select(*out, action)


def replace_by(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK4: all rows of the keys that ``new`` has go, its rows come."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def page_action(existing: Column, update_normalized: Column, force: Column, apply: Column) -> Column:
    """SNK5: what happens to a page that is to be written; without ``apply`` writes are only planned."""
    done = lambda planned, made: F.when(apply, made).otherwise(planned)
    return (
        F.when(existing & update_normalized, done("planned_update_normalized", "updated_normalized")).when(existing & ~force, "reused").when(existing, done("planned_update", "updated"))
        .when(update_normalized, "skipped_update_normalized_missing").otherwise(done("planned_insert", "inserted"))
    )


def stamped(table: DataFrame, keys: DataFrame, key: str, column: str, now: Column) -> DataFrame:
    """SNK9: the time put on the rows of the given keys."""
    marks = keys.select(key).distinct().withColumn("_marked", F.lit(True))
    return table.join(marks, key, "left").withColumn(column, F.when(F.col("_marked"), now).otherwise(F.col(column))).drop("_marked")


def backfilled(table: DataFrame, column: str, other: str, where: Column) -> DataFrame:
    """SNK10."""
    return table.withColumn(column, F.when(where, F.coalesce(F.col(column), F.col(other))).otherwise(F.col(column)))


def merged_entries(rows: DataFrame, key: str, order: list[Column], fields: list[str], sets: list[str]) -> DataFrame:
    """AGG23, AGG24: one row of each key: fields from the first entry that has them, sets united and sorted."""
    place = F.struct(*order)
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), place)).alias(c) for c in fields]
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in sets]
    return rows.groupBy(key).agg(*first, *united)


def reused_assets(wanted: DataFrame, assets: DataFrame) -> DataFrame:
    """SNK8, JON18: for each wanted asset the first one of its norm with its file name, type and subtype, or with
    its drive id and type; null where it must be inserted. The OR is two equi-joins, each with the first asset of
    every key: assets that share a key make no pairs."""
    first = lambda by: a.groupBy(by).agg(F.min("id").alias("asset_id"))
    a = assets.withColumn("sub", F.coalesce("asset_subtipo", F.lit("")))
    w = wanted.withColumn("sub", F.coalesce("asset_subtipo", F.lit("")))
    name, drive = ["norma_id", "asset_tipo", "sub", "file_name"], ["norma_id", "asset_tipo", "drive_file_id"]
    by_name, by_drive = (w.join(first(by), by).select("wanted_id", "asset_id") for by in (name, drive))
    best = by_name.unionByName(by_drive).groupBy("wanted_id").agg(F.min("asset_id").alias("asset_id"))
    return wanted.join(best, "wanted_id", "left").withColumn("action", F.when(F.col("asset_id").isNull(), "insert").otherwise("reuse"))


def capped_per(rows: DataFrame, by: str, order: list[str], cap: int) -> DataFrame:
    """SRC4: at most ``cap`` rows of each source, in order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order))).filter(F.col("_n") <= cap).drop("_n")


def folder_paths(nodes: DataFrame) -> DataFrame:
    """SRC9: full path of every node of a folder tree (``id, parent, name``), by self-joins that double the
    known stretch: log2(depth) rounds. A parent that is not there ends the path; a node whose parents lead into a
    cycle has no path (null). Ids are distinct."""
    rounds = nodes.count().bit_length() + 1  # a stretch of so many doublings is longer than any path without a cycle

    def doubled(rows: DataFrame, more: Column | None) -> DataFrame:
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("next"), *([F.col("path").alias("head")] if more is not None else []))
        return durable(rows.join(above, "up", "left").select("id", F.col("next").alias("up"), *([more] if more is not None else [])))

    links = nodes.select("id", F.col("parent").alias("up"))
    for _ in range(rounds):  # without names: these would grow on a cycle
        links = doubled(links, None)
        if links.filter("up IS NOT NULL").isEmpty():
            break
    ends = nodes.join(links.filter("up IS NOT NULL").select("id"), "id", "left_anti")
    rows = ends.select("id", F.col("parent").alias("up"), F.col("name").alias("path"))
    while not rows.filter("up IS NOT NULL").isEmpty():
        rows = doubled(rows, F.concat_ws("/", "head", "path").alias("path"))
    return nodes.select("id").join(rows.select("id", "path"), "id", "left")

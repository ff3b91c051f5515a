"""Helpers shared by the operators of this subpackage.

Intermediate results are written as Parquet under the shared folder that the
session names in ``spark.checkpoint.dir``; a lost executor then costs a re-read
and never a missing file.  A machine-local folder is used only where that
setting is absent and Spark runs on one machine (tests); a cluster without the
setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.ranges import place_in

#: Rows and bytes handed to Python at once: long texts must not add up to a large batch.
BATCH_ROWS, BATCH_BYTES = 128, 16 << 20


_HELD: dict = {}


def held(name: object, make: Callable[[], object]) -> object:
    """One large thing (a tokenizer's store, say) that a worker process keeps between tasks. Asking for another
    one lets go of it, so that stages which follow each other do not add up."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = make()
    return _HELD[name]


def nothing_held() -> None:
    _HELD.clear()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``), set here only where it is unset."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        sc.setCheckpointDir(base)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder."""
    _MADE.append(f"{shared_folder(spark)}/tidewell-{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this process wrote to the shared folder: when no result that reads it is needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a row group in a table of large cells. Spark's reader holds a row group's rows at once, whatever their size.
GROUP_BYTES = 8 << 20


def stored_large(df: DataFrame, name: str) -> DataFrame:
    """``stored`` for rows of up to megabytes: the writer looks at its size after every few rows, not after a hundred."""
    spark = df.sparkSession
    path = scratch(spark, name)
    checks = {f"parquet.{what}.size.row.check.{end}": n for what in ("block", "page") for end, n in (("min", 1), ("max", 4))}
    options = {"compression": "zstd", "parquet.block.size": GROUP_BYTES, "parquet.enable.dictionary": "false"} | checks
    df.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound what Python is handed at once. Spark reads these settings of the session when a frame runs, so they stay set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator reads; null text is the empty text. Other columns cannot clash."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def boundaries(df: DataFrame, key: str, n: int) -> list:
    """At most ``n - 1`` values of ``key`` that split its rows into about equal ranges (reads that column only)."""
    if n < 2:
        return []
    quantiles = [i / n for i in range(1, n)]
    found = df.select(F.percentile_approx(key, quantiles, max(10_000, 20 * n))).first()[0]
    return sorted(set(found or []))


def bucket_of(key: str, bounds: list) -> Column:
    """Number of boundaries at or below the key: 0 .. len(bounds). A null key goes to bucket 0."""
    return place_in(bounds, F.col(key))


def in_order(df: DataFrame, key: str, *then: str) -> DataFrame:
    """Rows dealt to partitions by ranges of ``key`` and sorted inside each, also by ``then``: one shuffle, whose
    boundaries come from a scan of the key column alone."""
    n = partitions(df.sparkSession)
    bounds = boundaries(df, key, n)
    return df.repartitionById(len(bounds) + 1, bucket_of(key, bounds)).sortWithinPartitions(key, *then)


def fair_join(many: DataFrame, one: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """``many`` (of ``rows`` rows) joined with ``one``: a row for each key, which tells in ``n`` how many rows of ``many``
    have it. A key with more rows than a task's fair share would fill a task; of such keys there are no more than
    tasks, so their rows of ``one`` are broadcast, and only the others meet by a shuffle. ``one`` should be stored."""
    share = max(1, -(-rows // partitions(many.sparkSession)))
    added = [c for c in one.columns if c not in (key, n)]
    hot = one.filter(F.col(n) > share).select(key, F.struct(*added).alias("hot_"))
    marked = many.join(F.broadcast(hot), key, "left")
    by_task = marked.filter("hot_ IS NOT NULL").select(*many.columns, *[F.col(f"hot_.{c}").alias(c) for c in added])
    by_key = marked.filter("hot_ IS NULL").drop("hot_").join(one.filter(F.col(n) <= share).drop(n), key)
    return by_task.unionByName(by_key)


def rows_of(schema: pa.Schema, rows: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def texts(batch: pa.RecordBatch) -> Iterable[tuple[int, str]]:
    return zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)

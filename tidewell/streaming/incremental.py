"""The incremental operators as streams: new keys, daily quotas, sliding windows, upserts, expiring state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewell.sources.tables import BucketTable, Outbox


def events(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_seen(stream: DataFrame, key: str, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """New against seen: each key once while its state lives."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_quota(stream: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Questions of each chat a business day: days that begin at 05:00 UTC."""
    window = F.window(ts, "1 day", "1 day", "5 hours")
    counted = stream.withWatermark(ts, delay).groupBy(window, "chat_id").agg(F.count(F.lit(1)).alias("consultas"))
    return counted.select(F.to_date(F.col("window.start")).alias("dia"), "chat_id", "consultas")


def sliding_counts(stream: DataFrame, length: str = "7 days", step: str = "1 day", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Recent rows: counts over windows that slide by a day."""
    counted = stream.withWatermark(ts, delay).groupBy(F.window(ts, length, step)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def upserted(stream: DataFrame, table: BucketTable, checkpoint: str) -> StreamingQuery:
    """SNK2, SNK6 as a stream: each batch is merged into the buckets that it touches; one that is run again changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, number: table.merge(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delivered(stream: DataFrame, box: Outbox, deliver: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """STM9: each batch is queued, then everything that waits is sent; rows leave when ``deliver`` returns their keys."""
    def run(batch: DataFrame, number: int) -> None:
        box.queue(batch, number)
        box.send(deliver)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Trials(StatefulProcessor):
    """STM6 as a stream: a chat's trial starts once and ends by alerts or by a timer."""

    DAYS, MOST = 14, 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("trial", "started timestamp, sent int, state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        started, sent, state = self.state.get() if self.state.exists() else (None, 0, None)
        for frame in rows:
            for row in frame.sort_values("ts").itertuples():
                if row.event == "start" and state is None:
                    started, state = row.ts, "activa"
                    self.handle.registerTimer(int((started + pd.Timedelta(days=self.DAYS)).timestamp() * 1000))
                elif row.event == "alert" and state == "activa":
                    sent += 1
                    state = "finalizada" if sent >= self.MOST else state
        if state is not None:
            self.state.update((started, sent, state))
            yield pd.DataFrame({"chat_id": [key[0]], "state": [state], "sent": [sent]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, sent, state = self.state.get()
        if state == "activa":
            self.state.update((started, sent, "finalizada"))
            yield pd.DataFrame({"chat_id": [key[0]], "state": ["finalizada"], "sent": [sent]})

    def close(self) -> None:
        pass


def trials(stream: DataFrame) -> DataFrame:
    """``chat_id, state, sent`` after each batch; needs the RocksDB state store."""
    rows = stream.withWatermark("ts", "1 hour").groupBy("chat_id")
    return rows.transformWithStateInPandas(Trials(), "chat_id long, state string, sent int", "Update", "eventTime")


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything that is there, as a table under ``folder`` (new, and shared by all executors): tasks write the rows.

    A batch has a part of its own, so one that is run again replaces what it wrote; in complete mode each batch holds
    the whole result and replaces the one before. A stream without rows gives a table without rows."""
    spark = stream.sparkSession
    part = lambda n: f"{folder}/rows/batch={n}"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(part(-1))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(part(0 if mode == "complete" else number))

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(stream.columns)

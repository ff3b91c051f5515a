"""Waits as streams: uploads that are expected for a while, silences, and reminders at a distance.

Each waits in a state of its own and ends by a row or by a timer on event time. A batch's rows of a key come in any
order, so they are taken in the order of their time; what a row shows to have ended is told before the row itself, so
that the result does not depend on how rows were cut into batches. The batch versions give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


#: After so many days without a row a source is silent.
SILENT_DAYS = 5


def _millis(t: pd.Timestamp) -> int:
    return int(pd.Timestamp(t).timestamp() * 1000)


def _in_order(rows: Iterator[pd.DataFrame], by: list[str]) -> Iterator:
    frames = [f for f in rows if len(f)]
    return pd.concat(frames).sort_values(by).itertuples() if frames else iter(())


class _Waiting(StatefulProcessor):
    """One thing that a key waits for, until a time."""

    STATE, OUT = "", []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("waiting", self.STATE)

    def out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=self.OUT)

    def timer(self, until: pd.Timestamp | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if until is not None:
            self.handle.registerTimer(_millis(until))

    def close(self) -> None:
        pass


class Uploads(_Waiting):
    """A question opens a wait of half an hour, in place of an open one; an answer in that time ends it."""

    STATE, OUT = "id long, asked timestamp", ["chat_id", "id", "answer_id", "state"]

    def __init__(self, minutes: int = 30):
        self.wait = pd.Timedelta(minutes=minutes)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, open_ = [], self.state.get() if self.state.exists() else None
        for r in _in_order(rows, ["ts", "id"]):
            if open_ and r.ts >= open_[1] + self.wait:
                out.append((key[0], open_[0], None, "expired"))
                open_ = None
            if open_:
                out.append((key[0], open_[0], r.id if not r.asks else None, "replaced" if r.asks else "matched"))
            open_ = (r.id, r.ts) if r.asks else None
        if open_:
            self.state.update(open_)
        else:
            self.state.clear()
        self.timer(open_ and open_[1] + self.wait)
        return self.out([(a, b, pd.NA if c is None else c, d) for a, b, c, d in out])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_ = self.state.get()
        self.state.clear()
        return self.out([(key[0], open_[0], pd.NA, "expired")])


class Reminders(_Waiting):
    """A chat is reminded some days after it came or was last reminded, a few times, unless it has paid. What was sent
    before the stream began is the initial state."""

    DAYS, MOST = 2, 5
    STATE, OUT = "sent int, since timestamp, paid boolean", ["chat_id", "number", "at"]

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.state.update((int(r.sent), r.since, False))
        if r.sent < self.MOST:
            self.timer(r.since + pd.Timedelta(days=self.DAYS))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, (sent, since, paid) = [], self.state.get() if self.state.exists() else (0, None, False)
        for r in _in_order(rows, ["ts"]):
            due = [] if since is None or paid else self._due(sent, since, r.ts)
            out += [(key[0], n, at) for n, at in due]
            sent, since = (due[-1] if due else (sent, since))
            paid, since = paid or bool(r.pays), r.ts if since is None else since
        if since is not None:
            self.state.update((sent, since, paid))
            self.timer(None if paid or sent >= self.MOST else since + pd.Timedelta(days=self.DAYS))
        return self.out(out)

    def _due(self, sent: int, since: pd.Timestamp, now: pd.Timestamp) -> list[tuple[int, pd.Timestamp]]:
        steps = range(1, self.MOST - sent + 1)
        return [(sent + k, since + k * pd.Timedelta(days=self.DAYS)) for k in steps if since + k * pd.Timedelta(days=self.DAYS) <= now]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sent, since, paid = self.state.get()
        due = self._due(sent, since, pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms"))
        if due:
            self.state.update((*due[-1], paid))
            self.timer(None if due[-1][0] >= self.MOST else due[-1][1] + pd.Timedelta(days=self.DAYS))
        return self.out([(key[0], n, at) for n, at in due])


def uploads(stream: DataFrame, delay: str, minutes: int = 30) -> DataFrame:
    """FLT18 as a stream (``chat_id, id, asks, ts``): how each question's wait ended. Needs the RocksDB state store, like all here."""
    rows = stream.withWatermark("ts", delay).groupBy("chat_id")
    return rows.transformWithStateInPandas(Uploads(minutes), "chat_id long, id long, answer_id long, state string", "Append", "eventTime")


def silences(stream: DataFrame, delay: str, days: int = SILENT_DAYS) -> DataFrame:
    """AGG19 as a stream (``source, ts``): since when a source was silent, once its silence was too long. Its rows are
    sessions of Spark's own, so no row or source goes to Python; a session ends when the clock comes to the silence's end.
    A row at a session's very end joins it, so the gap is a microsecond short of the days."""
    gap = F.session_window("ts", f"{24 * days} hours -1 microseconds")
    rows = stream.select("source", "ts").withWatermark("ts", delay).groupBy("source", gap).agg(F.count(F.lit(1)))
    return rows.select("source", (F.col("session_window.end") - F.make_dt_interval(days=F.lit(days)) + F.expr("INTERVAL '0.000001' SECOND")).alias("since"))


def reminders(stream: DataFrame, before: DataFrame, delay: str) -> DataFrame:
    """FLT8 as a stream (``chat_id, pays, ts``), begun from a table (``chat_id, sent, since``): which reminder fell due when."""
    rows = stream.withWatermark("ts", delay).groupBy("chat_id")
    return rows.transformWithStateInPandas(Reminders(), "chat_id long, number int, at timestamp", "Append", "eventTime", initialState=before.groupBy("chat_id"))


def ended_uploads(rows: DataFrame, until: Column, minutes: int = 30) -> DataFrame:
    """What ``uploads`` gives of the same rows when its clock stands at ``until``."""
    order = W.partitionBy("chat_id").orderBy("ts", "id")
    after = F.lead(F.struct("id", "ts", "asks")).over(order).alias("after")
    ends = F.col("ts") + F.make_dt_interval(mins=F.lit(minutes))
    kind = F.when(F.col("after.ts") < ends, F.when(F.col("after.asks"), "replaced").otherwise("matched")).when(F.col("after").isNotNull() | (ends <= until), "expired")
    told = rows.select("chat_id", "id", "ts", "asks", after).filter("asks").withColumn("state", kind).filter("state IS NOT NULL")
    return told.select("chat_id", "id", F.when(F.col("state") == "matched", F.col("after.id")).alias("answer_id"), "state")


def ended_silences(rows: DataFrame, until: Column, days: int = SILENT_DAYS) -> DataFrame:
    """What ``silences`` gives of the same rows when its clock stands at ``until``."""
    after = F.lead("ts").over(W.partitionBy("source").orderBy("ts"))
    long = F.col("ts") + F.make_dt_interval(days=F.lit(days))
    return rows.select("source", "ts", after.alias("after")).filter(F.coalesce(F.col("after") >= long, long <= until)).select("source", F.col("ts").alias("since"))

"""Waits as streams against their batch versions and by hand, in any cut into batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewell.streaming import incremental as I
from tidewell.streaming import timers as M

T0 = dt.datetime(2024, 1, 1)
END = "TIMESTAMP '2024-03-01'"


def stream_of(spark, folder, rows, schema, parts):
    """The rows in files, a batch each, in the order of time; a last row of a key of its own moves the clock on."""
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/{k:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


@pytest.mark.parametrize("parts", [1, 4])
def test_uploads(spark, tmp_path, parts):
    r = random.Random(2)
    rows = sorted(((r.randint(1, 5), i, r.random() < 0.6, T0 + dt.timedelta(minutes=r.randint(0, 3000))) for i in range(120)), key=lambda x: (x[3], x[1]))
    rows.append((99, 1000, False, dt.datetime(2024, 3, 1)))
    schema = "chat_id long, id long, asks boolean, ts timestamp"
    got = I.run_to_table(M.uploads(stream_of(spark, f"{tmp_path}/in", rows, schema, parts), "0 seconds"), f"{tmp_path}/out").collect()
    expected = M.ended_uploads(spark.createDataFrame(rows, schema), F.expr(END)).collect()
    assert sorted(map(str, got)) == sorted(map(str, expected)) and {x.state for x in got} == {"matched", "replaced", "expired"}


@pytest.mark.parametrize("parts", [1, 5])
def test_silences(spark, tmp_path, parts):
    r = random.Random(3)
    rows = sorted(((r.choice("ab"), T0 + dt.timedelta(hours=r.randint(0, 1200))) for _ in range(25)), key=lambda x: x[1])
    rows.append(("z", dt.datetime(2024, 3, 1)))
    got = I.run_to_table(M.silences(stream_of(spark, f"{tmp_path}/in", rows, "source string, ts timestamp", parts), "0 seconds"), f"{tmp_path}/out").collect()
    expected = M.ended_silences(spark.createDataFrame(rows, "source string, ts timestamp"), F.expr(END)).collect()
    assert sorted(map(str, got)) == sorted(map(str, expected)) and len(got) > 3


@pytest.mark.parametrize("parts", [1, 3])
def test_reminders_begin_from_a_table(spark, tmp_path, parts):
    day = lambda n: T0 + dt.timedelta(days=n)
    before = spark.createDataFrame([(1, 3, day(0)), (2, 5, day(0)), (3, 0, day(-1))], "chat_id long, sent int, since timestamp")
    rows = [(4, False, day(1)), (3, True, day(4)), (5, False, day(6)), (99, True, day(60))]
    stream = stream_of(spark, f"{tmp_path}/in", rows, "chat_id long, pays boolean, ts timestamp", parts)
    got = sorted((x.chat_id, x.number, x.at) for x in I.run_to_table(M.reminders(stream, before, "0 seconds"), f"{tmp_path}/out").collect())
    due = lambda c, sent, start, most=5: [(c, sent + k, start + dt.timedelta(days=2 * k)) for k in range(1, most - sent + 1)]
    assert got == sorted(due(1, 3, day(0)) + due(3, 0, day(-1), 2) + due(4, 0, day(1)) + due(5, 0, day(6)))


def test_a_silence_of_just_the_days_counts(spark, tmp_path):
    """To the microsecond; no source's rows go to Python."""
    five = T0 + dt.timedelta(days=5)
    rows = [("a", T0), ("b", T0), ("c", T0), ("b", five - dt.timedelta(microseconds=1)), ("a", five), ("c", five + dt.timedelta(microseconds=1)), ("z", dt.datetime(2024, 3, 1))]
    stream = M.silences(stream_of(spark, f"{tmp_path}/in", rows, "source string, ts timestamp", 1), "0 seconds")
    assert "Python" not in stream._jdf.queryExecution().analyzed().toString() and "InPandas" not in stream._jdf.queryExecution().analyzed().toString()
    got = I.run_to_table(stream, f"{tmp_path}/out").collect()
    expected = M.ended_silences(spark.createDataFrame(rows, "source string, ts timestamp"), F.expr(END)).collect()
    assert sorted(map(str, got)) == sorted(map(str, expected))

"""Tables that change by batches, and messages that wait for their acknowledgement."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.merge import last_wins
from tidewell.sources.tables import BucketTable, Outbox
from tidewell.streaming import incremental as I

SCHEMA = T.StructType().add("k", "long").add("n", "long").add("v", "string")


def latest(old, new):
    return last_wins(old.unionByName(new), ["k"], ["n"])


def table(spark, path, buckets=16):
    return BucketTable(spark, f"file://{path}", SCHEMA, ["k"], latest, buckets)


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_batches_are_the_last_row_of_each_key(spark, tmp_path):
    r, known, t = random.Random(1), {}, table(spark, f"{tmp_path}/t")
    assert t.read().collect() == [] and t.version() is None
    for number in range(4):
        batch = [(k, number * 1000 + i, r.choice("abc")) for i, k in enumerate(r.choices([None, *range(60)], k=30))]
        t.merge(rows(spark, batch), number)
        for k, n, v in batch:
            known[k] = (k, n, v)
        assert {tuple(x) for x in t.read().collect()} == set(known.values()) and t.version() == number
    before = t.folder.bytes(), sorted(map(str, t.read().collect()))
    t.merge(rows(spark, [(1, 10**6, "again")]), 3)  # a batch that was taken in before
    assert before == (t.folder.bytes(), sorted(map(str, t.read().collect())))
    t.merge(rows(spark, []), 4)
    assert {tuple(x) for x in t.read().collect()} == set(known.values()) and t.version() == 4


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    t = table(spark, f"{tmp_path}/t")
    t.merge(rows(spark, [(k, 0, "x" * 50) for k in range(20_000)]), 0)
    whole = t.folder.bytes("data/version=0")
    t.merge(rows(spark, [(7, 1, "new")]), 1)
    assert t.folder.bytes("data/version=1") < whole / 8
    assert t.read().count() == 20_000 and t.read().filter("k = 7").first().v == "new"
    for number in range(2, 6):
        t.merge(rows(spark, [(k, number, "y") for k in range(20_000)]), number)
    assert t.folder.numbers("data", "version") == [4, 5] and t.folder.numbers("manifest", "version") == [4, 5]


def test_a_batch_that_stopped_before_its_manifest_is_run_again(spark, tmp_path):
    t = table(spark, f"{tmp_path}/t")
    t.merge(rows(spark, [(1, 0, "a"), (2, 0, "b")]), 0)
    real, t._drop = t._drop, lambda *a: None

    class Stop(Exception):
        pass

    merge, t.merge_rows = t.merge_rows, lambda old, new: (_ for _ in ()).throw(Stop())
    with pytest.raises(Stop):
        t.merge(rows(spark, [(1, 1, "c")]), 1)
    t.merge_rows, t._drop = merge, real
    rows(spark, [(1, 1, "half")]).withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(f"file://{tmp_path}/t/data/version=1")
    assert {tuple(x) for x in t.read().collect()} == {(1, 0, "a"), (2, 0, "b")}
    t.merge(rows(spark, [(1, 1, "c")]), 1)
    assert {tuple(x) for x in t.read().collect()} == {(1, 1, "c"), (2, 0, "b")}


def test_a_killed_run_resends_exactly_what_was_not_acknowledged(spark, tmp_path):
    box = Outbox(spark, f"file://{tmp_path}/o", SCHEMA, "k")
    sent = []

    def deliver(wanted, fail=()):
        def run(df):
            keys = sorted(r.k for r in df.collect())
            sent.append(keys)
            if "killed" in fail:
                raise RuntimeError
            return df.filter(~F.col("k").isin(*fail)) if fail else df

        return run(wanted)

    box.queue(rows(spark, [(k, 0, "x") for k in range(6)]), 0)
    assert box.send(lambda df: deliver(df, (2, 4))) == 1
    box.queue(rows(spark, [(k, 0, "y") for k in (10, 11)]), 1)
    assert {(r.k, r.batch) for r in box.pending().collect()} == {(2, 0), (4, 0), (10, 1), (11, 1)}
    with pytest.raises(RuntimeError):
        box.send(lambda df: deliver(df, ("killed",)))
    assert box.send(deliver) == 0
    assert sent == [[0, 1, 2, 3, 4, 5], [2, 4], [2, 4], [10, 11]]
    assert box.pending().collect() == [] and box.folder.numbers("queue", "batch") == []
    box.queue(rows(spark, [(0, 0, "x")]), 0)  # a batch that is run again after it was sent whole
    assert box.pending().collect() == [] and box.send(deliver) == 0 and len(sent) == 4


def test_streams_fill_tables_and_outboxes(spark, tmp_path):
    for i in range(3):
        rows(spark, [(k, i, f"v{i}") for k in range(i, 10)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = I.events(spark, f"{tmp_path}/in", "k long, n long, v string")
    t = table(spark, f"{tmp_path}/t")
    I.upserted(stream, t, f"{tmp_path}/c").awaitTermination()
    assert {(r.k, r.n) for r in t.read().collect()} == {(k, min(k, 2)) for k in range(10)}
    box, sent = Outbox(spark, f"file://{tmp_path}/o", SCHEMA, "k"), []

    def deliver(df):
        sent.extend((r.k, r.n) for r in df.collect())
        return df.filter("k <> 3") if len(sent) <= 10 else df

    I.delivered(stream, box, deliver, f"{tmp_path}/d").awaitTermination()
    assert set(sent) == {(k, n) for n in range(3) for k in range(n, 10)} and sent.count((3, 0)) == 2 and box.pending().collect() == []


def test_assets_of_one_key_make_no_pairs(spark):
    """Every join of wanted assets meets one row for a key, however many assets share it."""
    from tidewell.operators import merge as G

    assets = spark.range(50).selectExpr("id + 7 AS id", "'n' AS norma_id", "'pdf' AS asset_tipo", "CASE WHEN id % 2 = 0 THEN '' END AS asset_subtipo", "CASE WHEN id > 0 THEN 'f' END AS file_name", "CASE WHEN id < 2 THEN 'd' END AS drive_file_id")
    wanted = spark.range(5).selectExpr("id AS wanted_id", "'n' AS norma_id", "'pdf' AS asset_tipo", "CAST(NULL AS STRING) AS asset_subtipo", "CASE WHEN id < 3 THEN 'f' END AS file_name", "CASE id WHEN 2 THEN 'd' WHEN 3 THEN 'd' WHEN 4 THEN 'e' END AS drive_file_id")
    made = G.reused_assets(wanted, assets)
    assert sorted((r.wanted_id, r.asset_id, r.action) for r in made.collect()) == [(0, 8, "reuse"), (1, 8, "reuse"), (2, 7, "reuse"), (3, 7, "reuse"), (4, None, "insert")]
    assert made._jdf.queryExecution().optimizedPlan().toString().count("min(id#") == 2

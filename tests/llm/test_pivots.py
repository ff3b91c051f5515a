"""Exact top-k search against all pairs."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidewell.llm import pivots, queries

SF = "/root/testdata/sf0.001"


def found(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id int, rank string" if rows and len(rows[0]) == 4 else "vec_id long, embedding array<double>")
    return sorted(map(tuple, pivots.top_k(df, F.col("vec_id") % 100 == 0, k).collect()))


def test_same_as_sql(spark):
    same(queries.op13_pivot_table(spark, SF), queries.OP13_SQL, connect(SF))


def test_many_blocks_of_clusters_ties_and_one_common_vector(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 16), ("QUERY_ROWS", 3), ("REMEMBERED", 1)):
        monkeypatch.setattr(pivots, name, value)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 5)) * 3
    vectors = [(centres[rng.integers(6)] + rng.normal(size=5) / 20).tolist() for _ in range(700)]
    rows = [(i, vectors[5] if i % 3 == 0 else v) for i, v in enumerate(vectors)] + [(10**6 + i, np.round(rng.normal(size=5)).tolist()) for i in range(300)]
    assert found(spark, rows) == sorted(brute(rows, 10))


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 2.0], 1, "a"), (100, [], 1, None), (1, None, 1, "a"), (2, [1.0, None], 1, "a"), (3, [nan, 1.0], 1, "a"), (4, [inf], 1, "a"), (None, [1.0], 1, "a"), (5, [1.0, 2.0], 1, "a"), (5, [1.0, 2.0], 1, "a"),
        (6, [3.0], 1, "a"), (7, [1.0, 2.0, -9.0, 4.0], 1, "a"), (8, [1e30, -1.0], 1, "a"), (9, [-1e30, 2.5], 1, "a"), (200, [1e25, 1e25], 1, "a"), (200, [1e24, 1e25], 1, "a"), (10, [0.0005, -0.0005], 1, "a"),
    ]
    assert found(spark, rows, 4) == sorted(brute(rows, 4))
    assert found(spark, []) == []


def brute(rows, k):
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in whole if i % 100 == 0}):
        mine = min((np.trim_zeros(np.array(v, float), "b").tobytes(), v) for i, v in whole if i == q)[1]
        scored = sorted((-min(max(sum(a * b for a, b in zip(mine, v)), -(2**63)), 2**63 - 1), i) for i, v in whole if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


@given(st.lists(st.lists(st.integers(-50, 50), min_size=3, max_size=3), min_size=2, max_size=40), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_bounds_hold_and_the_search_stops_exactly(vectors, k):
    values = np.array(vectors, float)
    table = pivots.distances(values, pivots.farthest_first(values, 4))
    block = pivots.Vectors(np.arange(len(values)), values, pivots.norms_of(values), table)
    for q in range(len(values)):
        scores = (values @ values[q]).astype(int)
        assert (pivots.bounds(block.norms, table, block.norms[q], table[:, q]) >= scores).all()
        best = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:k]
        got = pivots.search(block, values[q], block.norms[q], table[:, q], q, k, pivots.LOW, pivots.HIGH, True)
        assert list(zip((-got[0]).tolist(), got[1].tolist())) == best


def test_few_candidates_are_evaluated_where_bounds_tell(monkeypatch):
    rng = np.random.default_rng(2)
    values = np.floor(np.concatenate([rng.normal(size=(50, 8)) * 20 + 400, rng.normal(size=(4000, 8)) * 20 - 400]))
    table = pivots.distances(values, pivots.farthest_first(values))
    block, seen = pivots.Vectors(np.arange(len(values)), values, pivots.norms_of(values), table), []
    real = pivots.products
    monkeypatch.setattr(pivots, "products", lambda a, b, plain: (seen.append(len(a)), real(a, b, plain))[1])
    pivots.search(block, values[0], block.norms[0], table[:, 0], 0, 10, pivots.LOW, pivots.HIGH, True)
    assert sum(seen) < 200


def test_blocks_are_read_a_few_at_a_time(spark):
    """Row groups of large cells are small: Spark's reader holds all rows of one at once."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from tidewell.llm import common, pivots

    rows = spark.range(60_000, numPartitions=2).select(F.col("id").alias("vec_id"), F.array(*[F.rand(k).cast("float") for k in range(64)]).alias("embedding"))
    table = pivots.pivot_table(rows.repartition(1), F.col("vec_id") % 1000 == 0, 10)
    files = {f.removeprefix("file://") for f in table.inputFiles()}
    groups = [m.row_group(g).total_byte_size for m in (pq.ParquetFile(f).metadata for f in files) for g in range(m.num_row_groups)]
    assert sum(groups) > 4 * common.GROUP_BYTES and max(groups) <= 2 * common.GROUP_BYTES


def test_each_block_is_handed_over_once_and_meets_shares_of_queries(spark, monkeypatch):
    """No pair of query group and block is a row; shares of queries, strips and numbers of all sizes change nothing."""
    for name, value in (("BLOCK_ROWS", 16), ("QUERY_ROWS", 3), ("STRIP", 5), ("ASKED_BYTES", 3000), ("MOST_SHARES", 3)):
        monkeypatch.setattr(pivots, name, value)
    rng = np.random.default_rng(3)
    rows = [(i * 10, (rng.normal(size=4) * [1.0, 1.0, 1.0, 1e3, 1e5, 1e9][i % 6]).tolist()) for i in range(200)] + [(i, [1.0, 1.0, 0.0, -0.0]) for i in range(95, 130)]
    assert found(spark, rows, 4) == sorted(brute(rows, 4))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert "Join" not in pivots.top_k(df, F.col("vec_id") % 100 == 0)._jdf.queryExecution().optimizedPlan().toString()

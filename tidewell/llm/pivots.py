"""Exact top-k by inner product, by elimination with a pivot table.

Vectors become whole numbers (``floor(scale * x)``).  Distances to ``PIVOTS`` pivots are
computed once for each vector; for a query q and a candidate x every pivot p gives
``|d(q, p) - d(x, p)| <= d(q, x)``, and the largest of these lower bounds gives an upper
bound of the inner product, ``(|q|^2 + |x|^2 - bound^2) / 2``.  The origin is a pivot, so
this is never weaker than Cauchy-Schwarz.  Candidates are evaluated in the order of their
bounds until the k-th best score is above the next bound; nothing else ends a search.

Rows are sorted by nearest pivot and distance to it and packed into blocks.  The k-th best
score of a query inside its own block, found in the order of the bounds, is where its search
of the other blocks starts.  There the ranges of distances of a block, and of each ``STRIP``
of its rows, bound all these rows at once; what they leave open is evaluated for many
queries by one product of matrices, in single precision where that is exact.

A task holds a share of the queries, bounded in bytes, and their k best so far, while a share
of the blocks streams past it, so every block is handed to it once and no pair of query and
block is a row.  Nothing is broadcast but the pivots, whose number is fixed; they are chosen
by farthest-first traversal of ``SAMPLE`` rows.  Whole numbers of 16 bits are shuffled as such,
without their distances, which are sooner computed again.

Defined results of odd rows: a vector that is null, or holds a null or a component that is
not finite (also after scaling), takes no part, nor does a row without an id.  Vectors of
different lengths compare as if the shorter one ended in zeros; an empty vector scores 0.
Repeated rows are candidates each; rows with the query's own id are none.  Of several
different vectors of one query id the least by bytes, without zeros at its end, is the query.  Scores beyond 64 bits
count as the largest or smallest long.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import partitions, small_batches, stored, stored_large

PIVOTS = 32
#: Rows that pivots are chosen from; the choice changes the speed, never a result.
SAMPLE = 1024
#: Rows and bytes of a block of candidates, queries of a group.
BLOCK_ROWS, BLOCK_BYTES, QUERY_ROWS = 2048, 4 << 20, 1024
#: Rows of a block that share ranges of distances.
STRIP = 256
#: Hits that a task remembers before it sorts them among the k best of their queries.
REMEMBERED = 1 << 18
#: Bytes of queries that a task holds, and shares of blocks; beyond it they are larger.
ASKED_BYTES, MOST_SHARES = 64 << 20, 256
#: Rows of a result batch.
OUT_ROWS = 1 << 16
LOW, HIGH = -(2**63), 2**63 - 1
#: Rounding of distances, relative: bounds are widened by it.
LOOSE = 1e-12

PLACED = pa.schema([("id", pa.int64()), ("v", pa.binary()), ("small", pa.bool_()), ("query", pa.bool_()), ("cell", pa.int32()), ("near", pa.float64())])
BLOCKS = pa.schema([("n", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()), ("distances", pa.binary()), ("queries", pa.list_(pa.struct([("row", pa.int32()), ("least", pa.int64()), ("least_id", pa.int64())])))])
SENT = pa.schema([("n", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()), ("small", pa.bool_()), ("block", pa.int64())])
QUERIES = pa.schema([("id", pa.int64()), ("v", pa.binary()), ("least", pa.int64()), ("least_id", pa.int64()), ("home", pa.int64())])
GROUPS = pa.schema([("n", pa.int32()), ("ids", pa.binary()), ("values", pa.binary()), ("small", pa.bool_()), ("least", pa.binary()), ("least_ids", pa.binary())])
FOUND = "query_id long, vec_id long, score long"


class Vectors(NamedTuple):
    ids: np.ndarray
    values: np.ndarray
    norms: np.ndarray
    distances: np.ndarray  # a row for each pivot


class Asked(NamedTuple):
    """Queries that a task holds, with the k best of each so far: what is not there yet is LOW and HIGH."""

    vectors: Vectors
    single: np.ndarray
    least: np.ndarray
    least_ids: np.ndarray
    scores: np.ndarray
    ids: np.ndarray


def _ddl(schema: pa.Schema) -> str:
    from pyspark.sql.pandas.types import from_arrow_schema

    return from_arrow_schema(schema).simpleString().removeprefix("struct<").removesuffix(">")


def matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors as rows, the shorter ones ending in zeros."""
    out = np.zeros((len(vectors), max([1, *map(len, vectors)])))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def exact(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether doubles hold all inner products of rows of both, and all sums on the way, exactly."""
    return a.size == 0 or b.size == 0 or max(a.shape[1], b.shape[1]) * float(np.abs(a).max()) * float(np.abs(b).max()) < 2**53


def products(a: np.ndarray, b: np.ndarray, plain: bool) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b`` as longs."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    if plain:
        return (a @ b.T).astype(np.int64)
    whole = [[sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for s in b.tolist()] for r in a.tolist()]
    return np.array([[min(max(x, LOW), HIGH) for x in r] for r in whole], np.int64).reshape(len(a), len(b))


def norms_of(values: np.ndarray) -> np.ndarray:
    return np.sqrt((values * values).sum(axis=1))


def distances(values: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """A row for each pivot: the distances of all vectors to it."""
    width = max(values.shape[1], pivots.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (values, pivots))
    if exact(a, a) and exact(b, b) and exact(a, b):
        squares = (a * a).sum(axis=1)[None, :] + (b * b).sum(axis=1)[:, None] - 2 * (b @ a.T)
        return np.sqrt(np.maximum(squares, 0))
    return np.array([norms_of(a - p) for p in b])


def farthest_first(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """The origin, then always the row that is farthest from all pivots so far."""
    chosen = [np.zeros(sample.shape[1])]
    gap = norms_of(sample)
    while len(chosen) < count and len(sample) and gap.max() > 0:
        chosen.append(sample[int(gap.argmax())])
        gap = np.minimum(gap, norms_of(sample - chosen[-1]))
    return np.array(chosen)


def bounds(norms: np.ndarray, table: np.ndarray, q_norm: float, q_table: np.ndarray) -> np.ndarray:
    """Upper bounds of a query's inner products with vectors of these norms and distances to the pivots."""
    with np.errstate(over="ignore", invalid="ignore"):
        lower = np.maximum((np.abs(table - q_table[:, None]) - LOOSE * (table + q_table[:, None])).max(axis=0), 0)
        upper = (q_norm * q_norm + norms * norms) * (1 + 1e-9) / 2 + 1 - lower * lower / 2
    return np.maximum(np.nan_to_num(upper, nan=np.inf, posinf=np.inf), LOW)


def search(block: Vectors, q: np.ndarray, q_norm: float, q_table: np.ndarray, own: int, k: int, least: int, least_id: int, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of a block for a query among those no worse than (least, least_id)."""
    upper = bounds(block.norms, block.distances, q_norm, q_table)
    upper[block.ids == own] = -np.inf
    open_rows = np.flatnonzero(upper >= least)
    order = open_rows[np.argsort(-upper[open_rows], kind="stable")]
    scores, ids, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 4 * k
    while at < len(order) and upper[order[at]] >= least:
        rows = order[at : at + step]
        at, step = at + step, 2 * step
        scores = np.concatenate([scores, products(block.values[rows], q[None, :], plain)[:, 0]])
        ids = np.concatenate([ids, block.ids[rows]])
        good = np.flatnonzero((scores > least) | ((scores == least) & (ids <= least_id)))
        good = good[np.lexsort((ids[good], ~scores[good]))][:k]
        scores, ids = scores[good], ids[good]
        if len(scores) == k:
            least, least_id = int(scores[-1]), int(ids[-1])
    return scores, ids


def packed(values: np.ndarray) -> tuple[bytes, bool]:
    """Whole numbers as bytes, and whether these hold 16 bits each, else doubles."""
    small = bool((np.abs(values) < 2**15).all())
    return values.astype(np.int16 if small else np.float64).tobytes(), small


def unpacked(data, small: bool, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if small else np.float64).astype(np.float64).reshape(rows, -1)


def _longs(data) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _placed(pivots: np.ndarray, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            flat, ends = np.floor(np.asarray(lists.flatten(), np.float64) * scale), (lists.offsets.to_numpy() - lists.offsets[0].as_py())
            vectors = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            if not vectors:
                continue
            table = distances(matrix(vectors), pivots)
            cell, stored_as = table.argmin(axis=0), list(map(packed, vectors))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([v for v, _ in stored_as], pa.binary()), pa.array([small for _, small in stored_as], pa.bool_()), batch.column("query"), pa.array(cell, pa.int32()), pa.array(table[cell, np.arange(len(cell))])], schema=PLACED)

    return run


def _blocks(pivots: np.ndarray, k: int):
    def block(ids: list[int], vectors: list[np.ndarray], query: list[bool]) -> pa.RecordBatch:
        values = matrix(vectors)
        made = Vectors(np.array(ids, np.int64), values, norms_of(values), distances(values, pivots))
        plain, starts = exact(values, values), []
        for row in np.flatnonzero(query).tolist():
            scores, found = search(made, values[row], made.norms[row], made.distances[:, row], ids[row], k, LOW, HIGH, plain)
            full = len(scores) == k
            starts.append({"row": row, "least": int(scores[-1]) if full else LOW, "least_id": int(found[-1]) if full else HIGH})
        return pa.RecordBatch.from_pylist([{"n": len(ids), "ids": made.ids.tobytes(), "values": values.tobytes(), "distances": made.distances.tobytes(), "queries": starts}], schema=BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], []), 0
        for batch in batches:
            for i, v, small, q in zip(*(batch.column(c).to_pylist() for c in ("id", "v", "small", "query")), strict=True):
                vector = np.frombuffer(v, np.int16 if small else np.float64)
                width = max([len(vector), size])
                if held[0] and (len(held[0]) >= BLOCK_ROWS or (len(held[0]) + 1) * 8 * width > BLOCK_BYTES):
                    yield block(*held)
                    held, width = ([], [], []), len(vector)
                size = width
                for column, value in zip(held, (i, vector, q), strict=True):
                    column.append(value)
        if held[0]:
            yield block(*held)

    return run


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            data, small = packed(unpacked(r["values"], False, r["n"]))
            yield pa.RecordBatch.from_pylist([r | {"values": data, "small": small}], schema=SENT)


def _queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            rows = [q["row"] for q in r["queries"]]
            ids, values = _longs(r["ids"]), unpacked(r["values"], False, r["n"])
            yield pa.RecordBatch.from_pylist(
                [{"id": int(ids[x]), "v": np.trim_zeros(values[x] + 0.0, "b").tobytes(), "least": q["least"], "least_id": q["least_id"], "home": r["block"]} for x, q in zip(rows, r["queries"], strict=True)], schema=QUERIES)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def group(rows: list[dict]) -> pa.RecordBatch:
        data, small = packed(matrix([np.frombuffer(r["v"], np.float64) for r in rows]))
        ids, least, least_ids = (np.array([r[c] for r in rows], np.int64).tobytes() for c in ("id", "least", "least_id"))
        return pa.RecordBatch.from_pylist([{"n": len(rows), "ids": ids, "values": data, "small": small, "least": least, "least_ids": least_ids}], schema=GROUPS)

    held: list[dict] = []
    size = 0
    for batch in batches:
        for row in batch.to_pylist():
            size = max(size, len(row["v"]))
            if held and (len(held) >= QUERY_ROWS or (len(held) + 1) * size > BLOCK_BYTES):
                yield group(held)
                held, size = [], len(row["v"])
            held.append(row)
    if held:
        yield group(held)


def _vectors(r: dict, pivots: np.ndarray) -> Vectors:
    values = unpacked(r["values"], r["small"], r["n"])
    return Vectors(_longs(r["ids"]), values, norms_of(values), distances(values, pivots))


def _open(asked: Asked, rows: np.ndarray, low: np.ndarray, high: np.ndarray, norm: float) -> np.ndarray:
    """Those of these queries that may find one of their k best among vectors of these ranges of distances and this norm at most."""
    table, norms = asked.vectors.distances[:, rows], asked.vectors.norms[rows]
    low, high = low[:, None], high[:, None]
    with np.errstate(over="ignore", invalid="ignore"):
        gap = np.maximum(np.maximum(table - high, low - table) - LOOSE * (table + high), 0).max(axis=0)
        upper = np.nan_to_num((norms**2 + norm**2) * (1 + 1e-9) / 2 + 1 - gap * gap / 2, nan=np.inf, posinf=np.inf)
    return rows[np.maximum(upper, LOW) >= asked.least[rows]]


def _raise(asked: Asked, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
    """Scores found for these queries go among their k best, which raise what the queries look for."""
    k = asked.scores.shape[1]
    good = (ids != asked.vectors.ids[rows]) & ((scores > asked.least[rows]) | ((scores == asked.least[rows]) & (ids <= asked.least_ids[rows])))
    rows, ids, scores = rows[good], ids[good], scores[good]
    if not len(rows):
        return
    hit, at = np.unique(rows, return_inverse=True)
    at, ids, scores = np.concatenate([at, np.repeat(np.arange(len(hit)), k)]), np.concatenate([ids, asked.ids[hit].ravel()]), np.concatenate([scores, asked.scores[hit].ravel()])
    order = np.lexsort((ids, ~scores, at))
    first = np.searchsorted(at[order], np.arange(len(hit)))  # each query has k at least
    best = order[first[:, None] + np.arange(k)]
    asked.scores[hit], asked.ids[hit] = scores[best], ids[best]
    last, last_id = asked.scores[hit, -1], asked.ids[hit, -1]
    better = (last > asked.least[hit]) | ((last == asked.least[hit]) & (last_id < asked.least_ids[hit]))
    asked.least[hit[better]], asked.least_ids[hit[better]] = last[better], last_id[better]


def _meet(asked: Asked, block: Vectors, single: np.ndarray) -> None:
    """Search a block for all these queries."""
    rows = _open(asked, np.arange(len(asked.least)), block.distances.min(axis=1), block.distances.max(axis=1), block.norms.max())
    if not len(rows):
        return
    width, k = min(block.values.shape[1], asked.single.shape[1]), asked.scores.shape[1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def sort() -> None:
        if found:
            _raise(asked, *map(np.concatenate, zip(*found, strict=True)))
            found.clear()

    for start in range(0, len(block.ids), STRIP):
        part = slice(start, start + STRIP)
        ids, table, norm = block.ids[part], block.distances[:, part], max(block.norms[part].max(), 1.0)
        some = _open(asked, rows, table.min(axis=1), table.max(axis=1), norm)
        # No sum of products on the way is above the product of the norms.
        with np.errstate(over="ignore"):
            size = np.maximum(asked.vectors.norms[some], 1) * norm
        for now, kind in ((some[size < 2**23], np.float32), (some[(size >= 2**23) & (size < 2**52)], np.float64)):
            if not len(now):
                continue
            mine, theirs = (asked.single, single) if kind == np.float32 else (asked.vectors.values, block.values)
            mine = mine[:, :width] if len(now) == len(mine) else mine[now, :width]
            scores = mine @ theirs[part, :width].T
            # Of equal scores only ids up to the last one count; where all of these are larger, only better scores do.
            wanted = np.where(ids.min() > asked.least_ids[now], np.minimum(asked.least[now], HIGH - 1) + 1, asked.least[now])
            hits = np.flatnonzero(scores >= wanted.astype(kind)[:, None])
            if len(hits):
                x, y = np.divmod(hits, len(ids))
                found.append((now[x], ids[y], scores.ravel()[hits].astype(np.int64)))
                if sum(len(f[0]) for f in found) > REMEMBERED:
                    sort()
        for q in some[~(size < 2**52)].tolist():
            best = search(Vectors(ids, block.values[part], block.norms[part], table), asked.vectors.values[q], asked.vectors.norms[q], asked.vectors.distances[:, q], int(asked.vectors.ids[q]), k, int(asked.least[q]), int(asked.least_ids[q]), False)
            found.append((np.full(len(best[0]), q), best[1], best[0]))
    sort()


def _found(pivots: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Asked] = []

        def told() -> Iterator[pa.RecordBatch]:
            for asked in held:
                x, y = np.nonzero((asked.scores > LOW) | (asked.ids < HIGH))
                for at in range(0, len(x), OUT_ROWS):
                    a, b = x[at : at + OUT_ROWS], y[at : at + OUT_ROWS]
                    yield pa.RecordBatch.from_arrays([pa.array(asked.vectors.ids[a]), pa.array(asked.ids[a, b]), pa.array(asked.scores[a, b])], names=["query_id", "vec_id", "score"])
            held.clear()

        share = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["share"] != share:
                    yield from told()
                    share = r["share"]
                made = _vectors(r, pivots)
                # Singles hold what is below 2^24 exactly; no larger number is used as one.
                with np.errstate(over="ignore"):
                    single = made.values.astype(np.float32)
                if r["asks"]:
                    n = len(made.ids)
                    held.append(Asked(made, single, _longs(r["least"]).copy(), _longs(r["least_ids"]).copy(), np.full((n, k), LOW, np.int64), np.full((n, k), HIGH, np.int64)))
                else:
                    for asked in held:
                        _meet(asked, made, single)
        yield from told()

    return run


def _table(rows: DataFrame, query: Column, k: int, key: str, vector: str, scale: float) -> tuple[DataFrame, np.ndarray]:
    spark = rows.sparkSession
    small_batches(spark)
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double") * scale) == float("inf"))
    valid = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("query")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad))
    sample = matrix([np.floor(np.array(r.v, np.float64) * scale) for r in valid.orderBy(F.xxhash64("id"), "id", "v").limit(SAMPLE).select("v").collect()])
    pivots = farthest_first(sample)
    placed = stored(valid.mapInArrow(_placed(pivots, scale), _ddl(PLACED)), "placed")
    order = placed.repartitionByRange(partitions(spark), "cell", "near", "id").sortWithinPartitions("cell", "near", "id")
    return stored_large(order.mapInArrow(_blocks(pivots, k), _ddl(BLOCKS)).withColumn("block", F.monotonically_increasing_id()), "blocks"), pivots


def pivot_table(rows: DataFrame, query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """Blocks of vectors with their distances to the pivots, and the queries in them with their k-th best score there."""
    return _table(rows, query, k, key, vector, scale)[0]


def top_k(rows: DataFrame, query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k candidates of the highest inner product for each row that ``query`` marks,
    equal scores by ascending id. All other rows are its candidates."""
    spark = rows.sparkSession
    blocks, pivots = _table(rows, query, k, key, vector, scale)
    count = blocks.agg(F.sum(F.size("queries"))).first()[0] or 0
    found = blocks.filter(F.size("queries") > 0).select("n", "ids", "values", "queries", "block").mapInArrow(_queries, _ddl(QUERIES))
    one = found.groupBy("id").agg(F.min(F.struct("v", "least", "least_id", "home")).alias("q")).select("id", "q.*")
    n = min(partitions(spark), -(-count // QUERY_ROWS) or 1)
    groups = stored_large(one.repartitionByRange(n, "home", "id").sortWithinPartitions("home", "id").mapInArrow(_groups, _ddl(GROUPS)), "queries")
    # A grid: as many shares of queries as fit a task's memory, each of which meets as many shares of blocks as there are tasks.
    held = groups.agg(F.sum(4 * F.octet_length("values") + F.col("n") * (8 * len(pivots) + 16 * k + 100))).first()[0] or 0
    asking, shares = -(-held // ASKED_BYTES) or 1, min(MOST_SHARES, partitions(spark))
    every = lambda c, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(c)
    in_turn = F.shiftright("block", 33) + F.col("block").bitwiseAND(2**33 - 1)  # blocks of one partition go to different shares
    columns = ["n", "ids", "values", "small", "least", "least_ids"]
    asks = groups.select(*columns, F.lit(True).alias("asks"), F.pmod(F.xxhash64("ids"), F.lit(asking)).cast("int").alias("of_queries"), every("of_blocks", shares))
    sent = blocks.select("n", "ids", "values", "block").mapInArrow(_sent, _ddl(SENT))
    met = sent.select(*columns[:4], F.lit(None).cast("binary").alias("least"), F.lit(None).cast("binary").alias("least_ids"), F.lit(False).alias("asks"), every("of_queries", asking), F.pmod(in_turn, F.lit(shares)).cast("int").alias("of_blocks"))
    both = asks.unionByName(met).withColumn("share", F.col("of_queries") * shares + F.col("of_blocks")).drop("of_queries", "of_blocks")
    best = both.repartitionById(asking * shares, "share").sortWithinPartitions("share", F.desc("asks")).mapInArrow(_found(pivots, k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

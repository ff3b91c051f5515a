"""Ranked lexical search over dual-sorted wavelet trees, a tree for each shard of documents.

A shard's posting lists follow each other in one sequence of local document numbers, each
list by falling impact.  A wavelet tree over this sequence keeps that order in every node,
where only the documents of the node's range are left: so a list is sorted by impact *and*
navigable by document.  In a node, the first posting of a term's range has the term's
highest impact among the node's documents, and the weighted sum of these is a bound of
their scores.  A search descends the best bounds first, all terms of the item together,
and ends when the k-th best score is above every bound that is left: the top k are exact.

Impact of a posting: ``(10^9 tf) div (1000 tf + 12 m)`` with ``m = 75 + (25 n N) div L``;
a term weighs ``floor(1000 ln((2N + 2) / (2 df + 1)))``.  Postings of every term of every
document are indexed.  Shards end at ``POSTINGS`` postings or ``DOCUMENTS`` documents,
whichever is first; a larger document has a shard of its own.

Defined results of odd rows: null or empty texts have no terms and are found by no item;
items without terms, or of terms that no document holds, give no rows.  Repeated documents
are found each; a document without an id counts and is found, behind equal scores that have
one.  Rows of items that repeat id and text are one item.  Empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import small_batches, stored

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Postings and documents of a shard: what a task holds at once.
POSTINGS, DOCUMENTS = 1 << 19, 1 << 16
#: Items that share a reading of a shard.
ITEMS = 256
#: Ranges of postings that a step of a search looks at together.
STEP = 4096
#: Items whose best scores so far a task remembers; forgetting costs time only.
REMEMBERED = 50_000
LAST = 2**63 - 1

SHARDS = pa.schema([("n_docs", pa.int32()), ("ids", pa.list_(pa.int64())), ("impacts", pa.binary()), ("levels", pa.list_(pa.binary())), ("terms", pa.list_(pa.string())), ("ends", pa.list_(pa.int32()))])
SHARDS_DDL = "n_docs int, ids array<long>, impacts binary, levels array<binary>, terms array<string>, ends array<int>"
FOUND = "item long, doc_id long, score long"

#: What separates terms becomes a blank, A-Z become a-z; all bytes beyond ASCII belong to terms.
_PLAIN = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


class Index(NamedTuple):
    shards: DataFrame  # shard and the columns of SHARDS
    documents: int  # with at least one term
    terms: int  # with repeats


def wavelet(sequence: np.ndarray, height: int) -> list[np.ndarray]:
    """Bits of each level: which half of its node's range each number is in. Every node keeps the order."""
    levels, at = [], sequence.astype(np.uint16)
    for level in range(height):
        key = at >> np.uint16(height - 1 - level)
        levels.append((key & 1).astype(np.uint8))
        at = at[np.argsort(key, kind="stable")]
    return levels


class Shard:
    """A shard in memory: for each level the ones before each place, the impacts in its order and where its nodes start."""

    def __init__(self, n_docs: int, impacts: np.ndarray, levels: list[np.ndarray]):
        self.height, size = len(levels), len(impacts)
        self.ones = np.zeros((max(1, self.height), size + 1), np.int32)
        self.impacts = np.empty((self.height + 1, size), np.int32)
        self.starts = [np.zeros(1, np.int32)]
        self.impacts[0] = impacts
        node = np.zeros(size, np.uint16)
        for level, bits in enumerate(levels):
            np.cumsum(bits, out=self.ones[level, 1:])
            key = (node << np.uint16(1)) | bits
            order = np.argsort(key, kind="stable")
            node = key[order]
            self.impacts[level + 1] = self.impacts[level][order]
            self.starts.append(np.searchsorted(node, np.arange(1 << (level + 1))).astype(np.int32))
        self.offsets = np.cumsum([0, *map(len, self.starts)])
        self.starts = np.concatenate(self.starts)

    def children(self, level: np.ndarray, node: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Both halves of each node, with the ranges of the terms in them."""
        begin = self.starts[self.offsets[level] + node]
        before = self.ones[level, begin]
        deep, at = level[:, None], self.offsets[level + 1] + 2 * node
        one_low, one_high = self.ones[deep, low] - before[:, None], self.ones[deep, high] - before[:, None]
        left, right = self.starts[at][:, None], self.starts[at + 1][:, None]
        zero_low, zero_high = low - begin[:, None] - one_low, high - begin[:, None] - one_high
        return (np.concatenate([level, level]) + 1, np.concatenate([2 * node, 2 * node + 1]), np.concatenate([left + zero_low, right + one_low]), np.concatenate([left + zero_high, right + one_high]))

    def bounds(self, level: np.ndarray, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sums of the first, so the highest, impacts of the ranges."""
        first = self.impacts[level[:, None], np.minimum(low, self.impacts.shape[1] - 1)].astype(np.int64)
        return np.where(high > low, first, 0) @ weights


def search(shard: Shard, ids: np.ndarray, low: np.ndarray, high: np.ndarray, weights: np.ndarray, k: int, least: int, least_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and local documents of the k best that are no worse than (least, least_id), scores above 0."""
    step = max(4, STEP // max(1, len(weights)))
    level, node, low, high = np.zeros(1, np.int64), np.zeros(1, np.int64), low[None, :], high[None, :]
    bound = shard.bounds(level, low, high, weights)
    scores, docs = np.empty(0, np.int64), np.empty(0, np.int64)
    while len(bound):
        # A node of the least score can only help if it holds a smaller id.
        ends = len(ids) - 1
        first = ids[np.minimum(node << (shard.height - level), ends)]
        keep = np.flatnonzero((bound > least) | ((bound == least) & (first <= least_id)))
        best = keep[np.lexsort((first[keep], -bound[keep]))]
        taken, rest = best[:step], best[step:]
        leaf = level[taken] == shard.height
        done, inner = taken[leaf], taken[~leaf]
        if len(done):
            scores, docs = np.concatenate([scores, bound[done]]), np.concatenate([docs, node[done]])
            order = np.lexsort((docs, ids[docs], -scores))[:k]
            scores, docs = scores[order], docs[order]
            if len(scores) == k:
                least, least_id = max((least, least_id), (int(scores[-1]), int(ids[docs[-1]])), key=lambda x: (x[0], -x[1]))
        made = shard.children(level[inner], node[inner], low[inner], high[inner])
        fresh = shard.bounds(made[0], made[2], made[3], weights)
        open_ = np.flatnonzero((fresh > 0) & (fresh >= least))
        level, node, low, high = (np.concatenate([x[rest], y[open_]]) for x, y in zip((level, node, low, high), made, strict=True))
        bound = np.concatenate([bound[rest], fresh[open_]])
    return scores, docs


def _shards(documents: int, terms: int, postings: int, most: int):
    def shard(rows: list[tuple[int | None, int, Counter]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: LAST if r[0] is None else r[0])
        names = sorted({t for _, _, found in rows for t in found})
        number = {t: i for i, t in enumerate(names)}
        sizes = [len(found) for _, _, found in rows]
        term = np.fromiter((number[t] for _, _, found in rows for t in found), np.int32, sum(sizes))
        tf = np.fromiter((n for _, _, found in rows for n in found.values()), np.int64, sum(sizes))
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        m = np.array([75 + 25 * n * documents // terms for _, n, _ in rows], np.int64)
        impact = 10**9 * tf // (1000 * tf + 12 * m[doc])
        order = np.lexsort((doc, -impact, term))
        height = (len(rows) - 1).bit_length()
        ends = np.cumsum(np.bincount(term, minlength=len(names)))
        return pa.RecordBatch.from_pylist(
            [{"n_docs": len(rows), "ids": [i for i, _, _ in rows], "impacts": impact[order].astype("<i4").tobytes(), "levels": [np.packbits(x).tobytes() for x in wavelet(doc[order], height)],
              "terms": [t.decode() for t in names], "ends": ends.tolist()}], schema=SHARDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, int, Counter]] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = Counter(terms_of(text.as_py()))
                if not found:
                    continue
                if held and (size + len(found) > postings or len(held) == most):
                    yield shard(held)
                    held, size = [], 0
                held.append((i, found.total(), found))
                size += len(found)
        if held:
            yield shard(held)

    return run


def build(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of all documents, in the cluster's shared folder. Shards follow the tasks that read the table: nothing is shuffled."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL")
    counted = rows.select(F.regexp_count("text", F.lit(TERM)).cast("long").alias("n"))
    documents, terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    made = rows.mapInArrow(_shards(documents, terms, POSTINGS, DOCUMENTS), SHARDS_DDL)
    return Index(stored(made.withColumn("shard", F.monotonically_increasing_id()), "wavelets"), documents, terms)


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        held: tuple[int | None, Shard | None, np.ndarray | None] = (None, None, None)
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row] for c in batch.schema.names}
                if held[0] != at["shard"].as_py():
                    impacts = np.frombuffer(at["impacts"].as_buffer(), "<i4")
                    levels = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(impacts)) for x in at["levels"]]
                    ids = at["ids"].values.fill_null(LAST).to_numpy(zero_copy_only=False)
                    held = at["shard"].as_py(), Shard(at["n_docs"].as_py(), impacts, levels), ids
                _, shard, ids = held
                known = np.array([x.is_valid for x in at["ids"].values]) if at["ids"].values.null_count else None
                work = {c: at["work"].values.field(c).to_numpy() for c in ("item", "low", "high", "weight")}
                order = np.argsort(work["item"], kind="stable")
                items, begins = np.unique(work["item"][order], return_index=True)
                out = []
                for item, part in zip(items.tolist(), np.split(order, begins[1:]), strict=True):
                    had = best.get(item, (np.empty(0, np.int64), np.empty(0, np.int64)))
                    least, least_id = (int(had[0][-1]), int(had[1][-1])) if len(had[0]) == k else (1, LAST)
                    scores, docs = search(shard, ids, work["low"][part], work["high"][part], work["weight"][part], k, least, least_id)
                    if not len(scores):
                        continue
                    out.append((np.full(len(docs), item), ids[docs], scores, np.ones(len(docs), bool) if known is None else known[docs]))
                    scores, found = np.concatenate([had[0], scores]), np.concatenate([had[1], ids[docs]])
                    top = np.lexsort((found, -scores))[:k]
                    if len(best) >= REMEMBERED:
                        best.clear()
                    best[item] = scores[top], found[top]
                if out:
                    item, doc, score, valid = (np.concatenate(c) for c in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=~valid), pa.array(score)], names=["item", "doc_id", "score"])

    return run


def top_documents(index: Index, items: DataFrame, k: int = 20, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of the highest score above 0 for each item, equal scores by ascending id."""
    small_batches(items.sparkSession)
    asked = items.select(F.col(key).alias("item_id"), F.col(text).cast("string").alias("text")).distinct().withColumn("item", F.monotonically_increasing_id())
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    wanted = stored(asked.select("item_id", "item", F.explode(words).alias("term")).groupBy("item_id", "item", "term").agg(F.count("*").alias("times")), "wanted")
    place = F.posexplode("terms").alias("p", "term")
    listed = index.shards.select("shard", "ends", place).select("shard", "term", F.when(F.col("p") == 0, 0).otherwise(F.get("ends", F.col("p") - 1)).alias("low"), F.get("ends", F.col("p")).alias("high"))
    hits = stored(listed.join(wanted.select("term").distinct(), "term", "left_semi"), "hits")
    df = hits.groupBy("term").agg(F.sum(F.col("high") - F.col("low")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * index.documents + 2) / (2 * F.col("df") + 1)))
    weights = wanted.join(df, "term").select("term", "item", (weight * F.col("times")).alias("weight")).filter("weight > 0")
    blocks = -(-wanted.select("item").distinct().count() // ITEMS) or 1
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    work = hits.join(weights, "term").groupBy("shard", block.alias("block")).agg(F.collect_list(F.struct("item", "low", "high", "weight")).alias("work"))
    read = index.shards.select("shard", "n_docs", "ids", "impacts", "levels").join(work, "shard").select("shard", "n_docs", "ids", "impacts", "levels", "work")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = read.mapInArrow(_searched(k), FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(wanted.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")

"""Best-fit-decreasing packing of token pieces into sequences of fixed capacity.

Lengths are whole numbers from 1 to the capacity, so what the packing needs to know
of the corpus is how many pieces there are of each length: ``capacity`` numbers,
however large the corpus.  ``plan`` runs best-fit decreasing over them with a
segment tree over remaining capacities: for each length, longest first, the tree
finds the tightest remaining capacity that some open bin has, in logarithmic time.
Bins with the same history are one *run*, so pieces are placed by the run and not
one by one; the bins are those that best-fit decreasing makes piece by piece.

The plan says: pieces of length l with ranks [first, first + n) go to bins from
``bin`` on, ``each`` of them to a bin, from ``offset`` on.  Ranks within a length
are local ranks in a (length, salt) group plus the counts of smaller salts.  A length
has as many salts as it has parts of a task's share of all pieces, so one that holds most
pieces is spread over most tasks.  The plan's rows are bounded by the capacity alone, the
groups by the capacity and ``SPREAD`` for each shuffle partition; both go to the tasks.

Cases: a null or empty text is one piece that holds the end id; repeated rows and
rows with a null id are packed each; a text of any length is cut into pieces of the
capacity, of which the first may be shorter; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType, StructField, StructType

from tidewell.llm.common import id_and_text, partitions, rows_of, small_batches, stored
from tidewell.llm.units import unit_encoder

CAPACITY = 1024
#: Groups of ranks for each shuffle partition, besides one for each length.
SPREAD = 4


class Capacities:
    """A segment tree over remaining capacities 0 .. top: which of them some open bin has."""

    def __init__(self, top: int):
        self.size = 1 << (top + 1).bit_length()
        self.some = bytearray(2 * self.size)

    def set(self, capacity: int, has: bool) -> None:
        at = self.size + capacity
        self.some[at] = has
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] | self.some[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that some bin has."""
        at = self.size + least
        if self.some[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, pieces, first bin, pieces for each bin, offset)."""
    tree, runs = Capacities(capacity), [deque() for _ in range(capacity + 1)]  # runs of (first bin, bins), first in first out
    out, bins = [], 0

    def put(left: int, first: int, n: int) -> None:
        if not runs[left]:
            tree.set(left, True)
        runs[left].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            left = tree.tightest(length)
            if left is None:  # new bins, each filled before the next is opened
                each = capacity // length
                full, rest = divmod(todo, each)
                if full:
                    out.append((length, rank, full * each, bins, each, 0))
                    put(capacity - each * length, bins, full)
                if rest:
                    out.append((length, rank + full * each, rest, bins + full, rest, 0))
                    put(capacity - rest * length, bins + full, 1)
                bins += full + (rest > 0)
                break
            first, n = runs[left].popleft()
            if not runs[left]:
                tree.set(left, False)
            each = left // length
            used = min(n, todo // each)
            if used:
                out.append((length, rank, used * each, first, each, capacity - left))
                put(left - each * length, first, used)
                rank, todo = rank + used * each, todo - used * each
                if used < n:
                    (runs[left].appendleft if runs[left] else lambda r: put(left, *r))((first + used, n - used))
            else:  # fewer pieces than one bin takes
                out.append((length, rank, todo, first, todo, capacity - left))
                put(left - todo * length, first, 1)
                if n > 1:
                    (runs[left].appendleft if runs[left] else lambda r: put(left, *r))((first + 1, n - 1))
                break
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every whole text with its end id."""
    small_batches(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    out = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = unit_encoder(tokenizer), np.array([end_id], "<u4")
        for doc_ids, coded in encoder.groups(batches):
            rows = []
            for doc_id, own in zip(doc_ids, coded, strict=True):
                ids = np.append(own, end).astype("<u4")
                n, start, number = len(ids), 0, 0
                while start < n:
                    size = (n - start - 1) % capacity + 1 if number == 0 else capacity
                    part = ids[start : start + size].tobytes()
                    rows.append((doc_id, number, start, size, zlib.crc32(part)) + ((part,) if with_ids else ()))
                    start, number = start + size, number + 1
            yield rows_of(out, {f.name: [r[k] for r in rows] for k, f in enumerate(out)})

    return id_and_text(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def packed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows that have a ``length`` of 1 to ``capacity``, and a
    ``doc_id`` and ``piece`` that order pieces of one length. ``found`` should be a stored table: it is
    read twice, once for its lengths."""
    share = -(-found.count() // (SPREAD * partitions(found.sparkSession))) or 1
    many = found.groupBy("length").count().select(F.col("length").alias("of_"), F.ceil(F.col("count") / share).alias("salts"))  # capacity rows at most
    salted = found.join(F.broadcast(many), F.col("length") == F.col("of_")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")).drop("of_", "salts")
    sizes: dict[int, dict[int, int]] = {}
    for r in salted.groupBy("length", "salt").count().collect():  # capacity + SPREAD x partitions rows at most
        sizes.setdefault(r.length, {})[r.salt] = r["count"]
    rows = plan({k: sum(v.values()) for k, v in sizes.items()}, capacity)
    begins: dict[tuple[int, int], int] = {}
    for length, by in sizes.items():
        ahead = 0
        for salt in range(max(by) + 1):
            begins[length, salt] = ahead
            ahead += by.get(salt, 0)
    of: dict[int, list] = {}
    for row in rows:
        of.setdefault(row[0], []).append(row[1:])
    firsts = {k: [r[0] for r in v] for k, v in of.items()}
    local = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("local", local)
    names = found.columns
    added = StructType([*found.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for length, salt, rank in zip(*(batch.column(c).to_pylist() for c in ("length", "salt", "local")), strict=True):
                at = begins[length, salt] + rank - 1
                k = bisect.bisect_right(firsts[length], at) - 1
                first, _, bin_, each, begin = of[length][k]
                q, r = divmod(at - first, each)
                sequence.append(bin_ + q)
                offset.append(begin + r * length)
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, added)


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``"""
    return packed(stored(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)


def one_by_one(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Best-fit decreasing piece by piece, as the plan is defined (for tests and small inputs)."""
    tree, open_, bins = Capacities(capacity), [deque() for _ in range(capacity + 1)], []
    for length in sorted(map(int, lengths), reverse=True):
        left = tree.tightest(length)
        if left is None:
            bins.append([])
            b, left = len(bins) - 1, capacity
        else:
            b = open_[left].popleft()
            if not open_[left]:
                tree.set(left, False)
        bins[b].append(length)
        rest = left - length
        if not open_[rest]:
            tree.set(rest, True)
        open_[rest].append(b)
    return bins

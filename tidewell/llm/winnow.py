"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling hash; in each window of ``window``
consecutive hashes the smallest is chosen, the rightmost of equal ones, and its
position is kept.  Two texts that share a passage of ``k + window - 1`` code points
therefore share a chosen hash.  A text shorter than k is one gram; one with fewer
hashes than a window has one window; the empty text has no hashes.

Likeness of two fingerprints is the Dice coefficient of their multisets of hashes,
1 if both are empty.

Cases: a null text is the empty text; equal ``doc_id`` are ordered by text; a null
``doc_id`` comes first; a table of one row is its own next document; an empty table
gives no rows; other columns are ignored; work is linear in a text's length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import boundaries, bucket_of, id_and_text, nothing_held, partitions, rows_of, small_batches

#: Code points of a gram, hashes of a window.
GRAM, WINDOW = 16, 16
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: A hash keeps its 44 high bits for comparison; the low bits hold the place in a piece of the text, later places smaller.
_PLACE = 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(points: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Rolling hash of each k-gram, by doubling: the hash of 2m points from those of two halves."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.uint64)
    k = min(k, n)
    powers, value, length = [], points.astype(np.uint64) + np.uint64(1), 1
    base = _BASE
    out, done = None, 0
    while True:
        if k & length:  # put the halves that k's bits name one after another
            if out is None:
                out, done = value, length
            else:
                m = n - done - length + 1
                out = out[:m] * np.uint64(base) + value[done : done + m]
                done += length
        if done == k:
            break
        m = n - 2 * length + 1
        value = value[:m] * np.uint64(base) + value[length : length + m]
        base = base * base & _MASK
        length *= 2
    out = out[: n - k + 1].copy()
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(29)
    return out


def winnow(text: str, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes and their positions, in order of position."""
    hashes = gram_hashes(code_points(text), k)
    n = len(hashes)
    if n == 0:
        return hashes, np.zeros(0, np.int64)
    w = min(window, n)
    step = (1 << _PLACE) - w + 1  # windows of a piece; pieces overlap by a window less one, so each window is in one
    if step < 1:
        raise ValueError("the window is too wide")
    at = np.unique(np.concatenate([begin + _chosen(hashes[begin : begin + step + w - 1], w) for begin in range(0, n - w + 1, step)]))
    return hashes[at] >> np.uint64(_PLACE), at


def _chosen(hashes: np.ndarray, w: int) -> np.ndarray:
    """The place of each window's smallest hash, of equal ones the rightmost; at most 2 ** _PLACE hashes."""
    low = np.uint64((1 << _PLACE) - 1)
    least = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    length, windows = 1, len(hashes) - w + 1
    while length * 2 <= w:
        least = np.minimum(least[: len(least) - length], least[length:])
        length *= 2
    if length < w:
        least = np.minimum(least[:windows], least[w - length : w - length + windows])
    return (low - (least & low)).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) + len(b) == 0:
        return 1.0
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    if len(x) == 0 or len(y) == 0:
        return 0.0
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    shared = np.where(y[at] == x, np.minimum(nx, ny[at]), 0).sum()
    return float(2 * shared / (len(a) + len(b)))


def digest(hashes: np.ndarray, at: np.ndarray) -> str:
    """Number of chosen hashes and a 128-bit hash of all of them with their positions."""
    body = hashes.astype("<u8").tobytes() + at.astype("<u8").tobytes()
    return f"{len(hashes)}:{xxhash.xxh3_128_hexdigest(body)}"


def fingerprints(docs: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``doc_id, hashes, positions`` of every whole text; no shuffle."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in batches:
            found = [winnow(t, k, window) for t in batch.column("text").to_pylist()]
            yield rows_of(out, {"doc_id": batch.column("doc_id").to_pylist(), "hashes": [h.astype(np.int64) for h, _ in found], "positions": [p for _, p in found]})

    return id_and_text(docs).mapInArrow(run, "doc_id long, hashes array<long>, positions array<long>")


def followed(docs: DataFrame) -> DataFrame:
    """Rows in ascending ``doc_id`` order, dealt to partitions by ranges; the first rows of each
    range (and of the table) are also put behind the last ones of the range before it, marked
    ``again``, so that each row's next row is in its own partition. One shuffle of the texts."""
    n = partitions(docs.sparkSession)
    bounds = boundaries(docs, "doc_id", n)
    least = docs.agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    first = F.col("doc_id").isNull() if least.nulls else F.col("doc_id") == F.lit(least.least)
    own, last = bucket_of("doc_id", bounds), len(bounds)
    begins = F.col("doc_id").isin(bounds) if bounds else F.lit(False)
    places = F.array(F.struct(own.alias("bucket"), F.lit(0).alias("again")))
    places = F.when(begins, F.array_append(places, F.struct((own - 1).alias("bucket"), F.lit(1).alias("again")))).otherwise(places)
    places = F.when(F.coalesce(first, F.lit(False)), F.array_append(places, F.struct(F.lit(last).alias("bucket"), F.lit(2).alias("again")))).otherwise(places)
    dealt = docs.select("doc_id", "text", F.inline(places))
    return dealt.repartitionById(last + 1, "bucket").sortWithinPartitions("again", "doc_id", "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited_by_next(docs: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Fingerprints of each text and of the text whose last quarter is replaced from the next document."""
    small_batches(docs.sparkSession)

    def row(doc_id: int | None, text: str, own: tuple, after: str, next_own: tuple) -> tuple:
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        changed = winnow(edited, k, window)
        return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest(*own), digest(*changed), likeness(own[0], changed[0]), likeness(own[0], next_own[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        held, ended = None, False
        for batch in batches:
            rows = []
            for doc_id, text, again in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "again")), strict=True):
                if ended:
                    break
                now = (doc_id, text, winnow(text, k, window))
                if held is not None:
                    rows.append(row(*held, text, now[2]))
                held, ended = now, again > 0  # of the marked rows only the first follows this partition's last
            yield rows_of(_OUT, {f.name: [r[i] for r in rows] for i, f in enumerate(_OUT)})
        if held is not None and not ended:
            raise RuntimeError("a range of documents lacks the row that follows it")

    return followed(id_and_text(docs)).mapInArrow(run, OUT)

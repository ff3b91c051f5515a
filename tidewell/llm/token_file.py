"""Token-id output, Simple-8b coded.

A 64-bit word holds a 4-bit selector in its highest bits and 60 bits of ids.  The
selector names how many ids of which width follow, lowest bits first.  Ids that
need more than 60 bits are escaped: a word with selector 15 holds a place in the
exceptions kept beside the words.  Coding starts anew every ``BLOCK`` ids, and the
word at which each block starts is stored, so that a reader can decode all words
of one selector at once, or only the blocks it wants.

A file is a Parquet shard whose rows are segments of whole documents in ascending
``doc_id`` order: ``shard, segment, before, n_ids, doc_ids, lengths, offsets,
words, exceptions``.  ``before`` counts the shard's ids ahead of the segment.
Spark's committer writes the shards, so a lost executor's task is simply run again.

Cases: a null text is the empty text (only the end id); rows with equal ``doc_id``
each keep their own ids (in order of text); a null ``doc_id`` sorts first; an empty
table gives empty files; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.llm.common import id_and_text, in_order, rows_of, scratch, small_batches
from tidewell.llm.units import unit_encoder

#: (ids in a word, bits of each) by selector; 15 is the escape (fixed values of the format).
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
#: Bytes of units that a writer keeps, in each of two generations.
STORE = 150 << 20
#: Ids between two block starts.
BLOCK = 1024
#: Ids after which a segment of whole documents is closed.
SEGMENT = 1 << 19


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block, exceptions."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint64)
    bits = np.zeros(n + 64, np.uint8)
    most = int(ids.max())
    if most < 1 << 53:
        bits[:n] = np.frexp(ids.astype(np.float64))[1]  # exact up to 53 bits
    else:
        bits[:n] = [i.bit_length() for i in ids.tolist()]
    widest = {1: bits}
    for p in (2, 4, 8, 16, 32):
        half = widest[p // 2]
        widest[p] = np.maximum(half[: len(half) - p // 2], half[p // 2 :])
    choice = np.full(n, ESCAPE, np.uint8)
    for selector in range(len(SELECTORS) - 1, -1, -1):
        count, width = SELECTORS[selector]
        p = 1 << (count.bit_length() - 1)
        top = np.maximum(widest[p][:n], widest[p][count - p : count - p + n])
        np.copyto(choice, selector, where=top <= width)
    counts = np.array([c for c, _ in SELECTORS] + [1, 1], np.int64)
    place = np.arange(n)
    after = np.minimum(place + counts[choice], np.minimum((place // BLOCK + 1) * BLOCK, n))
    at = np.arange(0, n, BLOCK)
    stop = np.minimum(at + BLOCK, n)
    begins = np.zeros(n, bool)
    while len(at):  # all blocks take a word at once
        begins[at] = True
        at = after[at]
        going = at < stop
        at, stop = at[going], stop[going]
    starts = np.flatnonzero(begins)
    chosen = choice[starts]
    held = np.append(starts[1:], n) - starts  # ids in each word; a block's last one may be short
    padded = np.append(ids, np.zeros(64, np.uint64))
    words = np.zeros(len(starts), np.uint64)
    for selector in np.unique(chosen).tolist():
        if selector < ESCAPE:
            of = np.flatnonzero(chosen == selector)
            count, width = SELECTORS[selector]
            first = starts[of]
            packed = padded[first]
            for lane in range(1, count):
                packed |= padded[first + lane] << np.uint64(lane * width)
            words[of] = packed & ((np.uint64(1) << (held[of] * width).astype(np.uint64)) - np.uint64(1)) | np.uint64(selector << 60)
    escaped = np.flatnonzero(chosen == ESCAPE)
    words[escaped] = np.arange(len(escaped)).astype(np.uint64) | np.uint64(ESCAPE << 60)
    offsets = np.searchsorted(starts, np.arange(0, n, BLOCK)).astype(np.int32)
    return words, offsets, ids[starts[escaped]]


def unpack(words: np.ndarray, offsets: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    """The ids again: one vector operation per selector.

    A block's last word may hold fewer ids than its selector says; blocks are decoded with room
    behind them for the rest."""
    if n == 0:
        return np.zeros(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    small = len(exceptions) == 0 and chosen.max(initial=0) < 13
    stride = BLOCK + 64
    out = np.zeros((len(offsets), stride), np.uint32 if small else np.uint64)
    flat = out.reshape(-1)
    counts = np.array([c for c, _ in SELECTORS] + [1, 1], np.int64)[chosen]
    running = np.cumsum(counts) - counts
    sizes = np.diff(np.append(offsets, len(words)))
    place = running + np.repeat(np.arange(len(offsets)) * stride - running[offsets], sizes)
    for selector in np.unique(chosen).tolist():
        of = np.flatnonzero(chosen == selector)
        if selector == ESCAPE:
            flat[place[of]] = exceptions[(words[of] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        count, width = SELECTORS[selector]
        held, at, mask = words[of], place[of], np.uint64((1 << width) - 1)
        for lane in range(count):
            flat[at + lane] = held >> np.uint64(lane * width) & mask
    return out[:, :BLOCK].reshape(-1)[:n]


FILE = "shard int, segment long, before long, n_ids long, doc_ids array<long>, lengths array<long>, offsets array<int>, words binary, exceptions binary"
_FILE = pa.schema([("shard", pa.int32()), ("segment", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("words", pa.binary()), ("exceptions", pa.binary())])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every whole text, append ``end_id``, and write shards in ascending ``doc_id`` order to ``path``."""
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = unit_encoder(tokenizer, STORE), np.array([end_id], "<u4")
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for own in held for x in (own, end)])
            words, offsets, exceptions = pack(ids)
            return rows_of(_FILE, {"shard": [shard], "segment": [segment], "before": [before], "n_ids": [len(ids)], "doc_ids": [names], "lengths": [[len(own) + 1 for own in held]], "offsets": [offsets], "words": [words.astype("<u8").tobytes()], "exceptions": [exceptions.astype("<u8").tobytes()]})

        for doc_ids, coded in encoder.groups(batches):
            for doc_id, ids in zip(doc_ids, coded, strict=True):
                held.append(ids)
                names.append(doc_id)
                size += len(ids) + 1
                if size >= SEGMENT:
                    yield close()
                    segment, before, size, held, names = segment + 1, before + size, 0, [], []
        if held:
            yield close()

    ordered = in_order(id_and_text(docs), "doc_id", "text")
    ordered.mapInArrow(write, FILE).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, digests: bool = False) -> DataFrame:
    """``doc_id, start, ids`` of every document, ``ids`` as little-endian unsigned 32-bit integers; with
    ``digests`` instead of them ``n_tokens`` and ``ids_crc32``, so that the ids stay in the reader.

    ``start`` counts the ids of all documents before it. Only the shards' totals, one
    row for each file, are gathered to compute it.
    """
    files = spark.read.schema(FILE).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    ahead = totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("ahead"))
    kept = [("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] if digests else [("ids", pa.binary())]
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), *kept])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(np.frombuffer(row["words"], "<u8"), np.array(row["offsets"], np.int64), np.frombuffer(row["exceptions"], "<u8"), row["n_ids"]).astype("<u4").tobytes()
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                parts = [ids[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                body = {"n_tokens": lengths, "ids_crc32": list(map(zlib.crc32, parts))} if digests else {"ids": parts}
                yield rows_of(out, {"doc_id": row["doc_ids"], "start": row["ahead"] + row["before"] + ends - lengths} | body)

    joined = files.join(F.broadcast(ahead), "shard")  # one row for each shard: bounded by the number of write tasks
    return joined.mapInArrow(read, "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if digests else "ids binary"))


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents' files, written and read back."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path, digests=True)

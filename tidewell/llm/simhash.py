"""SimHash near-duplicates by segment popcounts.

A text's fingerprint is 64 bits over its word shingles.  A fingerprint is mapped to
the bit counts of its 32 segments of two bits.  Two fingerprints that differ in d
bits have counts whose Manhattan distance is at most d, so a range join of the
counts within ``distance`` finds every pair.

The range join is a grid: the segments are put in groups, and a cell is
the counts of all groups but ``distance``.  A pair within the distance leaves at
least so many groups without any difference, so it shares a cell.  More groups make more and finer cells; their number follows
that of the fingerprints (``groups_for``), so that chance neighbours of a fingerprint stay
few at any size, and every number of groups gives the same links.  Cells with one
fingerprint are dropped; in the others a pass that keeps the Manhattan bound and
then the exact bit count links fingerprints.  It emits a spanning forest of each
cell's links, one row a fingerprint at most, never all pairs: a fingerprint reached
once is not compared again as a target.  A cell of more than ``CELL`` fingerprints
is split into blocks and each pair of blocks is a task of its own, so no task holds
more than two blocks.

Components are found on distinct fingerprints by large-star and small-star rounds
over tables in the shared folder; nothing is gathered on the driver but counts.

Cases: a null or empty text has fingerprint zero and links like any other; repeated
rows share a fingerprint; rows without an id link, and connect others, like any; their
component is the smallest id that it holds, null if it holds none; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tidewell.llm.common import fair_join, id_and_text, nothing_held, rows_of, small_batches, stored

SEED = 42
#: Numbers of groups, and the neighbours by chance that a fingerprint may have in its cells.
GROUPS, NEIGHBOURS = (6, 8, 10, 12), 50
#: Fingerprints of a cell that one task compares; larger cells are split into blocks of this size.
CELL = 20_000
#: Rows of a cell up to which all its links are given.
SMALL = 32
_PAIRS = 0x5555555555555555


def shingle_hashes(text: str, words: int) -> np.ndarray:
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), SEED)], np.uint64)
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(text: str, words: int = 3) -> int:
    """Unsigned 64 bits: those set in over half the hashes of the text's shingles, repeats counted."""
    hashes = shingle_hashes(text, words)
    if len(hashes) == 0:
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long)."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64)
            yield rows_of(out, {"doc_id": batch.column("doc_id").to_pylist(), "fp": fps.view(np.int64)})

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def segment_counts(fp: np.ndarray) -> np.ndarray:
    """The 32 counts of two bits each, packed as unary codes: 0 is 00, 1 is 01, 2 is 11."""
    fp = fp.view(np.uint64)
    pairs, one = np.uint64(_PAIRS), np.uint64(1)
    return (fp | fp >> one) & pairs | (fp & fp >> one & pairs) << one


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed counts: of unary codes it is a bit count."""
    return np.bitwise_count(a ^ b)


def groups_for(rows: int, distance: int) -> int:
    """The fewest groups whose cells hold few of ``rows`` fingerprints by chance: two random segments have equal counts
    in three of eight cases."""
    near = lambda g: rows * comb(g, distance) * (3 / 8) ** (32 * (g - distance) / g)
    return next((g for g in GROUPS if g > distance and near(g) <= NEIGHBOURS), GROUPS[-1])


def group_masks(groups: int) -> list[int]:
    """Bits of each group of whole segments."""
    edges = [round(32 * g / groups) for g in range(groups + 1)]
    return [((1 << 2 * edges[g + 1]) - 1) ^ ((1 << 2 * edges[g]) - 1) for g in range(groups)]


def cells(distinct: DataFrame, distance: int, groups: int | None = None) -> DataFrame:
    """``cell, id, bits``: a row for each choice of groups whose counts make a cell; a fingerprint is its own id."""
    groups = groups or groups_for(distinct.count(), distance)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fp = F.col("fp")
    half = F.shiftrightunsigned(fp, 1)
    counts = fp.bitwiseOR(half).bitwiseAND(F.lit(_PAIRS)).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(F.lit(_PAIRS)), 1))
    masks = group_masks(groups)
    keys: list[Column] = []
    for number, chosen in enumerate(combinations(masks, groups - distance)):
        keys.append(F.xxhash64(F.lit(number), F.col("counts").bitwiseAND(F.lit(signed(sum(chosen))))))
    return distinct.withColumn("counts", counts).select(F.explode(F.array(*keys)).alias("cell"), F.col("fp").alias("id"), F.col("fp").alias("bits"))


def forest(bits: np.ndarray, side: np.ndarray | None, distance: int, bounded: bool = True, wide: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the two ends of a forest's edges that connect whatever links connect (with ``side``: links
    between the two sides; with ``wide``: links of at most ``WIDE`` of these bits).

    Breadth first: what is reached leaves the rest, so each is a target once."""
    counts = segment_counts(bits)
    rest, x_, y_ = np.arange(len(bits)), [], []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = np.flatnonzero(manhattan(counts[rest], counts[x]) <= distance) if bounded else np.arange(len(rest))
            near = np.bitwise_count(bits[rest[hit]] ^ bits[x]) <= distance
            if side is not None:
                near &= side[rest[hit]] != side[x]
            hit = hit[near]
            if wide is not None:
                hit = hit[np.bitwise_count(wide[rest[hit]] ^ wide[x]).sum(1) <= WIDE]
            if len(hit):
                found = rest[hit]
                x_.append(np.full(len(found), x))
                y_.append(found)
                queue.extend(found.tolist())
                rest = np.delete(rest, hit)
    none = np.zeros(0, np.int64)
    return np.concatenate(x_) if x_ else none, np.concatenate(y_) if y_ else none


def spanning(first: np.ndarray, second: np.ndarray, far: np.ndarray, group: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links in each group those that connect the same, closest first; links of groups without cycles all stay."""
    many = (np.bincount(group[first], minlength=len(sizes)) >= sizes)[group[first]]
    order = np.lexsort((first, far, group[first]))
    order = order[many[order]]
    up: dict[int, int] = {}
    kept = []
    for k, x, y in zip(order.tolist(), first[order].tolist(), second[order].tolist(), strict=True):
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        while (p := up.get(y, y)) != y:
            up[y] = up.get(p, p)
            y = p
        if x != y:
            up[y] = x
            kept.append(k)
    at = np.concatenate([np.flatnonzero(~many), np.array(kept, np.int64)])
    return first[at], second[at]


def connected(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of ``n`` places reaches by the edges."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        if (least == root[a]).all() and (least == root[b]).all():
            return root
        for at in (root[a], root[b]):
            np.minimum.at(root, at, least)
        while (root[root] != root).any():
            root = root[root]


def links(dealt: DataFrame, distance: int, bounded: bool = True, wide: DataFrame | None = None) -> DataFrame:
    """``a, b``: ids of ``dealt`` rows (``cell, id, bits``) that share a cell and lie within the distance.

    Of a cell's links come only so many as connect what all of them connect: of up to ``SMALL`` rows the closest
    ones, of more those of a breadth-first search.
    ``bounded``: bits pass the Manhattan bound of their segment counts before the exact count.
    ``wide``: rows (``id, wide``); a link is then one of at most ``WIDE`` of these bits too. Rows of a cell that no
    bits link go first; the others, by what their bits connect, meet again with their wide bits, and only links that
    pass are thinned."""
    spark = dealt.sparkSession
    small_batches(spark)
    dealt = stored(dealt, "cells")
    shared = dealt.groupBy("cell").count().filter("count > 1")
    rows = dealt.join(shared, "cell")
    blocks = F.ceil(F.col("count") / F.lit(CELL)).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    other = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(b, F.col("mine")).alias("low"), F.greatest(b, F.col("mine")).alias("high")))
    rows = rows.withColumn("mine", F.when(F.col("count") > CELL, mine).otherwise(0)).select("cell", "id", "bits", "mine", F.inline(F.when(F.col("count") > CELL, other).otherwise(F.array(F.struct(F.lit(0).alias("low"), F.lit(0).alias("high"))))))
    grouped = rows.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", "mine", "id")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    marks = pa.schema([(c, pa.int64()) for c in ("cell", "low", "high", "part", "mine", "id")])

    def whole_groups(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], keys: int) -> Iterator[np.ndarray]:
        """Tables of the columns and, if there are any, the wide bits' words; no group of equal keys is divided."""
        nothing_held()
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            now = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns])
            if "wide" in batch.schema.names:
                now = np.concatenate([now, np.frombuffer(b"".join(batch.column("wide").to_pylist()), "<i8").reshape(-1, LANES).T])
            held.append(now)
            size += now.shape[1]
            if size < CELL // 4 or ((now[:keys, 0] == now[:keys, -1]).all() and (held[0][:keys, 0] == now[:keys, -1]).all()):
                continue  # few rows yet, or still the one group that began before
            table = np.concatenate(held, axis=1)
            last = (table[:keys] == table[:keys, -1:]).all(0)
            cut = table.shape[1] - int(last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield table[:, :cut]
            held = [table[:, cut:]]
            size = held[0].shape[1]
        if held:
            yield np.concatenate(held, axis=1)

    def ends(keys: np.ndarray, mine: np.ndarray, bits: np.ndarray, words: np.ndarray | None, thin: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of both ends of the groups' links; those of groups of few rows all come unless ``thin``."""
        new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        bounds = np.concatenate([[0], new, [keys.shape[1]]])
        sizes = np.diff(bounds)
        counts = segment_counts(bits)
        group = np.repeat(np.arange(len(sizes)), sizes)
        few = (sizes <= SMALL)[group] & (keys[1] == keys[2])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        first, second, far = [], [], []
        for step in range(1, min(SMALL, int(sizes.max()))):
            at = np.flatnonzero((group[step:] == group[:-step]) & few[step:])
            if len(at) == 0:
                break
            if bounded:
                at = at[manhattan(counts[at], counts[at + step]) <= distance]
            apart = np.bitwise_count(bits[at] ^ bits[at + step])
            near = apart <= distance
            if words is not None:
                at = at[near]
                apart = np.bitwise_count(words[at] ^ words[at + step]).sum(1)
                near = apart <= WIDE
            first.append(at[near])
            second.append(at[near] + step)
            far.append(apart[near])
        if first:
            kept = (np.concatenate(first), np.concatenate(second))
            if thin:
                kept = spanning(*kept, np.concatenate(far), group, sizes)
            a.append(kept[0])
            b.append(kept[1])
        for k in np.flatnonzero((sizes > SMALL) | (keys[1] != keys[2])[bounds[:-1]]).tolist():
            low, high = int(bounds[k]), int(bounds[k + 1])
            side = None if keys[1, low] == keys[2, low] else mine[low:high] != keys[1, low]
            x, y = forest(bits[low:high], side, distance, bounded, None if words is None else words[low:high])
            a.append(low + x)
            b.append(low + y)
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("cell", "low", "high", "mine", "id", "bits"), 3):
            a, b = ends(table[:3], table[3], np.ascontiguousarray(table[5]).view(np.uint64), None, True)
            if len(a):
                yield rows_of(out, {"a": table[4][a], "b": table[4][b]})

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("cell", "low", "high", "mine", "id", "bits"), 3):
            a, b = ends(table[:3], table[3], np.ascontiguousarray(table[5]).view(np.uint64), None, False)
            if len(a) == 0:
                continue
            part = connected(a, b, table.shape[1])
            at = np.unique(np.concatenate([a, b]))
            yield rows_of(marks, {"cell": table[0][at], "low": table[1][at], "high": table[2][at], "part": table[4][part[at]], "mine": table[3][at], "id": table[4][at]})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ("cell", "low", "high", "part", "mine", "id"), 4):
            words = np.ascontiguousarray(table[6:].T).view(np.uint64)
            a, b = ends(table[:4], table[4], np.ascontiguousarray(words[:, -1]), words, True)
            if len(a):
                yield rows_of(out, {"a": table[5][a], "b": table[5][b]})

    if wide is None:
        return grouped.mapInArrow(run, "a long, b long").distinct()
    marked = stored(grouped.mapInArrow(mark, ", ".join(f"{c} long" for c in marks.names)), "marks")
    grouped = marked.join(wide.select("id", "wide"), "id").repartition("cell", "low", "high", "part").sortWithinPartitions("cell", "low", "high", "part", "mine", "id")
    return grouped.mapInArrow(verify, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable from each node that has an edge (u, v).

    Large-star and small-star rounds until no edge changes; each step is a table in
    the shared folder. The least neighbour comes from a partial aggregate and a join.
    A node of very many edges needs no task of its own (``fair_join``)."""

    def star(pairs: DataFrame, large: bool, rows: int) -> DataFrame:
        around = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = stored(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        joined = fair_join(around, least, "u", "n", 2 * rows if large else rows)
        if large:
            moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select("v", "m").unionByName(least.select(F.col("u").alias("v"), "m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.filter("u != v").distinct()

    current = stored(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u != v").distinct(), "edges")
    before, rows = None, current.count()
    while True:
        current = stored(star(current, True, rows), "edges")
        current = stored(star(current, False, rows), "edges")
        state = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"), F.max(F.col("v") >= F.col("u")).alias("up")).first()
        if before == (state.n, state.s):
            break
        before, rows = (state.n, state.s), state.n
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id reachable by links of at most ``distance`` bits."""
    marked = stored(fingerprints(docs, words), "fingerprints")
    return classes(marked, distance)


def classes(marked: DataFrame, distance: int = 3) -> DataFrame:
    """The same from ``doc_id, fp`` rows."""
    distinct, greatest = numbered(stored(marked.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "distinct"), "rep")
    named = links(cells(distinct.select("fp"), distance), distance)
    named = named.join(distinct.select(F.col("fp").alias("a"), F.col("rep").alias("u")), "a").join(distinct.select(F.col("fp").alias("b"), F.col("rep").alias("v")), "b")
    roots = components(named.select("u", "v"))
    known = distinct.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "n", real(F.coalesce("root", "rep"), greatest).alias("component_id"))
    return fair_join(marked, stored(known, "known"), "fp", "n", marked.count()).select("doc_id", "fp", "component_id")


def numbered(nodes: DataFrame, key: str) -> tuple[DataFrame, int | None]:
    """Stored nodes whose null keys are replaced by numbers above all keys, and the greatest key (None: none was null).

    The keys leave room above them for as many numbers, that is, they are below 2^62."""
    if nodes.filter(F.col(key).isNull()).isEmpty():
        return nodes, None
    greatest = nodes.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    return stored(nodes.withColumn(key, F.coalesce(key, F.lit(greatest) + 1 + F.monotonically_increasing_id())), "numbered"), greatest


def real(key: Column, greatest: int | None) -> Column:
    """The key, null in place of a number that stands in for one."""
    return key if greatest is None else F.when(key <= greatest, key)


#: The wide fingerprint: lanes of 64 bits, of which the last is the sketch that cells compare; segments of two bits in
#: a cell's group; groups; and the bits of all lanes in which near-duplicates may differ (a Jaccard similarity of 0.8 of
#: two equally large sets makes 155 of 1024, with a standard deviation of 12).
LANES, SEGMENTS, CELLS, SKETCH, WIDE = 16, 10, 48, 20, 170
_STEPS = np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def wide_fingerprint(text: str, words: int = 5) -> np.ndarray:
    """SimHash of ``LANES`` x 64 bits over the set of a text's shingles; a shingle's lanes are mixed from its one hash."""
    hashes = np.unique(shingle_hashes(text, words))
    counts = np.zeros(64 * LANES, np.int64)
    for k in range(0, len(hashes), 2040):
        part = hashes[k : k + 2040, None] + _STEPS
        part ^= part >> np.uint64(30)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(31)
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums of so many bits fit a byte
            counts += np.add.reduce(bits[j : j + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def wide_cells(fp: np.ndarray) -> list[int]:
    """The counts of each group of segments, as one number with the group's."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8), bitorder="little")
    counts = (bits[0::2].astype(np.int64) + bits[1::2])[: SEGMENTS * CELLS].reshape(CELLS, SEGMENTS)
    return (np.arange(CELLS) * 3**SEGMENTS + counts @ 3 ** np.arange(SEGMENTS)).tolist()


def near_duplicate_classes(docs: DataFrame, words: int = 5, exact_words: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` by links of two kinds: fingerprints of ``exact_words`` within ``distance`` bits, and
    texts whose shingle sets of ``words`` words have a Jaccard similarity of about 0.8 or more.

    The second kind is the same range join on a wide fingerprint: cells are the segment counts of one group of many, a
    64-bit sketch that no cell uses bounds what is compared further, and the wide bits decide before a cell's links are
    thinned. Texts of equal wide fingerprints are one node; rows without an id are nodes like any other."""
    return _classes_of(_marked(docs, words, exact_words), distance).select("doc_id", "fp", "component_id")


def _marked(docs: DataFrame, words: int, exact_words: int) -> DataFrame:
    """``doc_id, fp, wide`` of each row, stored."""
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("wide", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in batches:
            found = batch.column("text").to_pylist()
            fps = np.array([fingerprint(t, exact_words) for t in found], np.uint64)
            yield rows_of(out, {"doc_id": batch.column("doc_id").to_pylist(), "fp": fps.view(np.int64), "wide": [wide_fingerprint(t, words).tobytes() for t in found]})

    return stored(id_and_text(docs).mapInArrow(run, "doc_id long, fp long, wide binary"), "fingerprints")


def _classes_of(marked: DataFrame, distance: int) -> DataFrame:
    """Adds ``class``, never null, and ``component_id``, its smallest id, to ``doc_id, fp, wide`` rows."""
    nodes, greatest = numbered(stored(marked.groupBy("wide").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "nodes"), "id")
    dealt = pa.schema([("cell", pa.int64()), ("id", pa.int64()), ("bits", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.repeat(batch.column("id").to_numpy(), CELLS)
            found = [np.frombuffer(w, "<u8") for w in batch.column("wide").to_pylist()]
            sketches = np.repeat(np.array([f[-1] for f in found], np.uint64).view(np.int64), CELLS)
            yield rows_of(dealt, {"cell": [c for f in found for c in wide_cells(f)], "id": ids, "bits": sketches})

    similar = links(nodes.mapInArrow(deal, "cell long, id long, bits long"), SKETCH, bounded=False, wide=nodes).select(F.col("a").alias("u"), F.col("b").alias("v"))
    named = marked.select("fp", "wide").distinct().join(nodes, "wide").select("fp", "id").distinct()
    named = stored(named, "named")
    reps = stored(named.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    equal = named.join(reps, "fp").filter("id != rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    close = links(cells(reps.select("fp"), distance), distance)
    close = close.join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("u")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("v")), "b").select("u", "v")
    roots = components(similar.unionByName(equal).unionByName(close))
    known = nodes.join(roots, nodes.id == roots.node, "left").select("wide", "n", F.coalesce("root", "id").alias("class"))
    return fair_join(marked, stored(known, "known"), "wide", "n", marked.count()).select("doc_id", "fp", "wide", "class", real(F.col("class"), greatest).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, exact_words: int = 3, distance: int = 3) -> DataFrame:
    """One row, with all its columns, of each class of near-duplicates: that of the smallest ``doc_id``, or of a class
    without ids that of the smallest fingerprint. Of rows that share these the one of the smallest text stays."""
    found = stored(_classes_of(_marked(docs, words, exact_words), distance), "classes")
    repeated = not found.filter("component_id IS NULL").isEmpty() or not found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").isEmpty()
    if not repeated:
        # The ids grow with the corpus, so they are never broadcast: the same plan at every size.
        return docs.join(found.filter("doc_id = component_id").select("doc_id").hint("merge"), "doc_id", "left_semi").select(docs.columns)
    own, id_, wide_ = (name + "_" * max(map(len, docs.columns)) for name in ("own", "id", "wide"))  # longer than any column's name
    kept = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "wide")).alias("k")).select(F.col("k.doc_id").alias(id_), F.col("k.wide").alias(wide_))
    out = StructType([*docs.schema.fields, StructField(own, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in batches:
            wide = [wide_fingerprint(t or "", words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wide, pa.binary())], names=[*batch.schema.names, own])

    both = docs.mapInArrow(run, out).join(kept.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(wide_)))
    first = both.groupBy(id_, wide_).agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNull().alias("none"), "text")).alias("row"))
    return first.select("row.*").select(docs.columns)

"""Repair of conversation structure by signatures.

Rows of a conversation are ordered by turn (nulls first), then role, text and copy.  A row
becomes one character: ``-`` must go (blank, or role and text seen earlier), else s, u, a
or o for its role's initial, in capitals where the text is truncated.  The characters of a
conversation are its signature; each distinct signature is solved once, by recursion with a
memo over (place, state), and the solution is joined back and replayed on the rows.

Edits: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or
assistant row) 5, a truncated row that stays 5 more.  The cheapest edits whose roles read
``(s?(ua)+)?`` win, of these the ones whose initials are least in ASCII.  In each state all
edits have different initials, so the least initial among the cheapest edits decides.

A long conversation is no single group: rows are numbered by a range sort and cut every
``PIECE`` numbers.  A piece's costs from state to state are a small matrix; the matrices of
a conversation give each piece the cost of what follows it, and with that a piece is solved
like any other signature, from each state that may precede it.

Defined results of odd rows: a null role or text is one space; null conversations are one
conversation; repeated rows are rows each, all but the first of them duplicates; a role
with another initial (or none) must be changed or deleted.  Other columns do not matter.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import fair_join, partitions, small_batches, stored

#: Rows of a piece: a power of two.
PIECE = 4096
BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: nothing yet, after s, after u, after a. What each role initial leads to.
START, S, U, A = range(4)
NEXT = {START: ("u", U), S: ("u", U), U: ("a", A), A: ("u", U)}
NEVER = 1 << 50
#: Cost to end a conversation in each state.
FINAL = (0, 2 * INSERT, INSERT, 0)
ROLES = {"u": "user", "a": "assistant"}
SOLVED = "task string, n long, ways array<struct<exit int, cost long, audit string, edits array<struct<inserts string, letter string, role string>>>>"
#: Rows that the recursion goes down at once, below Python's limit.
DEPTH = 200


class Solver:
    """Cheapest edits of one signature, followed by costs of the four states behind it."""

    def __init__(self, signature: str, behind: tuple[int, ...]):
        self.signature, self.behind, self.memo = signature, behind, {}
        for place in range(len(signature), -1, -DEPTH):
            for state in range(4):
                self.cost(place, state)

    def moves(self, place: int, state: int) -> Iterator[tuple[str, int, str, int]]:
        """(initial, cost, role initial that the row gets, next state) of the edits that use up the row at ``place``."""
        code = self.signature[place]
        yield "D", DELETE, "", state
        if code != "-":
            more, own, (wanted, then) = TRUNCATED * code.isupper(), code.lower(), NEXT[state]
            if own == wanted:
                yield "K", KEEP + more, own, then
            elif own == "s" and state == START:
                yield "K", KEEP + more, own, S
            yield "R", REROLE + more, wanted, then

    def cost(self, place: int, state: int, inserts: int = 2) -> int:
        """Least cost from here to the end. More than two inserts in a row lead back to a state that was there before."""
        key = place, state, inserts
        if key not in self.memo:
            if place == len(self.signature):
                found = self.behind[state]
            else:
                found = min(cost + self.cost(place + 1, then) for _, cost, _, then in self.moves(place, state))
                if inserts:
                    found = min(found, INSERT + self.cost(place, NEXT[state][1], inserts - 1))
            self.memo[key] = found
        return self.memo[key]

    def way(self, state: int, last: bool) -> dict:
        """The edits from ``state`` on; inserts behind the last row belong to the last piece of a conversation."""
        edits, total = [], 0
        for place in range(len(self.signature)):
            inserts = ""
            while True:
                best = self.cost(place, state)
                open_ = [m for m in self.moves(place, state) if m[1] + self.cost(place + 1, m[3]) == best]
                if INSERT + self.cost(place, NEXT[state][1]) == best:
                    open_.append(("I", INSERT, *NEXT[state]))
                letter, cost, role, state = min(open_)
                total += cost
                if letter != "I":
                    break
                inserts += role
            edits.append({"inserts": inserts, "letter": letter, "role": role if letter == "R" else ""})
        if last and FINAL[state]:
            inserts = ""
            while FINAL[state]:
                role, state = NEXT[state]
                inserts, total = inserts + role, total + INSERT
            edits.append({"inserts": inserts, "letter": "", "role": ""})
        return {"exit": state, "cost": total, "audit": "".join("I" * len(e["inserts"]) + e["letter"] for e in edits), "edits": edits}


def matrix(signature: str) -> list[int]:
    """Least costs of a piece from each state (rows) to each state behind its last row."""
    solvers = [Solver(signature, tuple(0 if s == end else NEVER for s in range(4))) for end in range(4)]
    return [min(solvers[end].cost(0, state), NEVER) for state in range(4) for end in range(4)]


def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("task", pa.string()), ("n", pa.int64()), ("ways", pa.list_(pa.struct(
        [("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("edits", pa.list_(pa.struct([("inserts", pa.string()), ("letter", pa.string()), ("role", pa.string())])))])))])
    for batch in batches:
        for task, n in zip(batch.column("task").to_pylist(), batch.column("n").to_pylist(), strict=True):
            signature, behind, kind = task.split("|")
            solver = Solver(signature, tuple(map(int, behind.split(","))))
            ways = [solver.way(state, kind != "inner") for state in ((START,) if kind == "whole" else range(4))]
            yield pa.RecordBatch.from_pylist([{"task": task, "n": n, "ways": ways}], schema=schema)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [matrix(s) for s in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), pa.array(costs, pa.list_(pa.int64()))], names=["conv_id", "at", "costs"])


def _behind(rows: pa.Table) -> pa.Table:
    """What follows each piece of a conversation costs, from each state; less the least of them, so that equal pieces are equal tasks."""
    order = rows.sort_by([("at", "descending")])
    out, behind, kind = [], FINAL, "last"
    for costs in order.column("costs").to_pylist():
        out.append(",".join(str(min(b - min(behind), NEVER)) for b in behind) + "|" + kind)
        behind = tuple(min(min(c + b for c, b in zip(costs[4 * s : 4 * s + 4], behind, strict=True)), NEVER) for s in range(4))
        kind = "inner"
    return pa.table({"at": order.column("at"), "behind": pa.array(out, pa.string())})


def _entries(rows: pa.Table) -> pa.Table:
    """The state before each piece of a conversation, by the solutions of the pieces before it."""
    order, state, out = rows.sort_by("at"), START, []
    for exits in order.column("exits").to_pylist():
        out.append(state)
        state = exits[state]
    return pa.table({"at": order.column("at"), "entry": pa.array(out, pa.int32())})


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the lines of each conversation, whose rows follow each other: only the running digest is held."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    now: tuple[int | None] | None = None
    digest, some = hashlib.sha256(), False
    for batch in batches:
        ended = []
        for conv, lines in zip(batch.column("conv_id").to_pylist(), batch.column("lines").to_pylist(), strict=True):
            if now != (conv,):
                if now is not None:
                    ended.append({"conv_id": now[0], "repaired_sha256": digest.hexdigest()})
                now, digest, some = (conv,), hashlib.sha256(), False
            if lines is not None:
                digest.update(("\n" * some + lines).encode())
                some = True
        if ended:
            yield pa.RecordBatch.from_pylist(ended, schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": now[0], "repaired_sha256": digest.hexdigest()}], schema=schema)


class Repaired(NamedTuple):
    rows: DataFrame  # conv_id, turn, role, text, fault, pos, inserts, letter, new_role
    conversations: DataFrame  # conv_id, illegal, cost, audit


def ordered(turns: DataFrame) -> DataFrame:
    """Rows with their fault, in order: ``pos`` rises with conversation, turn, role, text and copy."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    counted = stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").cast("int").alias("copies")).withColumn("same", same), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = counted.groupBy("conv_id", "same").agg(F.min(place).alias("first"), F.count("*").alias("turns")).filter("turns > 1").select(F.col("conv_id").alias("c"), F.col("same").alias("s"), "first")
    copies = counted.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("same") == F.col("s")), "left").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    stripped = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(stripped == "", "blank").when((F.col("copy") > 1) | F.coalesce(place > F.col("first"), F.lit(False)), "duplicate").when(~F.right(stripped, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    found = stored(copies.select("conv_id", "turn", "role", "text", "copy", fault.alias("fault")), "faults")
    keys = ["conv_id", "turn", "role", "text", "copy"]
    dealt = found.repartitionByRange(partitions(turns.sparkSession), *keys).sortWithinPartitions(*keys).drop("copy")
    return stored(dealt.withColumn("pos", F.monotonically_increasing_id()), "ordered")


def pieces_of(rows: DataFrame) -> DataFrame:
    """A row for each piece of a conversation: where it begins, its signature, its first and last role initial and its illegal pairs."""
    initial = F.left("role", F.lit(1))
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(kind)).otherwise(kind)
    made = rows.groupBy("conv_id", F.floor(F.col("pos") / PIECE).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("pos", code.alias("code"), initial.alias("initial")))).alias("x"))
    initials = F.col("x.initial")
    pairs = F.zip_with(initials, F.slice(initials, 2, F.size("x")), lambda a, b: F.when(b.isNotNull(), F.concat(a, b)))
    return made.select(
        "conv_id", F.col("x")[0].pos.alias("at"), F.array_join("x.code", "").alias("signature"), F.col("x")[0].initial.alias("first"), F.element_at("x", -1).initial.alias("last"),
        F.size(F.filter(pairs, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"))


def repair(turns: DataFrame) -> Repaired:
    """Rows of conversations (``conv_id, turn, role, text``) with their edits, and each conversation's audit."""
    small_batches(turns.sparkSession)
    rows = ordered(turns)
    pieces = stored(pieces_of(rows), "pieces")
    counts = pieces.groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("many"))
    marked = stored(pieces.join(counts, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c"), "marked")
    long = marked.filter("many > 1")
    costs = long.select("conv_id", "at", "signature").mapInArrow(_matrices, "conv_id long, at long, costs array<long>")
    behind = costs.groupBy("conv_id").applyInArrow(_behind, "at long, behind string")
    whole = ",".join(map(str, FINAL)) + "|whole"
    tasks = long.join(behind, "at").unionByName(marked.filter("many = 1").withColumn("behind", F.lit(whole))).withColumn("task", F.concat("signature", F.lit("|"), "behind"))
    tasks = stored(tasks.drop("signature", "behind"), "tasks")
    solved = stored(tasks.groupBy("task").agg(F.count("*").alias("n")).repartition(partitions(turns.sparkSession), "task").mapInArrow(solve, SOLVED), "solved")
    answered = stored(fair_join(tasks, solved, "task", "n", tasks.count()).drop("task"), "answers")
    entries = answered.filter("many > 1").select("conv_id", "at", F.col("ways.exit").alias("exits")).groupBy("conv_id").applyInArrow(_entries, "at long, entry int")
    entered = answered.filter("many > 1").join(entries, "at").unionByName(answered.filter("many = 1").withColumn("entry", F.lit(0)))
    chosen = stored(entered.withColumn("way", F.get("ways", "entry")).drop("ways", "entry", "many"), "chosen")
    # A row for each row's edits; what is inserted behind the last row goes with it.
    edits = chosen.select("at", F.posexplode("way.edits").alias("i", "edit")).filter("edit.letter <> ''").select((F.col("at") + F.col("i")).alias("pos"), "edit.inserts", "edit.letter", F.col("edit.role").alias("new_role"))
    tail = F.element_at("way.edits", -1)
    tails = chosen.filter(tail.letter == "").select((F.col("at") + F.size("way.edits") - 2).alias("pos"), tail.inserts.alias("tail"))
    edited = rows.join(edits.join(tails, "pos", "left"), "pos")
    parts = F.sort_array(F.collect_list(F.struct("at", "way.audit", "first", "last")))
    joints = F.zip_with("parts", F.slice("parts", 2, F.size("parts")), lambda a, b: F.when(b.isNotNull(), F.concat(a.last, b.first)))
    whole_convs = chosen.groupBy("conv_id").agg(F.sum("way.cost").alias("cost"), F.sum("illegal").alias("inner"), parts.alias("parts"))
    illegal = F.col("inner") + F.size(F.filter(joints, lambda p: p.isNotNull() & ~p.isin("su", "ua", "au")))
    return Repaired(edited, whole_convs.select("conv_id", illegal.cast("long").alias("illegal"), "cost", F.array_join("parts.audit", "").alias("audit")))


def lines(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, lines``: what each row leaves of the repaired conversation, newline-joined ``role:text``; null if nothing."""
    inserted = lambda c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), ""), lambda r: F.when(r == "u", "user:").when(r == "a", "assistant:"))
    role = F.when(F.col("new_role") == "u", "user").when(F.col("new_role") == "a", "assistant").otherwise(F.col("role"))
    own = F.array(F.when(F.col("letter") != "D", F.concat(role, F.lit(":"), "text")))
    all_lines = F.filter(F.concat(inserted("inserts"), own, inserted("tail")), lambda x: x.isNotNull())
    return rows.select("conv_id", "pos", F.when(F.size(all_lines) > 0, F.array_join(all_lines, "\n")).alias("lines"))


def summary(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each ``conv_id`` of ``conversations``: faults, cost and audit of its ``turns``, and the digest of the repaired rows.

    A digest needs a conversation's rows in order, so they stream through one task, which holds one batch of them."""
    done = repair(turns)
    spark = turns.sparkSession
    flag = lambda fault: F.count_if(F.col("fault") == fault).alias(fault)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    counts = done.rows.groupBy("conv_id").agg(gaps, flag("blank"), flag("duplicate"), flag("truncated"))
    dealt = lines(done.rows).repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "pos")
    digests = dealt.select("conv_id", "lines").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (counts, done.conversations, digests):
        out = out.join(part.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    none = hashlib.sha256().hexdigest()
    return out.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": none})


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as the contract of ``op12`` damages them, by the checksum of conversation and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    changed = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"), F.explode(copies).alias("copy")).drop("copy")

"""Conversation repair against a search of all edits."""

import hashlib
import heapq
import itertools
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import queries, repair

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
SHAPE = "conv_id long, turn long, role string, text string, copy int, fault string"


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        if not text.strip(BLANK):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if text.rstrip(BLANK)[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Dijkstra over (cost, audit): the first full one is the cheapest and of these the least. The grammar is checked by a pattern."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, place, roles, kept = heapq.heappop(heap)
        if (place, roles[:1] + roles[-1:]) in done and place < len(rows):
            continue
        if place == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(kept)
        if not re.fullmatch("(s?(ua)*u?)?", roles):
            continue
        done.add((place, roles[:1] + roles[-1:]))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", place, roles + role[0], (*kept, role + ":")))
        if place == len(rows):
            continue
        (_, role, text), fault = rows[place], found[place]
        heapq.heappush(heap, (cost + 2, audit + "D", place + 1, roles, kept))
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            heapq.heappush(heap, (cost + more, audit + "K", place + 1, roles + (role[:1] or "?"), (*kept, f"{role}:{text}")))
            for new in ("user", "assistant"):
                heapq.heappush(heap, (cost + 1 + more, audit + "R", place + 1, roles + new[0], (*kept, f"{new}:{text}")))
    raise AssertionError


def enumerated(rows, found):
    """All edits of a few rows, with up to two inserts before each and at the end."""
    best = None
    options = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in found]
    inserts = ["", "u", "a", "ua", "au"]
    for choice in itertools.product(*[[(i, o) for i in inserts for o in options[k]] for k in range(len(rows))], inserts):
        roles, audit, cost = "", "", 0
        for k, part in enumerate(choice):
            ins, own = (part, None) if k == len(rows) else part
            roles, audit, cost = roles + ins, audit + "I" * len(ins), cost + 5 * len(ins)
            if own:
                roles += "" if own == "D" else own[1:] or (rows[k][1][:1] or "?")
                audit += own[0]
                cost += {"D": 2, "K": 0, "R": 1}[own[0]] + 5 * (own != "D" and found[k] == "truncated")
        if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = cost, audit
    return best


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    out = []
    left = damaged(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, role, text), t) for c, t, role, text in left if c == conv)
        mine = [(t, role, text) for (_, _, role, text), t in mine]
        found = faults(mine)
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit, repaired = cheapest(mine, found)
        initials = [role[:1] for _, role, _ in mine]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(repaired.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=str)


def summary(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SHAPE)
    return found(repair.summary(repair.damaged(df), df))


def test_query_is_the_search_of_all_edits(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert found(queries.op12_signatures(spark, SF)) == brute(rows)


TEXTS = ["Ok.", "no", " ", "", "Ja! \n", "why?\x0b", None, ".", "x "]


@pytest.mark.parametrize("piece", [4096, 4])
def test_odd_rows_and_pieces(spark, monkeypatch, piece):
    monkeypatch.setattr(repair, "PIECE", piece)
    import random

    r = random.Random(piece)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(r.choice([None, 1, 2, 3, -7]), r.choice([None, *range(8)]), r.choice(roles), r.choice(TEXTS)) for _ in range(60)]
    rows += [(9, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(30)] + [(9, 2, "user", "line 2.")] * 6 + [(10, 0, "user", "a long one. " * 50_000)]
    rows += [(100 + k, 0, "user", "hello") for k in range(40)]
    assert summary(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert summary(spark, []) == []


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "x", ""]), st.sampled_from(["", "truncated", "blank"])), max_size=9), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_signatures_are_solved_whole_and_in_pieces(rows, size):
    fault = [f for _, f in rows]
    whole = [(0, role, "") for role, _ in rows]
    code = lambda role, f: "-" if f == "blank" else (role[:1] if role[:1] in ("u", "a", "s") and role else "o").upper() if f else (role[:1] if role[:1] in ("u", "a", "s") and role else "o")
    signature = "".join(code(role, f) for role, f in rows)
    way = repair.Solver(signature, repair.FINAL).way(repair.START, True)
    cost, audit, _ = cheapest(whole, fault)
    assert (way["cost"], way["audit"]) == (cost, audit)
    if len(rows) <= 3:
        assert enumerated(whole, fault) == (cost, audit)
    if not rows:
        return
    cut = [signature[i : i + size] for i in range(0, len(signature), size)]
    table = repair.pa.table({"at": list(range(len(cut))), "costs": [repair.matrix(c) for c in cut]})
    behind = dict(zip(*(c.to_pylist() for c in repair._behind(table).columns)))
    state, found_audit = 0, ""
    for i, c in enumerate(cut):
        costs, kind = behind[i].split("|")
        w = repair.Solver(c, tuple(map(int, costs.split(",")))).way(state, kind != "inner")
        state, found_audit = w["exit"], found_audit + w["audit"]
    assert found_audit == audit


def test_long_signatures_are_solved():
    way = repair.Solver("ua" * 20_000 + "-" * 500 + "U", repair.FINAL).way(repair.START, True)
    assert way["audit"] == "K" * 40_000 + "D" * 501 and way["cost"] == 1002

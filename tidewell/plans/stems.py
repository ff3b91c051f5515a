"""The stems of the words of a relation in SQL, a step for each column."""

from __future__ import annotations

from tidewell.functions import spanish as S


def _in(endings: list[str]) -> str:
    return "(" + ", ".join(f"'{e}'" for e in endings) + ")"


def _end(x: str, endings: list[str]) -> str:
    return f"regexp_extract({x}, '{S.pattern(endings)}')"


def _chop(x: str, n: str) -> str:
    return f"left({x}, greatest(length({x}) - {n}, 0))"


def _short(b: str, endings: list[str]) -> str:
    e = _end(b, endings)
    return f"CASE WHEN {e} <> '' AND length({b}) - length({e}) >= r2 THEN {_chop(b, f'length({e})')} ELSE {b} END"


def stems_sql(words: str) -> str:
    """CTEs from ``words(w)`` to ``stems(w, stem)``; ``words`` is a query."""
    place = lambda p: f"CASE WHEN length(regexp_extract(w, '{p}')) > 0 THEN length(regexp_extract(w, '{p}')) ELSE length(w) END"
    cases = ""
    for endings, region, instead, before in S.STANDARD:
        short = f"c || '{instead}'" if instead else f"({_short('c', before)})" if before else "c"
        if endings == ["amente"]:
            without = _chop("c", "2")
            short = f"CASE WHEN right(c, 2) = 'iv' AND length(c) - 2 >= r2 THEN {_short(without, ['at'])} ELSE {short} END"
        cases += f" WHEN s IN {_in(endings)} THEN CASE WHEN length(c) >= {region} THEN {short} ELSE x END"
    return f"""
  st_words AS (SELECT DISTINCT w FROM ({words})),
  st_marks AS (SELECT w, {place(S.R1)} AS r1, {place(S.R2)} AS r2, {place(S.RV)} AS rv FROM st_words),
  st_pro AS (SELECT *, {_end('w', S.PRONOUNS)} AS p FROM st_marks),
  st_before AS (SELECT *, {_chop('w', 'length(p)')} AS b FROM st_pro),
  st_verbs AS (SELECT *, {_end('b', S.BEFORE_PRONOUN)} AS e FROM st_before),
  st_zero AS (SELECT w, r1, r2, rv, CASE WHEN p <> '' AND e <> '' AND length(b) - length(e) >= rv AND (e <> 'yendo' OR right(b, 6) = 'uyendo')
    THEN {_chop('b', 'length(e)')} || translate(e, '{S.ACUTE}', '{S.BARE}') ELSE w END AS x FROM st_verbs),
  st_suffix AS (SELECT *, {_end('x', S.ALL_STANDARD)} AS s FROM st_zero),
  st_cut AS (SELECT *, {_chop('x', 'length(s)')} AS c FROM st_suffix),
  st_one AS (SELECT w, rv, x, CASE{cases} ELSE x END AS y, substr(x, rv + 1) AS v FROM st_cut),
  st_y AS (SELECT *, {_end('v', S.Y_ENDINGS)} AS ye, {_end('v', S.GU_ENDINGS + S.VERB_ENDINGS)} AS ve FROM st_one),
  st_two AS (SELECT w, rv, CASE WHEN y <> x THEN y WHEN ye <> '' AND right({_chop('x', 'length(ye)')}, 1) = 'u' THEN {_chop('x', 'length(ye)')} WHEN ve = '' THEN x
    WHEN ve IN {_in(S.GU_ENDINGS)} AND right({_chop('x', 'length(ve)')}, 2) = 'gu' THEN {_chop('x', '(length(ve) + 1)')} ELSE {_chop('x', 'length(ve)')} END AS z FROM st_y),
  st_rest AS (SELECT *, {_end('substr(z, rv + 1)', S.RESIDUAL + S.RESIDUAL_E)} AS q FROM st_two),
  stems AS (SELECT w, translate(CASE WHEN q = '' THEN z WHEN q IN {_in(S.RESIDUAL_E)} AND right({_chop('z', 'length(q)')}, 2) = 'gu' AND length(z) - length(q) - 1 >= rv THEN {_chop('z', '(length(q) + 1)')}
    ELSE {_chop('z', 'length(q)')} END, '{S.ACUTE}', '{S.BARE}') AS stem FROM st_rest)"""

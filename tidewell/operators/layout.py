"""Reading order from word boxes, editable tables, manual reviews: what needs order-dependent Python."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import blank

_NUMERAL = re.compile(r"(?:\d+(?:\.\d+){0,4}\.?|[a-zA-Z]\))$")


def _visual_lines(words: list[tuple[float, float, float, float, str]]) -> tuple[list[list[tuple]], float]:
    """Words (left, top, width, height, text) by lines: a word joins the line whose running middle is near."""
    words = sorted(words, key=lambda w: (w[1] + w[3] / 2, w[0]))
    mean = sum(w[3] for w in words) / len(words)
    near = max(4.0, min(18.0, mean * 0.65))
    lines: list[list[tuple]] = []
    middle = 0.0
    for w in words:
        y = w[1] + w[3] / 2
        if lines and abs(y - middle) <= near:
            lines[-1].append(w)
            middle = (middle + y) / 2
        else:
            lines.append([w])
            middle = y
    return [sorted(line) for line in lines], mean


def page_lines(words: list[tuple[float, float, float, float, str]]) -> list[str]:
    """QLT13: lines of a page; a numeral alone joins the line below it, a line that ends in a page number gets dots."""
    words = [w for w in words if w[2] > 0 and w[3] > 0 and w[4].strip()]
    if not words:
        return []
    lines, mean = _visual_lines(words)
    merged, at = [], 0
    while at < len(lines):
        line = lines[at]
        below = lines[at + 1] if at + 1 < len(lines) else None
        if below and len(line) == 1 and _NUMERAL.match(line[0][4]):
            gap = min(w[1] for w in below) - max(w[1] + w[3] for w in line)
            if gap <= max(20, mean * 1.8) and below[0][0] >= line[0][0] + line[0][2] - 6:
                merged.append(sorted(line + below))
                at += 2
                continue
        merged.append(line)
        at += 1
    out = []
    for line in sorted(merged, key=lambda ws: min(w[1] for w in ws)):
        texts = [w[4].strip() for w in line]
        apart = len(line) > 1 and line[-1][0] - (line[-2][0] + line[-2][2]) > 4 * mean
        out.append(f"{' '.join(texts[:-1])} .......... {texts[-1]}" if apart and re.fullmatch(r"\d{1,4}", texts[-1]) else " ".join(texts))
    return out


def rebuilt_pages(words: DataFrame) -> DataFrame:
    """QLT13 for (``doc, page, left, top, width, height, text``): ``doc, page, text``. One page's words are one row
    of an array (a page is bounded), read by a pandas function."""
    boxes = words.groupBy("doc", "page").agg(F.collect_list(F.struct("left", "top", "width", "height", "text")).alias("w"))

    @F.pandas_udf(T.StringType())
    def lines(column: pd.Series) -> pd.Series:
        return column.map(lambda rows: "\n".join(page_lines([(r["left"], r["top"], r["width"], r["height"], r["text"] or "") for r in rows])))

    return boxes.select("doc", "page", lines("w").alias("text"))


def _split_row(line: str) -> list[str]:
    parts = [p.strip() for p in re.split(r"(?<!\\)\|", line.strip())]
    return parts[1 if parts and parts[0] == "" else 0 : len(parts) - (1 if parts and parts[-1] == "" else 0)]


def editable(text: str) -> str:
    """QLT8: each Markdown table as a read-only preview and one ``label: value`` line for each cell."""
    out, lines, at, number = [], text.split("\n"), 0, 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end].lstrip().startswith("|"):
            end += 1
        rows = [_split_row(s) for s in lines[at:end]]
        if len(rows) >= 2 and rows[1] and all(re.fullmatch(r":?-{2,}:?", c) for c in rows[1]):
            number += 1
            names = [c or f"Columna {i + 1}" for i, c in enumerate(rows[0])]
            out += [f"----- VISTA PREVIA TABLA {number} -----", *lines[at:end], f"----- FIN VISTA PREVIA TABLA {number} -----", f"===== TABLA {number} ====="]
            for k, row in enumerate(rows[2:]):
                out.append(f"-- Fila {k + 1} --")
                out += [f"{n}: {row[i] if i < len(row) else ''}" for i, n in enumerate(names)]
            out.append(f"===== FIN TABLA {number} =====")
            at = end
        else:
            out.append(lines[at])
            at += 1
    return "\n".join(out)


def rebuilt(text: str) -> str:
    """QLT8 back: previews go, blocks become padded Markdown tables; a block that cannot be read stays as it is."""
    text = re.sub(r"(?ms)^----- VISTA PREVIA TABLA (\d+)\b.*?^----- FIN VISTA PREVIA TABLA \1 -----\n?", "", text)

    def table(m: re.Match) -> str:
        rows: list[dict[str, str]] = []
        for line in m[2].split("\n"):
            if re.fullmatch(r"-- Fila \d+ --", line.strip()):
                rows.append({})
            elif line.strip():
                name, colon, value = line.partition(":")
                if not rows or not colon:
                    return m[0]
                rows[-1][name.strip()] = value.strip()
        if not rows:
            return m[0]
        names = list(rows[0])
        grid = [["" if re.fullmatch(r"Columna \d+", n) else n for n in names], *[[r.get(n, "") for n in names] for r in rows]]
        widths = [max(3, *(len(g[i]) for g in grid)) for i in range(len(names))]
        show = lambda cells: "| " + " | ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)) + " |"
        return "\n".join([show(grid[0]), "| " + " | ".join("-" * w for w in widths) + " |", *map(show, grid[1:])])

    return re.sub(r"(?ms)^===== TABLA (\d+)\b[^\n]*\n(.*?)\n?^===== FIN TABLA \1 =====", table, text)


@F.pandas_udf(T.StringType())
def editable_udf(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(editable)


@F.pandas_udf(T.StringType())
def rebuilt_udf(texts: pd.Series) -> pd.Series:
    return texts.fillna("").map(rebuilt)


def reviewed_blocks(content: Column) -> Column:
    """QLT14: struct of the norm's key and its pages' corrected texts out of a review file."""
    key = F.nullif(F.trim(F.regexp_extract(blank(content), r"(?m)^#\s*NORMA:\s*(.+)$", 1)), F.lit(""))
    parts = F.slice(F.split(blank(content), r"(?m)^### PAGINA "), 2, 1_000_000)
    pages = F.transform(parts, lambda p: F.struct(F.nullif(F.regexp_extract(p, r"^(\d+)\s*\([^)]*\)", 1), F.lit("")).cast("int").alias("page_number"), F.trim(F.regexp_replace(F.regexp_replace(p, r"^\d+\s*\([^)]*\)\s*\n", ""), r"^\s+|\s+$", "")).alias("text")))
    return F.struct(key.alias("document_key"), F.filter(pages, lambda p: p.page_number.isNotNull() & (p.text != "")).alias("pages"))


def reviewed_pages(pages: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """QLT14: pages (``document_key, page_number, ...``) with the reviews of the files (``content``) applied."""
    blocks = files.select(reviewed_blocks(F.col("content")).alias("r")).select("r.document_key", F.inline("r.pages")).filter("document_key IS NOT NULL")
    new = blocks.groupBy("document_key", "page_number").agg(F.max("text").alias("new")).withColumn("new", rebuilt_udf("new"))
    joined = pages.join(new, ["document_key", "page_number"], "left")
    hit = F.col("new").isNotNull()
    return joined.withColumns({
        "text": F.coalesce("new", "text"), "quality_score": F.when(hit, 1.0).otherwise(F.col("quality_score")), "extraction_method": F.when(hit, "revision_manual").otherwise(F.col("extraction_method")),
        "revisado_manual": hit | F.coalesce("revisado_manual", F.lit(False)), "tabla_verificada": hit | F.coalesce("tabla_verificada", F.lit(False)), "revisado_en": F.when(hit, now),
    }).drop("new")


def replaced_text(pages: DataFrame, new: DataFrame, now: Column, quality: float = 0.9) -> DataFrame:
    """QLT16: a page's new text, its old one kept in the metadata."""
    joined = pages.join(new.select("page_id", F.col("text").alias("new")), "page_id", "left")
    hit = F.col("new").isNotNull()
    kept = F.map_concat(F.map_filter("metadata", lambda k, _: ~k.isin("texto_anterior", "reemplazado_en")), F.create_map(F.lit("texto_anterior"), blank(F.col("text")), F.lit("reemplazado_en"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")))
    return joined.withColumns({"metadata": F.when(hit, kept).otherwise(F.col("metadata")), "quality_score": F.when(hit, quality).otherwise(F.col("quality_score")), "text": F.coalesce("new", "text")}).drop("new")


def merged_objects(base: dict, patch: dict) -> dict:
    """SNK7: patch over base, objects merged all the way down."""
    return base | {k: merged_objects(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in patch.items()}


@F.pandas_udf(T.StringType())
def merge_json(base: pd.Series, patch: pd.Series) -> pd.Series:
    """SNK7 on JSON texts; keys sorted, so equal objects are equal texts. A null or broken side counts as empty."""
    def read(x: str | None) -> dict:
        try:
            value = json.loads(x or "{}")
        except ValueError:
            value = {}
        return value if isinstance(value, dict) else {}

    return pd.Series([json.dumps(merged_objects(read(a), read(b)), sort_keys=True, ensure_ascii=False) for a, b in zip(base, patch, strict=True)])

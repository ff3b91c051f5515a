"""Quality and structure of page texts, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import SPACES, blank, clean, let

#: Signs of formulas (fixed values).
FORMULA_SIGNS = "=×÷≤≥≠≈∑∏∫√πΩ∆αβγδθλμσφ±"
LOW, HIGH = 0.5, 0.85


def stripped(x: Column) -> Column:
    return F.btrim(blank(x), F.lit(SPACES))


def quality_score(x: Column) -> Column:
    """QLT1: 1 less penalties for glued words, long words and few letters; 0 under 15 characters.

    Words and their lengths are counted on the text with single blanks: no array of words is made."""
    def score(p: Column) -> Column:
        blanks = F.length(p.s) - F.length(F.replace(p.s, F.lit(" "), F.lit("")))
        n = blanks + 1
        glued = F.regexp_count(p.s, F.lit("[^ ]{26,}")) / n
        mean = (F.length(p.s) - blanks) / n
        letters = F.length(F.regexp_replace(p.s, r"[^\p{L}]+", "")) / F.length(p.t)
        value = F.lit(1.0) - glued * 1.6 - F.greatest(F.lit(0.0), (mean - 12) / 22) - F.greatest(F.lit(0.0), F.lit(0.55) - letters)
        return F.when(F.length(p.t) < 15, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))

    return let(stripped(x), lambda t: let(F.struct(t.alias("t"), F.regexp_replace(t, r"(?U)\s+", " ").alias("s")), score))


def formula_signs(x: Column, signs: str = FORMULA_SIGNS) -> Column:
    return F.length(blank(x)) - F.length(F.translate(blank(x), signs, ""))


def maybe_formula(x: Column, least: int = 3, density: float = 0.01, signs: str = FORMULA_SIGNS) -> Column:
    """QLT2: enough formula signs, and dense enough."""
    n = formula_signs(x, signs)
    return (n >= least) & (n / F.greatest(F.length(stripped(x)), F.lit(1)) > density)


def maybe_chart(areas: Column, low: float = 0.04, high: float = 0.75) -> Column:
    """QLT3: some embedded image covers a share of the page within the bounds."""
    return F.coalesce(F.exists(areas, lambda a: a.between(low, high)), F.lit(False))


def page_method(plain: Column, second: Column, ocr: Column, confidence: Column, pixel_mean: Column) -> Column:
    """QLT4, QLT5: struct method, text, quality. A blank page first; else the first best of the layers
    that are asked for: a second reading if the plain one is doubtful, OCR if all are poor or short.

    Each layer is scored once, the later ones only if they are asked for."""
    layer = lambda method, text, quality: F.struct(F.lit(method).alias("method"), stripped(text).alias("text"), quality.alias("quality"))

    def third(better: Column) -> Column:
        asked = ((better.quality < 0.5) | (F.length(better.text) < 25)) & (stripped(ocr) != "")
        return let(F.when(asked, quality_score(ocr) * F.coalesce(confidence, F.lit(0.6))), lambda q: F.when(q > better.quality, layer("ocr", ocr, q)).otherwise(better))

    def read(q1: Column) -> Column:
        asked = F.when((q1 < 0.75) & (stripped(second) != ""), quality_score(second))
        return let(let(asked, lambda q2: F.when(q2 > q1, layer("second", second, q2)).otherwise(layer("plain", plain, q1))), third)

    blank_page = F.struct(F.lit("blank").alias("method"), F.lit("").alias("text"), F.lit(1.0).alias("quality"))
    return F.when((stripped(plain) == "") & (pixel_mean > 250), blank_page).otherwise(let(quality_score(plain), read))


def mean_confidence(values: Column) -> Column:
    """AGG25: mean of the values that are not negative, over 100; null if there is none."""
    good = F.filter(values, lambda v: v >= 0)
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, v: a + v) / F.size(good) / 100)


def is_real_table(rows: Column) -> Column:
    """QLT6: at least two rows and columns, three filled cells, twenty characters."""
    full = lambda cells: (F.size(cells) >= 3) & (F.aggregate(cells, F.lit(0), lambda a, c: a + F.length(c)) >= 20)
    return (F.size(rows) >= 2) & (F.size(F.get(rows, F.lit(0))) >= 2) & let(F.filter(F.transform(F.flatten(rows), lambda c: stripped(c)), lambda c: c != ""), full)


def table_markdown(rows: Column) -> Column:
    """QLT7: a grid padded to its columns' widths; bars escaped; short rows filled."""
    line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))

    def drawn(g: Column) -> Column:
        rule = line(F.transform(g.widths, lambda w: F.repeat(F.lit("-"), w)))
        body = F.transform(g.filled, lambda r: line(F.zip_with(r, g.widths, lambda c, w: F.rpad(c, w, " "))))
        return let(body, lambda b: F.array_join(F.concat(F.slice(b, 1, 1), F.array(rule), F.slice(b, 2, F.greatest(F.size(b), F.lit(1)))), "\n"))

    def measured(filled: Column, places: Column) -> Column:
        widths = F.transform(places, lambda i: F.greatest(F.lit(3), F.array_max(F.transform(filled, lambda r: F.length(F.get(r, i))))))
        return let(F.struct(filled.alias("filled"), widths.alias("widths")), drawn)

    def padded(cells: Column) -> Column:
        places = F.sequence(F.lit(0), F.array_max(F.transform(cells, lambda r: F.size(r))) - 1)
        return let(places, lambda p: let(F.transform(cells, lambda r: F.transform(p, lambda i: F.coalesce(F.get(r, i), F.lit("")))), lambda filled: measured(filled, p)))

    return let(F.transform(rows, lambda r: F.transform(r, lambda c: F.replace(clean(c), F.lit("|"), F.lit("\\|")))), padded)


def tables_markdown(tables: Column) -> Column:
    """QLT7: each table under its name, numbered if there are several."""
    blocks = F.transform(tables, lambda t, i: F.concat(F.when(F.size(tables) > 1, F.concat(F.lit("Tabla "), (i + 1).cast("string"))).otherwise(F.lit("Tabla")), F.lit(":\n"), table_markdown(t)))
    return F.array_join(blocks, "\n\n")


def lines(x: Column) -> Column:
    return F.split(F.regexp_replace(blank(x), r"\r\n?", "\n"), "\n")


def is_table_like(x: Column, least: int = 2) -> Column:
    """QLT9: enough lines with a tab, a bar, wide gaps on both sides of a word, or two numbers apart."""
    rows = F.filter(lines(x), lambda s: F.trim(s) != "")
    return F.size(F.filter(rows, lambda s: F.rlike(s, F.lit(r"\t|\||\s{2,}\S+\s{2,}|\b\d[\d.,]*\s{2,}\d[\d.,]*\b")))) >= least


def line_kind(s: Column) -> Column:
    """QLT10: blank, heading, list_item or paragraph."""
    return (
        F.when(F.trim(s) == "", "blank")
        .when(F.rlike(s, F.lit(r"(?i)^\s*art[íi]culo\s+\d+")), "heading")
        .when(F.rlike(s, F.lit(r"^\s*[IVXLCDM]{1,8}[.)]\s+")), "heading")
        .when(F.rlike(s, F.lit(r"^\s*\d+(?:\.\d+){1,4}\.?\s+")), "heading")
        .when(F.rlike(s, F.lit(r"^\s*(?:[-*•]|[a-zA-Z]\)|\d+\)|\d+\.)\s+")), "list_item")
        .otherwise("paragraph")
    )


def heading_kind(s: Column) -> Column:
    return (
        F.when(F.rlike(s, F.lit(r"(?i)^\s*art[íi]culo\s+\d+")), "article_heading")
        .when(F.rlike(s, F.lit(r"^\s*[IVXLCDM]{1,8}[.)]\s+")), "roman_heading")
        .when(F.rlike(s, F.lit(r"^\s*\d+(?:\.\d+){1,4}\.?\s+")), "numeric_heading")
    )


def review_flags(raw: Column, ocr: Column, normalized: Column | None = None, layout: Column | None = None) -> Column:
    """QLT11: struct of ratios, flags that send a page to review, and the values that must not be misread.

    ``normalized``: the text in which those values are looked for (None: the raw one). ``layout``: a struct of what the
    layout says (``possible_numbered_list_split``, ``possible_index_alignment_issue``, ``possible_bad_layout_order``)."""
    text = raw if normalized is None else normalized
    told = lambda name: F.coalesce(layout[f"possible_{name}"], F.lit(False)) if layout is not None else F.lit(False)
    matches = F.struct(*[F.array_sort(F.array_distinct(F.regexp_extract_all(blank(text), F.lit(p), 1))).alias(n) for n, p in {"temperatures": TEMPERATURE, "articles": SENSITIVE["article"], "numerals": SENSITIVE["numeral"], "roman_numerals": ROMAN, "dates": SENSITIVE["date"]}.items()])
    size = F.greatest(F.length(blank(raw)), F.lit(1))
    rare = F.regexp_count(blank(raw), F.lit(r"""(?U)[^\w\s.,;:!?¿¡()\-/"'%°º\n]""")) / size
    symbols = F.regexp_count(blank(raw), F.lit(r"(?U)[^A-Za-z0-9ÁÉÍÓÚÜÑáéíóúüñ\s]")) / size
    rows = F.filter(F.transform(lines(raw), lambda s: F.trim(s)), lambda s: s != "")
    short = F.size(F.filter(rows, lambda s: F.length(s) <= 3))
    numeric = F.regexp_extract_all(blank(raw), F.lit(CONFUSED), 1)
    roman = F.filter(F.regexp_extract_all(blank(raw), F.lit(ROMAN_LIKE), 1), lambda t: F.rlike(t, F.lit("[a-z1]")))
    heads = F.filter(F.slice(rows, 1, 40), lambda s: F.rlike(s, F.lit(r"^[IVXLCDMil1]{1,8}[.)]\s+\S+")) & ~F.rlike(s, F.lit(r"^[IVXLCDM]{1,8}[.)]\s+")))
    hand = ocr & ((rare > 0.02) | (symbols > 0.14) | (short >= 5) | F.rlike(blank(raw), F.lit(r"[\\/_|]{3,}")))
    return F.struct(
        F.round(rare, 4).alias("rare_ratio"), F.round(symbols, 4).alias("symbol_ratio"), short.alias("short_fragments"),
        F.rlike(blank(raw), F.lit(CONFUSED)).alias("numeric_error"), F.rlike(blank(raw), F.lit(ROMAN_DOUBTFUL)).alias("roman_error"), (F.size(heads) > 0).alias("heading_error"), F.coalesce(hand, F.lit(False)).alias("handwriting"),
        F.rlike(blank(text), F.lit(SENSITIVE["temperature"])).alias("temperature_value"), told("numbered_list_split").alias("list_split"), told("index_alignment_issue").alias("index_alignment"), told("bad_layout_order").alias("layout_order"),
        F.slice(numeric, 1, 20).alias("numeric_tokens"), F.slice(roman, 1, 20).alias("roman_tokens"), F.slice(heads, 1, 12).alias("malformed_heading_lines"), matches.alias("matches"), sensitive_values(text).alias("values"),
    )


# Where a word begins and ends in any script; what a plain \b means differs between versions of Java.
BEGIN, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
# Patterns of values that must not be misread (fixed values).
CONFUSED = BEGIN + r"(\d+[A-Za-z]|[A-Za-z]\d+)" + END
ROMAN, ROMAN_LIKE = BEGIN + r"([IVXLCDM]{1,8})" + END, BEGIN + r"([IVXLCDMil1]{1,8})" + END
# A numeral like the last with a letter or digit in it that only looks like one of a numeral.
ROMAN_DOUBTFUL = BEGIN + r"(?=[IVXLCDM]*[il1])[IVXLCDMil1]{1,8}" + END
TEMPERATURE = r"((?<!\d)-?\d{1,3}\s*[°º]?\s*[Cc]" + END + ")"
SENSITIVE = {
    "temperature": r"((?<!\d)-?\d{1,3}\s*[°º]?\s*[Cc](?:\s*y\s*-?\d{1,3}\s*[°º]?\s*[Cc])?)",
    "date": BEGIN + r"(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})" + END,
    "article": "(?i)" + BEGIN + r"(art[íi]culo\s+\d+)" + END,
    "numeral": BEGIN + r"(\d+(?:\.\d+){1,4})" + END,
}


def sensitive_values(x: Column) -> Column:
    """QLT12: kinds and values in order of kind and place, each pair once."""
    def found(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(blank(x), F.lit(pattern), 1), lambda v: F.struct(F.lit(kind).alias("kind"), clean(v).alias("value")))

    return F.array_distinct(F.concat(*[found(k, p) for k, p in SENSITIVE.items()]))


def band(q: Column, low: float = LOW, high: float = HIGH) -> Column:
    return F.when(q >= high, "alta").when(q >= low, "media").when(q < low, "baja")

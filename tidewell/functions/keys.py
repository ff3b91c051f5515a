"""Dates, numbers, URLs and the deterministic keys made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import blank, clean, deaccent, fold, short_hash

# Spanish months, short and long (fixed values).
SHORT_MONTHS = {"ene": 1, "feb": 2, "mar": 3, "abr": 4, "may": 5, "jun": 6, "jul": 7, "ago": 8, "set": 9, "sep": 9, "oct": 10, "nov": 11, "dic": 12}
LONG_MONTHS = {"enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "setiembre": 9, "septiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12}
# How a norm's type is written, short and long, in the order in which types are tried (fixed values).
NORM_NAMES = {
    "RM": ("R", "M", "RESOLUCI[ÓO]N MINISTERIAL"), "DS": ("D", "S", "DECRETO SUPREMO"), "RD": ("R", "D", "RESOLUCI[ÓO]N DIRECTORAL"),
    "RS": ("R", "S", "RESOLUCI[ÓO]N SUPREMA"), "LEY": None, "DL": ("D", "L", "DECRETO LEGISLATIVO"), "DU": ("D", "U", "DECRETO DE URGENCIA"),
}
KEY_ORDER = ("RM", "DS", "RD", "RS", "DL", "DU", "LEY")
NUMBER_SIGN = "(?:N[°Oº.]*)?"
#: Last segments of category pages (fixed values).
CATEGORY_SLUGS = ("decreto-de-urgencia", "decreto-legislativo", "decreto-ley", "resolucion", "resolucion-suprema", "ley", "resolucion-ministerial", "decreto-supremo")


def some(x: Column) -> Column:
    """Null for the empty text."""
    return F.nullif(x, F.lit(""))


def first(x: Column, pattern: str, group: int = 1) -> Column:
    return some(F.regexp_extract(blank(x), pattern, group))


def digits(x: Column) -> Column:
    """A run of digits without leading zeros."""
    return F.regexp_replace(x, r"^0+(?=\d)", "")


def url_path(url: Column) -> Column:
    """Path of a URL without query and fragment; of anything else what stands before them."""
    return F.regexp_replace(F.regexp_replace(blank(url), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")


def slug(url: Column) -> Column:
    """SCL2: the last segment of the path."""
    return F.element_at(F.split(F.regexp_replace(url_path(url), "/+$", ""), "/"), -1)


def iso_date(x: Column) -> Column:
    """SCL3: dd/mm/20yy as yyyy-mm-dd, whatever the day and month are."""
    pattern = r"\b(\d{1,2})/(\d{1,2})/(20\d{2})\b"
    return F.when(F.rlike(blank(x), F.lit(pattern)), F.concat_ws("-", first(x, pattern, 3), F.lpad(first(x, pattern, 2), 2, "0"), F.lpad(first(x, pattern, 1), 2, "0")))


def _month(x: Column, names: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), F.coalesce(F.lower(x), F.lit("")))


def _checked(y: Column, m: Column, d: Column) -> Column:
    return F.date_format(F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"), "yyyy-MM-dd")


def date_info(x: Column) -> Column:
    """SCL4: struct of the validated ISO date (null if there is no such day) and the text it was read from."""
    y = clean(x)
    slashed, spelled = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b", r"(?i)\b(\d{1,2})\s+de\s+([a-záéíóú]+)\s+(?:de|del)\s+(\d{4})\b"
    year = first(y, slashed, 3).cast("int")
    a = _checked(F.when(year < 100, year + 2000).otherwise(year), first(y, slashed, 2).cast("int"), first(y, slashed, 1).cast("int"))
    month = _month(first(y, spelled, 2), LONG_MONTHS)
    b = F.when(month.isNotNull(), _checked(first(y, spelled, 3).cast("int"), month, first(y, spelled, 1).cast("int")))
    has = F.rlike(y, F.lit(slashed))
    return F.struct(F.when(has, a).otherwise(b).alias("iso"), F.when(has, first(y, slashed, 0)).otherwise(first(y, spelled, 0)).alias("shown"))


def day_month(x: Column, key: Column) -> Column:
    """SCL5: '22 Jul' and the year of the key as yyyy-mm-dd; null if one is missing."""
    pattern = r"(?i)\b(\d{1,2})\s+(ene|feb|mar|abr|may|jun|jul|ago|set|sep|oct|nov|dic)[a-z]*\.?"
    day, month, year = first(x, pattern, 1).cast("int"), _month(first(x, pattern, 2), SHORT_MONTHS), first(key, r"(20\d{2})\b")
    return F.when(day.between(1, 31) & month.isNotNull() & year.isNotNull(), F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")))


def alert_number(text: Column, url: Column) -> Column:
    """SCL6: ``N-YYYY``, named as an alert first, else anywhere."""
    both = F.lower(F.concat_ws(" ", blank(text), blank(url)))
    named, plain = r"alerta[-_\s]*digemid[-_\s]*(?:n[o°º.]*)?[-_\s]*(\d{1,4})[-_/](20\d{2})", r"\b(\d{1,4})[-/](20\d{2})\b"
    of = lambda p: F.when(F.rlike(both, F.lit(p)), F.concat_ws("-", digits(first(both, p, 1)), first(both, p, 2)))
    return F.coalesce(of(named), of(plain))


def document_key(title: Column, url: Column) -> Column:
    """SCL7: alert number, else URL slug, else title slug, else a constant."""
    base = F.lower(deaccent(clean(F.coalesce(some(title), F.lit("documento-digemid")))))
    base = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"[^\w\s-]", ""), r"[-\s]+", "-"), "^-+|-+$", "")
    return F.coalesce(alert_number(title, url), some(F.substring(slug(url), 1, 120)), some(F.substring(base, 1, 120)), F.lit("documento-digemid"))


def _norm_pattern(kind: str, year: str, letters: str) -> str:
    names = NORM_NAMES[kind]
    if names is None:
        return rf"\bLEY\s*{NUMBER_SIGN}\s*(\d{{1,6}}){year}"
    a, b, long = names
    return rf"{letters}(?:{a}\.?\s*{b}\.?|{long.replace(' ', r'\s+')})\s*{NUMBER_SIGN}\s*(\d{{1,4}}){year}"


def norm_identity(*parts: Column) -> Column:
    """SCL10: struct tipo, numero, anio from free text; types are tried in their order."""
    text = F.upper(F.concat_ws(" ", *[some(clean(p)) for p in parts]))
    found = None
    for kind in reversed(list(NORM_NAMES)):
        bound = "[-/](20\\d{2})"
        pattern = _norm_pattern(kind, f"(?:{bound})?" if kind in ("LEY", "DL", "DU") else bound, "")
        value = F.struct(F.lit(kind).alias("tipo"), digits(first(text, pattern, 1)).alias("numero"), first(text, pattern, 2).alias("anio"))
        hit = F.rlike(text, F.lit(pattern))
        found = F.when(hit, value) if found is None else F.when(hit, value).otherwise(found)
    return found


def inventory_key(tipo: Column, numero: Column, anio: Column, title: Column, url: Column) -> Column:
    """SCL10: ``tipo-numero-anio``, ``tipo-numero``, else a hash of title and URL."""
    hashed = F.concat(F.lit("NORM-"), short_hash(F.concat_ws("|", blank(title), blank(url)), 10))
    return F.when(some(tipo).isNotNull() & some(numero).isNotNull(), F.concat_ws("-", tipo, numero, some(anio))).otherwise(hashed)


def norm_key(title: Column, url: Column, section: Column, day: Column) -> Column:
    """SCL8: key with its suffix; without a type ``NORM-section-year-hash``."""
    text = F.upper(clean(F.concat_ws(" ", blank(title), blank(url))))
    tail = r"([/\-][A-Z0-9\-]+)?"
    found = None
    for kind in reversed(KEY_ORDER):
        year = "" if kind in ("DL", "DU", "LEY") else r"[-/](20\d{2})"
        pattern = _norm_pattern(kind, year + tail, r"\b").replace("[ÓO]", "O")
        suffix = F.upper(F.regexp_replace(F.replace(F.replace(F.regexp_extract(text, pattern, 3 if year else 2), F.lit("/"), F.lit("-")), F.lit("--"), F.lit("-")), "^-+|-+$", ""))
        number = digits(first(text, pattern, 1))
        value = F.concat_ws("-", F.lit(kind), number) if kind == "LEY" else F.concat_ws("-", F.lit(kind), number, first(text, pattern, 2) if year else None, some(suffix)) if year else F.concat_ws("-", F.lit(kind), number, some(suffix))
        hit = F.rlike(text, F.lit(pattern))
        found = F.when(hit, value) if found is None else F.when(hit, value).otherwise(found)
    year = F.coalesce(F.when(F.length(blank(day)) >= 4, F.substring(day, 1, 4)), first(text, r"\b(20\d{2})\b"), F.lit("0000"))
    return F.coalesce(found, F.concat_ws("-", F.lit("NORM"), F.upper(section), year, short_hash(text)))


def pdf_key(url: Column) -> Column:
    """SCL9: key from a PDF's file name."""
    name = F.upper(F.regexp_replace(slug(url), r"\.[^.]*$", ""))
    found = None
    for kind in reversed(KEY_ORDER):
        dated = kind in ("RM", "DS", "RD", "RS")
        pattern = rf"\b{kind}[_\-]?(\d{{1,{6 if kind == 'LEY' else 4}}})" + (r"[-_](20\d{2})" if dated else "") + r"(?:[-_]?([A-Z0-9]+))?"
        parts = [F.lit(kind), digits(first(name, pattern, 1))]
        if kind != "LEY":
            # Types without a year have their suffix in the second group, where a year is looked for.
            parts += [first(name, pattern, 2), first(name, pattern, 3)] if dated else [first(name, pattern, 2)]
        hit = F.rlike(name, F.lit(pattern))
        value = F.concat_ws("-", *parts)
        found = F.when(hit, value) if found is None else F.when(hit, value).otherwise(found)
    return found


def norm_type(x: Column) -> Column:
    """SCL11: the short type of a written one; what is unknown stays as it is."""
    raw = F.trim(F.regexp_replace(F.regexp_replace(fold(x), "[^A-Z0-9 ]+", " "), r"\s+", " "))
    has = lambda *words: F.rlike(raw, F.lit("|".join(words)))
    return (
        F.when(raw == "", None).when(raw.isin("RM", "RD", "DS", "DU", "DL", "LEY", "RS"), raw)
        .when(has("RESOLUCION MINISTERIAL"), "RM").when(has("RESOLUCION DIRECTORAL"), "RD").when(has("RESOLUCION SUPREMA"), "RS")
        .when(has("DECRETO SUPREMO"), "DS").when(has("DECRETO DE URGENCIA", "DECRETO URGENCIA"), "DU").when(has("DECRETO LEGISLATIVO", "DECRETO LEY"), "DL")
        .when(has("LEY"), "LEY").otherwise(raw)
    )


def number_key(x: Column) -> Column:
    """SCL12: the first run of digits without leading zeros."""
    return digits(first(x, r"(\d+)"))


def key_parts(key: Column) -> Column:
    """SCL11: struct tipo, numero, anio of a key's dash-separated parts."""
    tokens = F.filter(F.split(F.upper(clean(key)), "-"), lambda t: t != "")
    rest = F.filter(F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens), F.lit(1))), lambda t: F.regexp_replace(t, r"\D+", "")), lambda t: t != "")
    year = F.get(F.filter(rest, lambda t: F.rlike(t, F.lit(r"^(19|20)\d{2}$"))), F.lit(0))
    at = F.array_position(rest, year)
    numbers = F.filter(rest, lambda t, i: (at.isNull()) | (i != at - 1))
    return F.struct(norm_type(F.get(tokens, F.lit(0))).alias("tipo"), digits(F.get(numbers, F.lit(0))).alias("numero"), year.alias("anio"))


def identity(tipo: Column, numero: Column, anio: Column, key: Column) -> Column:
    """SCL11: fields before key parts; struct tipo, numero, anio, key."""
    parts = key_parts(key)
    t = F.coalesce(norm_type(tipo), parts.tipo)
    n = F.coalesce(number_key(numero), parts.numero)
    y = F.coalesce(first(anio, r"((?:19|20)\d{2})"), parts.anio)
    return F.struct(t.alias("tipo"), n.alias("numero"), y.alias("anio"), F.when(t.isNotNull() & n.isNotNull(), F.concat_ws("-", t, n, y)).alias("key"))


def candidate_key(tipo: Column, numero: Column, anio: Column) -> Column:
    """JON12: the key a norm would have; null unless all three are known."""
    n = number_key(numero)
    return F.when(some(tipo).isNotNull() & n.isNotNull() & anio.isNotNull(), F.concat_ws("-", F.upper(tipo), n, anio.cast("string")))


def stub_key(tipo: Column, numero: Column, anio: Column, description: Column) -> Column:
    """SCL26: the key of a norm that is only known by a relation; a hash where even the description is empty."""
    s = F.upper(F.substring(F.regexp_replace(F.regexp_replace(blank(description), "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""), 1, 40))
    named = some(tipo).isNotNull() & some(numero).isNotNull() & anio.isNotNull()
    return F.when(named, F.concat_ws("-", F.upper(tipo), numero, anio.cast("string"))).otherwise(F.concat(F.lit("NORM-"), F.coalesce(some(s), short_hash(F.concat_ws("|", tipo, numero, description)))))


def file_alert_key(path: Column) -> Column:
    """SCL30: alert key in a file's path; two-digit years are of this century."""
    text = F.regexp_replace(F.upper(blank(path)), r"\s+", "")
    pattern = r"ALERTA(?:DIGEMID)?N?\D*?(\d{1,3})[-_ ]?(\d{2,4})"
    year = first(text, pattern, 2)
    return F.when(F.rlike(text, F.lit(pattern)), F.concat_ws("-", digits(first(text, pattern, 1)), F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)))


# Issuers that may end a norm's key in a path, by type; types without one take a number only (fixed values).
PATH_NORMS = {"DS": "SA|MINSA|PCM|JUS|EF", "RM": "MINSA|SA", "RD": "DIGEMID|MINSA", "RS": "SA|MINSA|PCM", "RJ": "MINSA|DIGEMID", "DL": None, "LEY": None}


def file_norm_key(path: Column) -> Column:
    """SCL30: norm key in a file's path."""
    text = F.regexp_replace(F.regexp_replace(fold(path), "[^A-Z0-9]+", "-"), "^-+|-+$", "")
    found = None
    for kind, issuers in reversed(PATH_NORMS.items()):
        pattern = rf"\b({kind})-?(\d{{1,4}})-?(\d{{4}})-?({issuers})\b" if issuers else rf"\b({kind})-?(\d{{{'4,6' if kind == 'LEY' else '1,4'}}})\b"
        value = F.concat_ws("-", *[first(text, pattern, g) for g in range(1, 5 if issuers else 3)])
        hit = F.rlike(text, F.lit(pattern))
        found = F.when(hit, value) if found is None else F.when(hit, value).otherwise(found)
    return found


def inferred_year(day: Column, key: Column) -> Column:
    """SCL20: year of the date, else the key's first four digits; anything else is an error."""
    return F.coalesce(F.year(day), first(key, r"(\d{4})").cast("int"), F.raise_error(F.lit("no year in date or key")).cast("int"))


def crawl_url(url: Column) -> Column:
    """SCL15: repeated slashes of the path become one, the fragment goes."""
    no_fragment = F.regexp_replace(blank(url), "#.*$", "")
    head = F.regexp_extract(no_fragment, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)?([^?]*)(\?.*)?$", 1)
    path = F.regexp_replace(F.regexp_extract(no_fragment, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)?([^?]*)(\?.*)?$", 2), "/{2,}", "/")
    return F.concat(head, F.when(path == "", "/").otherwise(path), F.regexp_extract(no_fragment, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)?([^?]*)(\?.*)?$", 3))


def compared_url(url: Column) -> Column:
    """SCL15: scheme and host in lower case, no query, no trailing slash; empty for null."""
    host = F.lower(F.regexp_extract(blank(url), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    return F.when(blank(url) == "", "").otherwise(F.concat(host, F.regexp_replace(F.regexp_replace(url_path(url), "/+$", ""), "/{2,}", "/")))


def ignored_url(url: Column) -> Column:
    """FLT14: author, listing_page, navigation, category or null."""
    path = F.regexp_replace(F.regexp_replace(F.lower(url_path(url)), "/{2,}", "/"), "/+$", "")
    tail = F.regexp_extract(path, r"^.*?/normas-legales/(.*)$", 1)
    return (
        F.when(F.array_contains(F.split(path, "/"), "author"), "author")
        .when(F.rlike(path, F.lit(r"/page/\d+$")), "listing_page")
        .when(F.rlike(path, F.lit(r"/normas-legales$")), "navigation")
        .when(tail.isin(*CATEGORY_SLUGS), "category")
    )


def is_listing_url(url: Column) -> Column:
    return F.coalesce(ignored_url(url).isin("listing_page", "navigation", "category"), F.lit(False))


def is_detail_url(url: Column) -> Column:
    path = F.regexp_replace(F.lower(url_path(url)), "/{2,}", "/")
    return ignored_url(url).isNull() & F.rlike(path, F.lit(r"/normas-legales/20\d{2}/[^/]+/?$"))


def page_candidates(base: Column, page: Column) -> Column:
    """SRC3: the two addresses a listing's later page may have."""
    path, query = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), "/+$", ""), F.regexp_extract(base, r"\?([^#]*)", 1)
    paged = F.concat(F.regexp_replace(base, r"[?#].*$", ""), F.lit("?"), F.when(query != "", F.concat(query, F.lit("&"))).otherwise(""), F.lit("paged="), page.cast("string"))
    return F.when(page <= 1, F.array(base)).otherwise(F.array_distinct(F.array(F.concat(path, F.lit("/page/"), page.cast("string"), F.lit("/")), paged)))


def lima(ts: Column) -> Column:
    """SCL21: a UTC time in the business zone, five hours behind all year."""
    return ts - F.expr("INTERVAL 5 HOURS")


def lima_calendar(ts: Column) -> Column:
    """SCL21: struct of the business day, its ISO weekday, its week's Monday and Sunday, its month's first day and
    the next month's, and the day's midnight in UTC."""
    local = lima(ts)
    day = F.to_date(local)
    monday = F.to_date(F.date_trunc("week", local))
    month = F.to_date(F.date_trunc("month", local))
    return F.struct(day.alias("day"), (F.weekday(day) + 1).alias("weekday"), monday.alias("monday"), F.date_add(monday, 6).alias("sunday"), month.alias("month"), F.add_months(month, 1).alias("next_month"), (F.date_trunc("day", local) + F.expr("INTERVAL 5 HOURS")).alias("midnight_utc"))


def lima_hour(ts: Column) -> Column:
    """SCL23: the business hour as twelve-hour text."""
    return F.date_format(lima(ts), "h:mm a")

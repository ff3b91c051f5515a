"""Text functions: Column in, Column out, JVM built-ins only.

Tags such as SCL1 name the entry of the operator inventory that a function covers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters whose compatibility decomposition starts with an ASCII letter, and that letter (fixed values).
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝºª"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCYoa"
# Letters that table headers fold by themselves (fixed values).
HEADER_FROM, HEADER_TO = "ÁÉÍÓÚÑ°", "AEIOUNº"
#: Words that carry no information in a title (fixed values).
GENERIC_WORDS = ("alerta", "digemid", "n", "no", "sanitaria", "de")


#: Unicode White_Space, for trimming (fixed values).
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def clean(x: Column) -> Column:
    """SCL1: white space of any kind becomes one blank, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(blank(x), r"(?U)\s+", " "))


def deaccent(x: Column) -> Column:
    """SCL13: accents off, then anything outside ASCII dropped."""
    return F.regexp_replace(F.translate(x, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def fold(x: Column) -> Column:
    """SCL13: accents off, upper case, white space collapsed; other characters stay."""
    return F.trim(F.regexp_replace(F.upper(F.translate(blank(x), ACCENTED, PLAIN)), r"(?U)\s+", " "))


def lower_fold(x: Column) -> Column:
    return F.lower(F.translate(blank(x), ACCENTED, PLAIN))


def header(x: Column) -> Column:
    """SCL14: upper case, the six accented capitals folded, the degree sign made an ordinal sign."""
    inner = F.trim(F.regexp_replace(F.replace(blank(x), F.lit(" "), F.lit(" ")), r"[ \t]+", " "))
    return F.translate(F.upper(inner), HEADER_FROM, HEADER_TO)


def title_key(x: Column) -> Column:
    """SCL16: a title for comparison."""
    y = F.replace(F.replace(F.lower(clean(x)), F.lit("n°"), F.lit("n")), F.lit("nº"), F.lit("n"))
    return clean(F.regexp_replace(y, "[^a-z0-9áéíóúüñ ]+", " "))


def is_generic_title(title: Column, key: Column) -> Column:
    """SCL17: every word of the title is filler or part of the key; an empty title is generic."""
    words = F.filter(F.split(F.regexp_replace(F.lower(deaccent(blank(title))), r"[^a-z0-9_]+", " "), " "), lambda t: t != "")
    parts = F.split(F.lower(blank(key)), r"[-\s]+")
    return F.size(F.array_except(words, F.concat(F.array(*map(F.lit, GENERIC_WORDS)), parts))) == 0


def page_text(x: Column) -> Column:
    """SCL18: lines stripped, three or more line ends become two."""
    y = F.regexp_replace(F.replace(blank(x), F.lit(" "), F.lit(" ")), r"\r\n?", "\n")
    y = F.regexp_replace(y, r"(?m)^[ \t]+|[ \t]+$", "")
    return F.regexp_replace(F.regexp_replace(y, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def cautious_page_text(x: Column) -> Column:
    """SCL18: also runs of blanks become one and blanks before marks go."""
    y = F.regexp_replace(F.regexp_replace(page_text(x), r"[ \t]+", " "), r"[ \t]+([,.;:!?])", "$1")
    return F.regexp_replace(F.regexp_replace(y, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def html_escape(x: Column) -> Column:
    """SCL24."""
    return F.replace(F.replace(F.replace(blank(x), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def percentage(part: Column, total: Column) -> Column:
    """SCL22: one decimal, without it if it is zero for a zero total."""
    return F.when(total == 0, "0%").otherwise(F.concat(F.format_string("%.1f", F.round(part * 100.0 / total, 1)), F.lit("%")))


def short_hash(x: Column, length: int = 8) -> Column:
    """SCL25."""
    return F.upper(F.substring(F.sha1(x), 1, length))


def file_name(x: Column) -> Column:
    """SCL19: characters that file systems refuse become an underscore, white space one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(blank(x), r'[\\/:*?"<>|]+', "_"), r"\s+", " "))


def copy_name(key: Column, day: Column, original: Column) -> Column:
    """SCL19: ``key__date__original``; a missing date is ``sin-fecha``."""
    return F.concat_ws("__", key, F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("sin-fecha")), file_name(original))


def squeezed(x: Column) -> Column:
    """Text for the comparison of quotes: one blank for white space, lower case."""
    return F.lower(clean(x))


def quoted_in(fragment: Column, text: Column) -> Column:
    """FTS8: the fragment stands in the text, white space and case aside; an empty one does not."""
    return F.when(blank(fragment) == "", F.lit(False)).otherwise(F.contains(squeezed(text), squeezed(fragment)))


def tolerant_json(x: Column, schema: str) -> Column:
    """SCL27: strict first, then control characters blanked, then stray escapes doubled, then the
    first braces' stretch. Code fences are stripped before."""
    body = F.trim(F.regexp_replace(blank(x), r"(?s)^\s*```(?:json)?|```\s*$", ""))
    plain = F.regexp_replace(body, r"[\x00-\x1F]", " ")
    repaired = F.regexp_replace(plain, r'\\(?!["\\/bfnrtu])', r"\\\\\\\\")
    inner = F.regexp_extract(repaired, r"(?s)(\{.*\})", 1)
    tries = [F.from_json(y, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}) for y in (body, plain, repaired, inner)]
    ok = [F.when(F.expr("true") & (F.get_json_object(y, "$").isNotNull()), t) for y, t in zip((body, plain, repaired, inner), tries, strict=True)]
    return F.coalesce(*ok)

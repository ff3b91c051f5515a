"""Listing and detail pages: links, titles, dates and files out of html."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tidewell.functions.keys import alert_number, document_key, first, is_detail_url, is_listing_url, iso_date
from tidewell.functions.text import blank, clean

#: Titles that say nothing (fixed values).
USELESS_TITLES = ("read more...", "leer más", "leer mas", "alertas")


def tags_off(x: Column) -> Column:
    return clean(F.regexp_replace(F.regexp_replace(blank(x), r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>", " "))


def anchors(pages: DataFrame) -> DataFrame:
    """SRC1: a row for each link (``page_id, pos, href, text``); regular expressions in the JVM, no parser."""
    found = F.regexp_extract_all("html", F.lit(r"""(?is)(<a\b[^>]*\bhref\s*=\s*["'][^"']*["'][^>]*>.*?</a>)"""), 1)
    rows = pages.select("page_id", "url", F.posexplode(found).alias("pos", "a"))
    return rows.select("page_id", "url", "pos", F.trim(F.regexp_extract("a", r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1)).alias("href"), tags_off(F.col("a")).alias("text"))


def absolute(base: Column, href: Column) -> Column:
    """A link's address: full ones stay, rooted ones take the page's host, the rest its folder."""
    host, folder = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([^?#]*/)[^/?#]*", 1)
    return F.when(F.rlike(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href)).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, href))


def alerts(links: DataFrame) -> DataFrame:
    """SRC1: alert records of links: strict ones are alerts, links that only look like it are near misses."""
    url = absolute(F.col("url"), F.col("href"))
    low, text = F.lower(url), F.lower(F.col("text"))
    strict = F.contains(low, F.lit("alerta-digemid")) | F.contains(text, F.lit("alerta digemid")) | F.contains(F.replace(low, F.lit("-"), F.lit(" ")), F.lit("alerta digemid"))
    near = F.rlike(low, F.lit(r"/alertas-modificaciones/20\d{2}/[^/]+/?$"))
    kept = links.select("page_id", "pos", url.alias("detail_url"), "text", strict.alias("strict"), near.alias("near")).filter("strict OR near")
    key = document_key(F.col("text"), F.col("detail_url"))
    shown = first(F.col("text"), r"\b(\d{1,2}/\d{1,2}/20\d{2})\b")
    return kept.withColumns({"document_key": key, "title": F.coalesce(F.nullif("text", F.lit("")), F.concat(F.lit("Alerta DIGEMID "), key)), "published_date": iso_date(F.col("text")), "published_date_display": shown})


def detail(pages: DataFrame) -> DataFrame:
    """SRC5: the first usable title, the first date and the first PDF link of a detail page."""
    def titled(tag: str) -> Column:
        t = tags_off(F.regexp_extract("html", rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1))
        t = F.trim(F.regexp_replace(clean(F.replace(F.replace(t, F.lit("DIGEMID"), F.lit("")), F.lit("|"), F.lit(""))), r"^[ -]+|[ -]+$", ""))
        return F.when((t != "") & ~F.lower(t).isin(*USELESS_TITLES), t)

    def classed(name: str) -> Column:
        t = tags_off(F.regexp_extract("html", rf"""(?is)<(\w+)\b[^>]*class\s*=\s*["'][^"']*\b{name}\b[^"']*["'][^>]*>(.*?)</\1>""", 2))
        return F.when(t != "", t)

    title = F.coalesce(titled("h1"), titled("h2"), classed("entry-title"), classed("post-title"), classed("page-title"), titled("title"))
    pdf = first(F.col("html"), r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*\.pdf[^"']*)["']""")
    shown = first(tags_off(F.col("html")), r"\b(\d{1,2}/\d{1,2}/20\d{2})\b")
    return pages.select("page_id", title.alias("title"), shown.alias("published_date_display"), iso_date(shown).alias("published_date"), absolute(F.col("url"), pdf).alias("file_url"))


def longest_text(links: DataFrame) -> DataFrame:
    """TOP12: of each page the longest text of a link that is no PDF; the first of equals."""
    rows = links.filter((F.col("text") != "") & ~F.contains(F.lower("href"), F.lit(".pdf")))
    return rows.groupBy("page_id").agg(F.min_by("text", F.struct(-F.length("text"), F.col("pos"))).alias("title"))


def canonical_url(urls: DataFrame, key: str) -> DataFrame:
    """TOP8: no listing, then a detail page, then the shortest; the smaller of equals."""
    place = F.struct(is_listing_url(F.col("url")), ~F.coalesce(is_detail_url(F.col("url")), F.lit(False)), F.length("url"), F.col("url"))
    return urls.groupBy(key).agg(F.min_by("url", place).alias("canonical"))


def chosen_pdf(links: DataFrame) -> DataFrame:
    """TOP9: of each page the PDF link of the best folder; the first of equals."""
    low = F.lower("href")
    place = F.when(F.contains(low, F.lit("archivos/normatividad")), 0).when(F.contains(low, F.lit("archivos")), 1).otherwise(2)
    return links.filter(F.contains(low, F.lit(".pdf"))).groupBy("page_id").agg(F.min_by("href", F.struct(place, F.col("pos"))).alias("pdf"))


class _Containers(HTMLParser):
    BOXES = frozenset(("article", "li", "section", "div", "tr", "td"))

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.boxes: list[dict] = []
        self.open: list[dict] = []
        self.href: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.BOXES:
            box = {"tag": tag, "text": [], "links": []}
            self.boxes.append(box)
            self.open.append(box)
        elif tag == "a":
            self.href = dict(attrs).get("href")
            if self.href and self.open:
                self.open[-1]["links"].append(self.href)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.BOXES and any(b["tag"] == tag for b in self.open):
            while self.open and self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data: str) -> None:
        for box in self.open:
            box["text"].append(data)


@udtf(returnType="container int, text string, pdf_urls array<string>, detail_urls array<string>")
class Inventory:
    """SRC2: links grouped by the container element they stand in."""

    def eval(self, html: str) -> Iterator[tuple]:
        reader = _Containers()
        reader.feed(html or "")
        for number, box in enumerate(reader.boxes):
            if box["links"]:
                links = sorted(set(box["links"]))
                yield number, " ".join("".join(box["text"]).split()), [x for x in links if ".pdf" in x.lower()], [x for x in links if ".pdf" not in x.lower()]


def is_pdf(content: Column, content_type: Column, size: Column, least: int = 1000) -> Column:
    """SCL29: magic bytes, a fitting content type and enough bytes."""
    typed = F.rlike(F.lower(blank(content_type)), F.lit("pdf|octet-stream")) | (blank(content_type) == "")
    return F.coalesce((F.substring(content, 1, 4) == F.lit(b"%PDF")) & typed & (size >= least), F.lit(False))


def numbered(links: DataFrame) -> DataFrame:
    return links.withColumn("number", alert_number(F.col("text"), F.col("href")))

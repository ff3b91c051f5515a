"""Full-text search over pages: tokens, ranking, routing, context and suggestions.

Terms are stems of tokens (``functions.spanish``); ``stem=False`` searches whole tokens.
The query side is a handful of literals, so pages are matched inside the scan: no term
table is shuffled, only the best ``k`` rows of each task reach the final sort.  Only
tokens that begin as a wanted stem does are stemmed there; a stored term table
(``term_table``) stems each distinct token once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import spanish
from tidewell.functions.text import ACCENTED, PLAIN, blank, let, lower_fold, quoted_in, squeezed
from tidewell.operators.patterns import found_in
from tidewell.operators.store import durable

#: Words that a query does not search for (fixed values).
STOP_WORDS = (
    "que qué de del la el los las un una unos unas y o en con por para se es fue son esta está este estos estas sobre hay hubo ha han sido "
    "cual cuál cuales cuáles quien quién quienes quiénes como cómo donde dónde cuando cuándo porque a al su sus le les lo me mi tu ya muy mas más "
    "pero si sí no sin entre hasta desde sera será seria sería fueron paso pasó"
).split()
#: Normaliser of the rank: sum of 1/i^2 (fixed value), weight of a term, most places of a term.
PI_SIXTH, WEIGHT, PLACES = 1.64493406685, 0.1, 255
#: Starts of stretches that are followed together.
STARTS = 1024
#: Room for rounding in bounds.
ROUND = 1 + 1e-9
_FOLD = str.maketrans(ACCENTED, PLAIN)
#: What separates tokens.
BETWEEN = "[^a-záéíóúñü0-9]+"


def query_tokens(x: Column) -> Column:
    """FTS1: distinct words of at least three letters that are not stop words."""
    words = F.filter(F.split(F.lower(blank(x)), BETWEEN), lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))
    return F.array_distinct(words)


def tokens_of(query: str) -> list[str]:
    """The same for a literal."""
    words = [w for w in re.split(BETWEEN, query.lower()) if len(w) >= 3 and w not in STOP_WORDS]
    return list(dict.fromkeys(words))


def stems_of(spark: SparkSession, words: list[str]) -> list[str]:
    """The stems of a few literals, each once, sorted."""
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(spanish.stem(F.col("w")).alias("stem")).collect()
    return sorted({r.stem for r in rows if r.stem})


def matches(text: Column, words: list[str]) -> Column:
    """FTS2: whether some of the words stands in the text, as a token or inside one; plain searches, no pattern."""
    low, out = F.lower(blank(text)), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w))
    return out


def _mean(places: list[Column]) -> Column:
    """FTS3: mean over words of weight times the sum of 1/i^2 over a word's places, to twelve digits."""
    total = F.lit(0.0)
    for n in places:
        total = total + _harmonic(n) * WEIGHT / PI_SIXTH
    return F.round(total / len(places), 12)


def rank(text: Column, words: list[str]) -> Column:
    """FTS3 for whole tokens. The text is brought to tokens between single blanks on either side once; a word's places are what its removal
    shortens that by."""
    spaced = F.regexp_replace(F.lower(blank(text)), BETWEEN, "  ")
    places = lambda s, w: ((F.length(s) - F.length(F.replace(s, F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("int")
    return let(F.concat(F.lit(" "), spaced, F.lit(" ")), lambda s: _mean([places(s, w) for w in words]))


def stem_rank(text: Column, stems: list[str]) -> Column:
    """FTS3 for stems: one pass over the text takes the tokens that begin like a wanted stem, and of these each distinct
    one of the page is stemmed."""
    accents = dict(zip(spanish.BARE, spanish.ACUTE, strict=True))
    begin = "|".join(sorted({"".join(f"[{c}{accents[c]}]" if c in accents else c for c in spanish.beginning(s)) for s in stems}))
    inside = BETWEEN.replace("^", "").removesuffix("+")
    tokens = F.regexp_extract_all(F.lower(blank(text)), F.lit(f"(?<!{inside})(?:{begin}){inside}*+"), F.lit(0))

    def ranked(found: Column) -> Column:
        forms = let(F.array_distinct(found), lambda f: F.map_from_arrays(f, F.transform(f, spanish.stem)))
        return let(let(forms, lambda m: F.transform(found, lambda t: m[t])), lambda each: _mean([F.size(F.filter(each, F.lit(s).__eq__)) for s in stems]))

    return let(tokens, ranked)


def _harmonic(n: Column) -> Column:
    return let(F.least(n, F.lit(PLACES)).cast("int"), lambda m: F.when(m < 1, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0), lambda a, i: a + F.lit(1.0) / (i * i))))


PAGE_FIELDS = {"text_content": "string", "page_number": "long", "document_key": "string", "title": "string", "published_date": "date", "detail_url": "string", "quality_score": "double", "has_tables": "boolean", "posible_formula": "boolean", "ocr_confidence": "double", "revisado_manual": "boolean", "estado_vigencia": "string"}
#: Fields that earlier versions of the search lack.
VERSIONS = {1: 6, 2: 6, 3: 11, 4: 12}


def aligned(pages: DataFrame) -> DataFrame:
    """SET1: the search's columns, missing ones null or false."""
    default = {"has_tables": F.lit(False), "posible_formula": F.lit(False), "revisado_manual": F.lit(False)}
    return pages.select([(F.coalesce(F.col(c), default[c]) if c in default else F.col(c)).cast(t).alias(c) if c in pages.columns else default.get(c, F.lit(None)).cast(t).alias(c) for c, t in PAGE_FIELDS.items()])


def search(alerts: DataFrame, norms: DataFrame | None, query: str, k: int = 4, stem: bool = True, version: int = 4) -> DataFrame:
    """SET1, SET2, TOP6: the best pages of both kinds; a query without words finds nothing.

    Ties: by document key and page."""
    words = tokens_of(query)
    both = aligned(alerts)
    if norms is not None and version > 1:
        both = both.unionByName(aligned(norms))
    if words and stem:
        words = stems_of(alerts.sparkSession, words)
    if not words:
        return both.withColumn("rank", F.lit(0.0)).limit(0)
    # Of whole tokens only pages that may hold a word are ranked; the stems of others are not known before. Pages of
    # rank 0 sort last, so they are dropped from the best ones and the rank is computed once.
    found = both.filter("text_content IS NOT NULL") if stem else both.filter(matches(F.col("text_content"), words))
    ranked = found.withColumn("rank", (stem_rank if stem else rank)(F.col("text_content"), words))
    return ranked.select(*kept_columns(version), "rank").orderBy(F.col("rank").desc(), "document_key", "page_number").limit(k).filter("rank > 0")


def kept_columns(version: int) -> list[str]:
    """SET2: what a version of the search returns."""
    return list(PAGE_FIELDS)[: VERSIONS[version]]


def warnings(low: float = 0.5, high: float = 0.85) -> Column:
    """FTS7: what a reader of the page must be told; validity first, the rest only for unreviewed pages."""
    state, q = F.col("estado_vigencia"), F.col("quality_score")
    open_ = ~F.coalesce(F.col("revisado_manual"), F.lit(False))
    return F.array_compact(F.array(
        F.when(state.isNotNull() & (state != "vigente"), F.when(state == "modificada", "norm_modified").otherwise("norm_repealed")),
        F.when(open_ & (q < low), "low_reliability").when(open_ & (q < high), "medium_reliability"),
        F.when(open_ & F.col("has_tables"), "flattened_table"),
        F.when(open_ & F.col("posible_formula"), "possible_formula"),
    ))


def context(pages: DataFrame, low: float = 0.5, high: float = 0.85) -> DataFrame:
    """FTS7: each page as a block of head, warnings, text and link."""
    said = F.array_join(warnings(low, high), "; ")
    head = F.concat(F.lit("[Documento "), blank(F.col("document_key")), F.lit(" - "), blank(F.col("title")), F.lit(" - pagina "), F.col("page_number").cast("string"), F.lit("]"))
    block = F.array_join(F.array_compact(F.array(head, F.when(said != "", F.concat(F.lit("ADVERTENCIA: "), said, F.lit("."))), blank(F.col("text_content")), F.concat(F.lit("Link oficial: "), blank(F.col("detail_url"))))), "\n")
    return pages.withColumns({"warnings": said, "block": block})


def route(question: Column) -> Column:
    """FTS6: which query answers a question; the first rule that holds."""
    q = lower_fold(question)
    has = lambda p: F.rlike(q, F.lit(p))
    when = F.when(has(r"\bhoy\b"), "today").when(has(r"\bsemana\b"), "week").when(has(r"\bmes\b"), "month")
    alerts = has("alerta")
    counted = has(r"\bcuant[oa]s?\b") & alerts & when.isNotNull()
    latest = alerts & has(r"\b(ultima|ultimas|ultimo|ultimos|reciente|recientes|nueva|nuevas|nuevo|nuevos)\b")
    return F.when(counted, F.concat(F.lit("count_"), when)).when(alerts & when.isNotNull(), F.concat(F.lit("list_"), when)).when(latest, "latest").otherwise("full_text")


def asked_limit(question: Column) -> Column:
    """TOP15: a number from 1 to 10, else five for plural, one for singular, five otherwise."""
    q = lower_fold(question)
    number = F.nullif(F.regexp_extract(q, r"\b(10|[1-9])\b", 1), F.lit("")).cast("int")
    return F.coalesce(number, F.when(F.rlike(q, F.lit(r"\b(ultimas|ultimos|recientes|nuevas|nuevos)\b")), 5).when(F.rlike(q, F.lit(r"\b(ultima|ultimo|reciente|nueva|nuevo)\b")), 1).otherwise(5))


def sources(pages: DataFrame) -> DataFrame:
    """TOP4: the pages' links, each once, with the first page that has it (by rank order)."""
    first = F.min_by(F.struct("document_key", "page_number"), F.struct(-F.col("rank"), F.col("document_key"), F.col("page_number")))
    return pages.filter("detail_url IS NOT NULL").groupBy("detail_url").agg(first.alias("p")).select("detail_url", "p.document_key", "p.page_number")


def trigrams(x: Column) -> Column:
    """Trigrams of the words, each with two blanks before and one behind it."""
    words = F.array_distinct(F.filter(F.split(lower_fold(x), "[^a-z0-9]+"), lambda w: w != ""))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def _wanted(spark: SparkSession, query: str) -> list[str]:
    return spark.createDataFrame([(query,)], "q string").select(trigrams(F.col("q"))).first()[0]


def _share(text: Column, grams: list[str]) -> Column:
    """The share of a few trigrams that a text has: with three blanks between its words, each is found by a plain search."""
    spaced = F.concat(F.lit("  "), F.regexp_replace(lower_fold(text), "[^a-z0-9]+", "   "), F.lit(" "))

    def found(s: Column) -> Column:
        n = F.lit(0)
        for g in grams:
            n = n + F.contains(s, F.lit(g)).cast("int")
        return n

    return let(spaced, found) / len(grams)


def suggestions(pages: DataFrame, query: str, k: int = 3, least: float = 0.15, by_words: bool = True) -> DataFrame:
    """FTS5, AGG7: documents whose pages are the most similar to the query by ``word_similarity``, each by its best page.

    The share of the query's trigrams in the whole page bounds it from above, so only pages above ``least`` by their
    share go to Python. ``by_words=False``: by that share itself."""
    grams = _wanted(pages.sparkSession, query)
    if not grams:
        return pages.select("document_key", F.lit(0.0).alias("similarity")).limit(0)
    scored = pages.select("document_key", "text_content", _share(F.col("text_content"), grams).alias("similarity"))
    return _best(scored, query, k, least, by_words)


def _best(scored: DataFrame, query: str, k: int, least: float, by_words: bool) -> DataFrame:
    if by_words:
        kept = scored.filter(F.col("similarity") > least).select("document_key", "text_content", "similarity")
        kinds = T.StructType([kept.schema["document_key"], T.StructField("similarity", T.DoubleType())])
        scored = kept.mapInArrow(lambda batches: _task_best(batches, query, k, least), kinds)
    return scored.groupBy("document_key").agg(F.max("similarity").alias("similarity")).filter(F.col("similarity") > least).orderBy(F.col("similarity").desc(), "document_key").limit(k)


def _task_best(batches: Iterator[pa.RecordBatch], query: str, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """Of a task's pages (``document_key, text_content, similarity`` as a bound) the best similarity of its ``k`` best
    documents, by similarity and key. A page that cannot reach the last of these is not read."""
    best: dict = {}
    floor = least
    kind = None
    for batch in batches:
        kind = batch.schema.field("document_key").type
        bounds = batch.column("similarity").to_numpy()
        for i in np.argsort(-bounds, kind="stable").tolist():
            if bounds[i] < floor:
                break
            key, text = batch.column("document_key")[i].as_py(), batch.column("text_content")[i].as_py()
            found = word_similarity(query, text or "", np.nextafter(max(floor, best.get(key, 0.0)), 0.0))
            if found >= floor and found > best.get(key, 0.0):
                best[key] = found
                if len(best) > k:
                    best = dict(sorted(best.items(), key=lambda x: (-x[1], x[0] is not None, x[0]))[:k])
                if len(best) == k:
                    floor = max(floor, min(best.values()))
    if best:
        yield pa.RecordBatch.from_arrays([pa.array(list(best), kind), pa.array(list(best.values()), pa.float64())], ["document_key", "similarity"])


def gram_table(pages: DataFrame, buckets: int = 64) -> DataFrame:
    """FTS5: each trigram of a page once, ``bucket`` by its hash, to be stored by bucket: a query reads the pages of its own trigrams."""
    rows = pages.select("document_key", "page_number", F.explode(trigrams(F.col("text_content"))).alias("gram"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))


def suggestions_indexed(index: DataFrame, pages: DataFrame, query: str, k: int = 3, least: float = 0.15, buckets: int = 64) -> DataFrame:
    """FTS5, AGG7 over a stored trigram table: only pages that share enough trigrams with the query are read."""
    grams = _wanted(pages.sparkSession, query)
    if not grams:
        return pages.select("document_key", F.lit(0.0).alias("similarity")).limit(0)
    mine = index.filter(F.col("gram").isin(*grams) & F.col("bucket").isin(*_buckets(index, grams, buckets)))
    shares = mine.groupBy("document_key", "page_number").agg((F.count("*") / len(grams)).alias("similarity")).filter(F.col("similarity") > least)
    return _best(pages.join(shares, ["document_key", "page_number"]).select("document_key", "text_content", "similarity"), query, k, least, True)


def _grams(text: str) -> np.ndarray:
    """The trigrams of the text's words in order, as numbers."""
    words = re.findall("[a-z0-9]+", text.translate(_FOLD).lower())
    if not words:
        return np.zeros(0, np.int64)
    padded = np.frombuffer("".join(f"  {w} " for w in words).encode(), np.uint8).astype(np.int64)
    codes = (padded[:-2] << 16) | (padded[1:-1] << 8) | padded[2:]
    inside = np.ones(len(codes), bool)
    ends = np.cumsum([len(w) + 3 for w in words])[:-1]
    inside[ends - 1] = inside[ends - 2] = False  # these reach into the next word
    return codes[inside]


def word_similarity(query: str, text: str, floor: float = 0.0) -> float:
    """Greatest similarity of the query's trigrams with those of a stretch of the text's trigrams (public definition):
    common ones over all different ones of both.

    The best stretch begins at one of the query's trigrams that is not in it again, and ends at the first of another
    after that. So each start is followed to its trigram's next place, or until the stretch has so many different
    trigrams that none of the query's would lift it above the best: all stretches count, whatever their length. Starts
    with the most of the query's trigrams before that place go first, and end the search where these are too few. The
    first steps of many starts are taken together. A similarity of at most ``floor`` may come out as ``floor``."""
    wanted = np.unique(_grams(query))
    found = _grams(text)
    m = len(wanted)
    ours = np.isin(found, wanted)
    starts = np.flatnonzero(ours)
    if not m or not len(starts):
        return 0.0
    order = np.argsort(found, kind="stable")
    same = found[order[1:]] == found[order[:-1]]
    before, after = np.full(len(found), -1), np.full(len(found), len(found))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    best, inside = floor, np.concatenate([[0], np.cumsum(ours)])
    most = np.minimum(inside[after[starts]] - inside[starts], m) / m
    order = np.argsort(-most, kind="stable")
    starts, most = starts[order], most[order]
    for low in range(0, len(starts), STARTS):
        width = int(min(8 * m, m / best if best else 8 * m)) + 1
        part = starts[low : low + STARTS][most[low : low + STARTS] > best]
        if not len(part):
            break
        places = part[:, None] + np.arange(width)
        held = places < after[part][:, None]
        places = np.minimum(places, len(found) - 1)
        new = (before[places] < part[:, None]) & held
        mine = new & ours[places]
        counts, common = np.cumsum(new, 1), np.cumsum(mine, 1)
        best = max(best, float(np.max(common / (m + counts - common), where=mine, initial=0.0)))
        ends, bounds, different, common = after[part], most[low : low + len(part)], counts[:, -1], common[:, -1]
        open_ = np.flatnonzero((part + width < ends) & (bounds * m * ROUND > best * (m + different - common)))
        for i, end, bound, d, c in zip(*(x[open_].tolist() for x in (part, ends, bounds, different, common)), strict=True):
            best = _followed(before, ours, m, bound * m * ROUND, i, i + width, end, d, c, best)
    return best


def _followed(before: np.ndarray, ours: np.ndarray, m: int, most: float, start: int, at: int, end: int, different: int, common: int, best: float) -> float:
    """The best similarity of ``best`` and the stretches from ``start`` that end at ``at`` or behind it; these have
    ``most`` of the query's trigrams at most, so their similarity is at most ``most / (m + different - common)``."""
    step = 8 * m
    while at < end and most > best * (m + different - common):
        new = before[at : min(at + step, end)] < start
        places = np.flatnonzero(new & ours[at : at + len(new)])
        counts = different + np.cumsum(new)
        if len(places):
            c = common + np.arange(1, len(places) + 1)
            best = max(best, float((c / (m + counts[places] - c)).max()))
        different, common = int(counts[-1]), common + len(places)
        at, step = at + len(new), 2 * step
    return best


def word_similarity_udf(query: str):
    """FTS5 as a pandas UDF, for stretches rather than whole texts."""
    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: word_similarity(query, t))

    return score


@F.pandas_udf(T.DoubleType())
def changed_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """FTS9: changed words over the longer text's words, by the standard library's sequence matcher."""
    from difflib import SequenceMatcher

    def one(x: str | None, y: str | None) -> float:
        left, right = (x or "").split(), (y or "").split()
        ops = SequenceMatcher(None, left, right, autojunk=False).get_opcodes()
        return sum(max(i2 - i1, j2 - j1) for op, i1, i2, j1, j2 in ops if op != "equal") / max(len(left), len(right), 1)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def verified_quotes(items: DataFrame, pages: DataFrame) -> DataFrame:
    """FTS8: for each (document, fragment) pair whether the document's own text holds the fragment."""
    return items.join(pages, "doc_id").withColumn("verified", quoted_in(F.col("fragment"), F.col("text")))


def documents_with(fragments: DataFrame, docs: DataFrame) -> DataFrame:
    """FTS8 over all documents: ``item_id, doc_id`` of each fragment (``item_id, fragment``) with each document
    (``doc_id, text``) that quotes it, white space and case aside. The documents are read once for all fragments."""
    asked = fragments.select("item_id", squeezed(F.col("fragment")).alias("k")).filter("k != ''")
    found = found_in(asked, docs.select(F.col("doc_id").alias("id"), squeezed(F.col("text")).alias("rt")))
    return asked.join(found, "k").select("item_id", F.col("id").alias("doc_id"))


def term_table(pages: DataFrame, buckets: int = 64) -> DataFrame:
    """FTS4: the pages' stems with how often each occurs, ``bucket`` by the stem's hash: the one structure worth
    storing (``write.partitionBy("bucket")``), as a query then reads its own stems' buckets only.

    Occurrences combine inside each page, in its sorted tokens, before a row is made of them. Each distinct token is
    stemmed once: the stems are kept, as a wanted stem would otherwise be looked for by stemming every occurrence."""
    tokens = F.sort_array(F.filter(F.split(F.lower(blank(F.col("text_content"))), BETWEEN), lambda w: w != ""))
    runs = let(tokens, lambda t: let(F.filter(F.transform(t, lambda w, i: F.when((i == 0) | (w != F.get(t, i - 1)), i)), lambda i: i.isNotNull()), lambda first: F.transform(first, lambda i, n: F.struct(F.get(t, i).alias("token"), (F.coalesce(F.get(first, n + 1), F.size(t)) - i).alias("tf")))))
    counted = pages.select("document_key", "page_number", F.inline(runs))
    distinct = pages.select(F.explode(F.array_distinct(tokens)).alias("token")).distinct()
    stems = durable(distinct.select("token", spanish.stem(F.col("token")).alias("term")))
    found = counted.join(stems, "token").groupBy("document_key", "page_number", "term").agg(F.sum("tf").alias("tf"))
    return found.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))


def search_terms(index: DataFrame, query: str, k: int = 4, buckets: int = 64) -> DataFrame:
    """FTS2, FTS3, TOP6 over a stored term table: ``document_key, page_number, rank``."""
    words = stems_of(index.sparkSession, tokens_of(query)) if tokens_of(query) else []
    if not words:
        return index.select("document_key", "page_number", F.lit(0.0).alias("rank")).limit(0)
    mine = index.filter(F.col("term").isin(*words) & F.col("bucket").isin(*_buckets(index, words, buckets)))
    score = F.round(F.sum(_harmonic(F.col("tf")) * WEIGHT / PI_SIXTH) / len(words), 12)
    return mine.groupBy("document_key", "page_number").agg(score.alias("rank")).orderBy(F.col("rank").desc(), "document_key", "page_number").limit(k)


def _buckets(index: DataFrame, words: list[str], buckets: int) -> list[int]:
    """The buckets of a few literals, so that partitions are pruned before the scan."""
    rows = index.sparkSession.range(1).select(*[F.pmod(F.xxhash64(F.lit(w)), F.lit(buckets)).cast("int") for w in words]).first()
    return sorted(set(rows))

"""Personal data: rules, and boosted trees over what high-recall generators propose.

Base spans are the leftmost non-overlapping matches of four patterns; a match that
fails its check is dropped and not tried again.  Generators then propose many, also
overlapping, candidates that the rules miss: numbers without a plus sign, parts of
longer runs of digits, addresses that are spelled out, IPv6.  Boosted trees score a
candidate by its format (digits, groups, separators, checksums) and its context
(neighbouring characters, words before it).  Scores are calibrated on held-back rows,
and each kind's threshold is the least that keeps the precision asked for there.
Chosen candidates that overlap a base span or a better candidate are left out; base
spans always stay.  The trees learn from invented lines with planted spans and hard
negatives, so no document's text is a label.

Places are in code points, ends exclusive.

Cases: null or empty text has no spans; repeated rows are each searched; null ids
are kept; other columns are ignored; an empty table gives no rows; a long text of any
content, runs of digits or of signs too, is searched in time linear in its length.
"""

from __future__ import annotations

import bisect
import functools
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import boosting
from tidewell.llm.common import id_and_text, nothing_held, rows_of, small_batches, texts

KINDS = ("email", "ip", "card", "phone")
# The patterns of the base rules (fixed values).
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The matches of ``IP``: one cannot begin inside a run of digits, as it could begin before it; so each run is read once
#: for each part that it can be.
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # start, place in KINDS, end


_DOUBLED = bytes.maketrans(b"0123456789", bytes([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]))


def luhn(digits: str) -> bool:
    own = digits.encode()
    return (sum(own[-1::-2]) - 48 * len(own[-1::-2]) + sum(own[-2::-2].translate(_DOUBLED))) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _local_start(text: str, end: int, least: int) -> int:
    """Where the run of local-part characters that ends at ``end`` begins, not before ``least``."""
    while end > least and text[end - 1] in _LOCAL:
        end -= 1
    return end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern finds them, looking only around each @: a local part is the whole run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = _local_start(text, at, done)
        if start < at and (m := EMAIL.match(text, start)):
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    found = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        found += [(m.start(), 1, m.end()) for m in _DOTTED.finditer(text) if all(map(_octet, m[0].split(".")))]
        found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


_RUN = re.compile(r"\+?\(?[0-9][0-9 ().\-/]{5,}[0-9]")
_GROUP = re.compile(r"[0-9]+")
_AT = r"(?:[\[({]\s?(?:at|AT)\s?[\])}]|\s(?:at|AT)\s|@)"
_DOT = r"(?:[\[({]\s?(?:dot|DOT)\s?[\])}]|\s(?:dot|DOT)\s|\.)"
_SPELLED_AT = re.compile(_AT)
#: From the sign for "at" on.
_SPELLED = re.compile(rf"\s?{_AT}\s?[A-Za-z0-9-]++(?:\s?{_DOT}\s?[A-Za-z0-9-]++)+")
_SIGN = re.compile(r"[\[({]\s?(?:at|AT)\s?[\])}]|\s(?:dot|DOT)\s|[\[({]\s?(?:dot|DOT)\s?[\])}]")
_V6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:{1,2}){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
#: Digits of the longest card number; a candidate has no more.
DIGITS = 19


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses that hold a spelled-out sign, whole: the run before each "at", and what follows it."""
    signs = [m.start() for m in _SIGN.finditer(text)]
    done, at = 0, _SPELLED_AT.search(text) if signs else None
    while at:
        space = at.start() > done and text[at.start() - 1].isspace()
        start = _local_start(text, at.start() - space, done)
        m = _SPELLED.match(text, at.start() - space) if start < at.start() - space else None
        if m and (k := bisect.bisect_left(signs, start)) < len(signs) and signs[k] < m.end():
            yield start, m.end()
        done = m.end() if m else done
        at = _SPELLED_AT.search(text, max(at.start() + 1, done))


def candidates(text: str, taken: Covered | None = None) -> list[Span]:
    """High recall: every stretch of digit groups that could be a phone or card number, and the rest; with ``taken``
    only what does not overlap it."""
    out: list[Span] = []
    if re.search("[0-9]", text):
        for run in _RUN.finditer(text):
            groups = [(m.start(), m.end()) for m in _GROUP.finditer(text, run.start(), run.end())]
            for i, (start, _) in enumerate(groups):
                size, j = 0, i
                while j < len(groups) and not (taken and taken.overlaps(start, groups[j][1])) and (size := size + groups[j][1] - groups[j][0]) <= DIGITS:
                    if 7 <= size <= 15:
                        left = start - (start > 0 and text[start - 1] == "(")
                        out.append((left - (left > 0 and text[left - 1] == "+"), 3, groups[j][1]))
                    if 13 <= size:
                        out.append((start, 2, groups[j][1]))
                    j += 1
        if "::" in text or text.count(":") > 3:
            out += [(m.start(), 1, m.end()) for m in _V6.finditer(text) if m[0].count(":") >= 3 or "::" in m[0]]
    out += [(s, 0, e) for s, e in _spelled(text)]
    return sorted({s for s in out if not (taken and taken.overlaps(s[0], s[2]))})


class Covered:
    """Stretches of a text, to be asked whether any overlaps another one; touching is no overlap."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, _, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.ends, start)
        return k < len(self.starts) and self.starts[k] < end

    def add(self, start: int, end: int) -> None:
        """A stretch that overlaps none."""
        k = bisect.bisect_left(self.starts, start)
        self.starts.insert(k, start)
        self.ends.insert(k, end)


# Words whose stems tell something when they stand before a candidate (fixed values).
_FOR = re.compile(r"(?:tel|phone|call|mobile|cell|fax|whatsapp|sms|dial|telef|anruf|appel)[a-zéó]*\W*$|(?:mail|contact|write|reach|kontakt|contacto)[a-z]*\W*$|(?:card|visa|mastercard|amex|credit|tarjeta|karte|carte)[a-z]*\W*$|(?:host|server|addr|ipv6|ip)[a-z]*\W*$", re.I)
_AGAINST = re.compile(r"(?:order|invoice|ref|id|no|nr|num|number|serial|version|ver|isbn|issn|page|item|sku|article|total|sum|price|key|token|hash|date|year|account|tracking|€|\$|£|#|=)\W*$", re.I)


def _around(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in ".,;:!?)\"'" else 5


_MORE_BEFORE, _MORE_AFTER = re.compile(r"[0-9][ ().\-/+]*$"), re.compile(r"[ ().\-/]?[0-9]")


def _before(text: str, start: int) -> tuple[int, ...]:
    lead = text[max(0, start - 24) : start]
    return _around(lead[-1:]), int(_FOR.search(lead) is not None), int(_AGAINST.search(lead) is not None), int(_MORE_BEFORE.search(lead) is not None)


def _after(text: str, end: int) -> tuple[int, ...]:
    return _around(text[end : end + 1]), int(_MORE_AFTER.match(text[end : end + 2]) is not None)


def features(text: str, spans: list[Span], base: Covered) -> np.ndarray:
    """A row of whole numbers for each span: its kind, format and context. What stands before or behind is looked at once
    for all candidates that begin or end there."""
    ahead, behind = {s: _before(text, s) for s, _, _ in spans}, {e: _after(text, e) for _, _, e in spans}
    rows = []
    for start, kind, end in spans:
        body = text[start:end]
        parts = _GROUP.findall(body)
        groups, digits = [len(g) for g in parts], "".join(parts)
        separators = {c for c in body if not c.isalnum()}
        dated = 0
        if len(parts) == 3:
            numbers = [int(g[-4:]) if len(g.lstrip("0")) <= 4 else 0 for g in parts]
            dated = int(any(1900 <= n <= 2100 for n in (numbers[0], numbers[2])) and numbers[1] <= 31)
        rows.append((
            kind, min(len(digits), 20), min(len(body), 60), len(groups), groups[0] if groups else 0, groups[-1] if groups else 0,
            max(groups, default=0), min(groups, default=0), body[:1] == "+", "(" in separators, "-" in separators, " " in separators, "." in separators, "/" in separators,
            len(separators), bool(digits) and luhn(digits), (digits[:1] == "0") + (digits[:2] == "00"), *ahead[start], *behind[end],
            dated, base.overlaps(start, end), digits[:1] in "3456" and bool(digits), body.count("(") != body.count(")"),
            "at" in (low := body.lower()), "dot" in low, len(set(digits)) <= 2, body.count(":"),
        ))
    return np.array(rows, np.int64)


@dataclass
class Model:
    trees: boosting.Trees
    threshold: dict[int, float]

    def added(self, text: str, base: list[Span]) -> list[Span]:
        covered = Covered(base)
        free = candidates(text, covered)
        if not free:
            return []
        scores = self.trees.probability(features(text, free, covered))
        chosen: list[Span] = []
        for p, s in sorted(zip(scores.tolist(), free, strict=True), key=lambda x: (-x[0], x[1][0] - x[1][2], x[1])):
            if p < self.threshold[s[1]]:
                continue
            if not covered.overlaps(s[0], s[2]):
                covered.add(s[0], s[2])
                chosen.append(s)
        return sorted(chosen)


def _line(r: random.Random) -> tuple[str, list[Span]]:
    """An invented line with planted spans of personal data and look-alikes."""
    pieces = "ba co de fi gu la me no pi ra so tu th er on ed ing ei ou qu".split()
    word = lambda: "".join(r.choice(pieces) for _ in range(r.randint(1, 4)))
    number = lambda n: "".join(str(r.randint(0, 9)) for _ in range(n))

    def card() -> str:
        body = r.choice("3456") + number(r.choice([12, 13, 14, 14, 14, 15, 17]))
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    def spaced(digits: str, by: str) -> str:
        return by.join(digits[k : k + 4] for k in range(0, len(digits), 4))

    def phone() -> str:
        return r.choice([
            lambda: f"({number(3)}) {number(3)}-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"{number(3)}.{number(3)}.{number(4)}",
            lambda: f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", lambda: f"00{r.randint(30, 99)} {number(3)} {number(3)} {number(3)}",
            lambda: f"+{r.randint(1, 99)} ({number(3)}) {number(3)}-{number(4)}", lambda: f"+{r.randint(1, 99)} {number(3)} {number(3)} {number(4)}", lambda: f"0{number(3)}/{number(7)}",
            lambda: " ".join([f"0{number(1)}", *(number(1) for _ in range(8))]), lambda: "-".join(number(1) for _ in range(10)),
        ])()

    def mail() -> str:
        at, dot = r.choice([(" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), ("[AT]", "[DOT]"), (" [at] ", ".")])
        return f"{word()}{r.choice(['', '.' + word(), number(2)])}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"

    def v6() -> str:
        part = lambda: format(r.randint(1, 65535), "x")
        return r.choice([lambda: ":".join(part() for _ in range(8)), lambda: f"{part()}:{part()}::{part()}", lambda: f"fe80::{part()}:{part()}"])()

    def nothing() -> str:
        return r.choice([
            lambda: f"{number(2)}/{number(2)}/{r.randint(1950, 2030)}", lambda: f"{r.randint(1950, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"{number(2)}:{number(2)}:{number(2)}",
            lambda: f"{number(1)}.{number(2)}.{number(3)}", lambda: number(r.randint(5, 20)), lambda: f"{number(3)} {number(3)} {number(3)}", lambda: f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
            lambda: f"{number(3)}.{number(3)}.{number(3)},{number(2)}", lambda: f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", lambda: " ".join(number(r.randint(1, 4)) for _ in range(r.randint(2, 8))),
            lambda: f"{word()} at {word()} dot {word()}"[: r.randint(8, 40)], lambda: f"{word()} dot {word()}", lambda: f"{number(2)}-{number(2)} {number(2)}-{number(2)}", lambda: f"{number(1)}. {number(2)}. {number(4)}",
            lambda: f"{number(r.randint(2, 5))}-{number(r.randint(3, 8))}", lambda: f"({number(1)}) {word()} ({number(4)})", lambda: "".join(r.choice("0123456789abcdef") for _ in range(18)),
        ])()

    text, planted = word(), []
    for _ in range(r.randint(1, 5)):
        text += "".join(" " + word() + r.choice(["", "", "", ",", "."]) for _ in range(r.randint(0, 4)))
        pick = r.random()
        if pick < 0.45:
            kind, make, lead = r.choice([(3, phone, ["tel", "phone", "call", "mobile:", "fax"]), (3, phone, ["tel.", "call me:", "phone"]), (2, card, ["card", "visa", "credit card:"]), (0, mail, ["mail", "contact", "write to"]), (1, v6, ["host", "server", "from"])])
            body = make()
            if kind == 2:
                body = r.choice([body, spaced(body, " "), spaced(body, "-"), spaced(body, "."), ".".join(body)])
            if r.random() < 0.35 or (kind == 3 and body[0] not in "+(0"):
                text += " " + r.choice(lead)
            text += " "
            planted.append((len(text), kind, len(text) + len(body)))
            text += body
            if r.random() < 0.2:
                text += " " + number(r.randint(1, 6))
        else:
            text += r.choice([" ", " ", " no. ", " ref ", " order #", " id=", " $", " version "]) + nothing()
    return text + r.choice(["", ".", " " + word()]), planted


def training_rows(lines: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of candidates of invented lines; kinds."""
    r = random.Random(seed)
    x, y = [], []
    for _ in range(lines):
        text, planted = _line(r)
        base = Covered(base_spans(text))
        if found := candidates(text):
            x.append(features(text, found, base))
            y += [int(span in planted) for span in found]
    x = np.concatenate(x)
    return x, np.array(y), x[:, 0]


@functools.lru_cache(maxsize=2)
def default_model(lines: int = 4000, precision: float = 0.995) -> Model:
    x, y, _ = training_rows(lines, 5)
    trees = boosting.fit(x, y)
    hx, hy, hk = training_rows(lines // 2, 6)
    boosting.calibrate(trees, hx, hy)
    p = trees.probability(hx)
    threshold = {}
    for kind in range(len(KINDS)):
        of = hk == kind
        order = np.argsort(-p[of], kind="stable")
        right = np.cumsum(hy[of][order]) / np.arange(1, of.sum() + 1)
        good = np.flatnonzero(right >= precision)
        threshold[kind] = max(0.5, float(p[of][order][good[-1]])) if len(good) else 1.01
    return Model(trees, threshold)


def named(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """Each span's kind in place of it; what overlaps is one stretch with the first one's kind."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, base, spans, redacted``: spans as ``kind:start:end`` by start and kind, comma-joined; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    model = model or default_model()
    out = pa.schema([("doc_id", pa.int64()), ("base", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in batches:
            rows = []
            for doc_id, text in texts(batch):
                base = base_spans(text)
                spans = base + model.added(text, base)
                rows.append((doc_id, named(base), named(spans), redacted(text, spans)))
            yield rows_of(out, {f.name: [r[k] for r in rows] for k, f in enumerate(out)})

    return id_and_text(docs).mapInArrow(run, "doc_id long, base string, spans string, redacted string")


def digests(found: DataFrame) -> DataFrame:
    kinds = [F.expr(f"if(base = '', 0L, cast(size(filter(split(base, ','), s -> startswith(s, '{k}:'))) as bigint))").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *kinds, F.sha2("base", 256).alias("base_sha256"), "spans")


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows with all their columns; found spans in ``text`` are replaced by their kind and
    ``n_chars``, if there is one, counts the new text. Null texts stay null."""
    small_batches(docs.sparkSession)
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing_held()
        for batch in batches:
            new = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                spans = base + model.added(text or "", base)
                new.append(redacted(text, spans) if spans else text)
            arrays = [pa.array(new, f.type) if f.name == "text" else pa.array([None if t is None else len(t) for t in new], f.type) if f.name == "n_chars" else batch.column(k) for k, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)

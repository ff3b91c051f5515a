"""Stems of Spanish words by the published Snowball rules, as Column expressions.

A word has three regions: R1 behind the first consonant that follows a vowel, R2 the same inside R1, and RV, which
depends on the first two letters. Attached pronouns go first, then the longest standard suffix, else a verb's ending,
then what is left of a residual vowel; a suffix goes only if it lies in the region that its rule names.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import let

# The published rules' letters and endings (fixed values).
VOWELS = "aeiouáéíóúü"
ACUTE, BARE = "áéíóú", "aeiou"
PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
BEFORE_PRONOUN = "iéndo ándo ár ér ír ando iendo ar er ir yendo".split()
PLAIN_SUFFIXES = "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split()
AGENTS = "adora ador ación adoras adores aciones ante antes ancia ancias".split()
LOGY, UTION, ENCE = ["logía", "logías"], ["ución", "uciones"], ["encia", "encias"]
ITY, IVE = ["idad", "idades"], "iva ivo ivas ivos".split()
Y_ENDINGS = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
GU_ENDINGS = "en es éis emos".split()
VERB_ENDINGS = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran "
    "asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais "
    "aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()
RESIDUAL, RESIDUAL_E = "os a o á í ó".split(), "e é".split()

#: Where R1, R2 and RV begin: behind a match, at the word's end if there is none.
R1 = f"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]"
R2 = f"{R1}[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]"
RV = f"^(?:.[^{VOWELS}]+[{VOWELS}]|[{VOWELS}]{{2,}}[^{VOWELS}]|[^{VOWELS}][{VOWELS}].)"
#: Standard suffixes: (endings, region, what stands in for them, what else goes from R2 before them).
STANDARD = [
    (PLAIN_SUFFIXES, "r2", "", []), (AGENTS, "r2", "", ["ic"]), (LOGY, "r2", "log", []), (UTION, "r2", "u", []), (ENCE, "r2", "ente", []),
    (["amente"], "r1", "", ["iv", "os", "ic", "ad"]), (["mente"], "r2", "", ["ante", "able", "ible"]), (ITY, "r2", "", ["abil", "ic", "iv"]), (IVE, "r2", "", ["at"]),
]
ALL_STANDARD = [s for endings, *_ in STANDARD for s in endings]


def pattern(endings: list[str]) -> str:
    """The longest of the endings: the match that begins first."""
    return "(?:" + "|".join(endings) + ")$"


def _end(w: Column, endings: list[str]) -> Column:
    return F.regexp_extract(w, pattern(endings), 0)


def _chop(w: Column, n: Column | int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _place(w: Column, region: str) -> Column:
    return let(F.length(F.regexp_extract(w, region, 0)), lambda n: F.when(n > 0, n).otherwise(F.length(w)))


def _without(w: Column, endings: list[str], least: Column) -> Column:
    """The word without the longest of the endings, if it has one and that lies at or behind ``least``."""
    return let(_end(w, endings), lambda e: F.when((e != "") & (F.length(w) - F.length(e) >= least), _chop(w, F.length(e))).otherwise(w))


def _pronoun(w: Column, m: Column) -> Column:
    def cut(p: Column) -> Column:
        b = _chop(w, F.length(p))
        return let(_end(b, BEFORE_PRONOUN), lambda e: F.when((p != "") & (e != "") & (F.length(b) - F.length(e) >= m.rv) & ((e != "yendo") | b.endswith("uyendo")), F.concat(_chop(b, F.length(e)), F.translate(e, ACUTE, BARE))).otherwise(w))

    return let(_end(w, PRONOUNS), cut)


def _standard(w: Column, m: Column) -> Column:
    def cut(s: Column) -> Column:
        b, out = _chop(w, F.length(s)), w
        for endings, region, instead, before in STANDARD:
            short = F.concat(b, F.lit(instead)) if instead else _without(b, before, m.r2) if before else b
            if endings == ["amente"]:  # of "ativ" both parts go
                short = let(short, lambda x: F.when(b.endswith("iv") & (x != b), _without(x, ["at"], m.r2)).otherwise(x))
            out = F.when(s.isin(*endings) & (F.length(b) >= m[region]), short).otherwise(out)
        return F.when(s == "", w).otherwise(out)

    return let(_end(w, ALL_STANDARD), cut)


def _verb(w: Column, m: Column) -> Column:
    rv = F.substring(w, m.rv + 1, F.length(w))

    def other(s: Column) -> Column:
        b = _chop(w, F.length(s))
        return F.when(s == "", w).when(s.isin(*GU_ENDINGS) & b.endswith("gu"), _chop(b, 1)).otherwise(b)

    def y_first(s: Column) -> Column:
        b = _chop(w, F.length(s))
        return F.when((s != "") & b.endswith("u"), b).otherwise(let(_end(rv, GU_ENDINGS + VERB_ENDINGS), other))

    return let(_end(rv, Y_ENDINGS), y_first)


def _residual(w: Column, m: Column) -> Column:
    def cut(s: Column) -> Column:
        b = _chop(w, F.length(s))
        return F.when(s == "", w).when(s.isin(*RESIDUAL_E) & b.endswith("gu") & (F.length(b) - 1 >= m.rv), _chop(b, 1)).otherwise(b)

    return let(_end(F.substring(w, m.rv + 1, F.length(w)), RESIDUAL + RESIDUAL_E), cut)


def stem(word: Column) -> Column:
    """The stem of a lower-case word; null stays null."""
    def steps(w: Column) -> Column:
        marks = F.struct(_place(w, R1).alias("r1"), _place(w, R2).alias("r2"), _place(w, RV).alias("rv"))
        ended = lambda m: lambda x: let(_standard(x, m), lambda y: F.when(y != x, y).otherwise(_verb(x, m)))
        return let(marks, lambda m: let(let(_pronoun(w, m), ended(m)), lambda x: F.translate(_residual(x, m), ACUTE, BARE)))

    return let(word, steps)


def beginning(stem_: str) -> str:
    """What every word of a stem begins with, acute accents aside: of all that stands in for an ending only "ente" has
    letters that the ending (of "encia") lacks, and its last letter may go."""
    for end in ("ente", "ent"):
        if stem_.endswith(end):
            return stem_[: len(stem_) - len(end) + 2]
    return stem_

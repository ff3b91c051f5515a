"""Spanish stems: the published sample words, and the same stems in both engines."""

import re

import duckdb
import pytest

from tidewell.functions import spanish
from tidewell.operators import search as S
from tidewell.plans.stems import stems_sql

#: Words and stems from the published sample vocabulary, and words for its single rules.
SAMPLE = """
cheque chequ cheques chequ cheraw cheraw chesca chesc chester chest chetumal chetumal chetumaleños chetumaleñ chevrolet chevrolet cheyene cheyen cheyenne cheyenn chi chi chía chi
chiapaneca chiapanec chiapas chiap chiba chib chic chic chica chic chicago chicag chicana chican chicano chican chicas chic chicharrones chicharron chichen chich chichimecas chichimec chicles chicl chico chic
torá tor tórax torax torcer torc toreado tor toreados tor toreándolo tor torear tor toreara tor torearlo tor toreó tore torero torer toreros torer torio tori tormenta torment tormentas torment
tornado torn tornados torn tornar torn tornen torn torneo torne torneos torne tornillo tornill tornillos tornill torniquete torniquet torno torn toro tor toronto toront toros tor torpedearon torped
torpeza torpez torrado torr torralba torralb torre torr torrencial torrencial torrente torrent
haciéndola hac existencia existent frecuencia frecuenci biología biolog contribución contribu solución solucion rápidamente rapid lentamente lent relativamente relat posibilidad posibil actividades activ huyendo huyend construyendo constru pague pag alerta alert alertas alert
registros registr sanitarios sanitari productos product medicamentos medicament
""".split()
PAIRS = dict(zip(SAMPLE[::2], SAMPLE[1::2]))

def test_published_words(spark):
    df = spark.createDataFrame([(w,) for w in PAIRS], "w string").select("w", spanish.stem(spanish.F.col("w")).alias("s"))
    assert dict(map(tuple, df.collect())) == PAIRS


@pytest.fixture(scope="module")
def words():
    rows = duckdb.sql("SELECT lower(text) FROM '/root/testdata/sf0.001/documents.parquet' WHERE text IS NOT NULL").fetchall()
    found = {w for (t,) in rows for w in re.split(S.BETWEEN, t) if w}
    endings = [*spanish.PRONOUNS, *spanish.BEFORE_PRONOUN, *spanish.ALL_STANDARD, *spanish.Y_ENDINGS, *spanish.GU_ENDINGS, *spanish.VERB_ENDINGS, *spanish.RESIDUAL, *spanish.RESIDUAL_E]
    made = {a + b + c for a in ("", "c", "mat", "ague", "traduc", "negat", "constru", "pág") for b in ("", "ic", "iv", "ativ", "gu", "u", "abil") for c in endings}
    return sorted(found | made)


def test_same_stems_in_sql(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", spanish.stem(spanish.F.col("w")).alias("s"))
    con = duckdb.connect()
    con.sql("CREATE TABLE words(w VARCHAR)")
    con.executemany("INSERT INTO words VALUES (?)", [(w,) for w in words])
    assert dict(map(tuple, df.collect())) == dict(con.sql(f"WITH {stems_sql('SELECT w FROM words')} SELECT w, stem FROM stems").fetchall())


def test_words_begin_as_their_stems_tell(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", spanish.stem(spanish.F.col("w")).alias("s"))
    plain = str.maketrans(spanish.ACUTE, spanish.BARE)
    assert all(r.w.translate(plain).startswith(spanish.beginning(r.s)) for r in df.collect() if r.s)

"""Operators on tables: brute-force versions, odd rows, and the queries of this subpackage."""

import hashlib
import os
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidewell.llm import bpe, chat, extraction, media, mil, packing, pii, queries, simhash, token_file, winnow

SF = "/root/testdata/sf0.001"
JSON = P.path("byte_bpe_50k.json")
ODD = [(1, "a b c", "x", 1), (1, "a b c", "x", 1), (2, None, None, None), (3, "", "x", 2), (None, "uno dos tres cuatro", "x", 3), (4, "palabra larga " * 20000, "y", 4), (5, "a b c", "y", 5)]
SHAPE = "doc_id long, text string, hashes string, label int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SHAPE)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY 1").fetchall()


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def u4(ids):
    return np.array(ids, "<u4").tobytes()


def test_scratch_is_dropped_on_request(spark):
    from tidewell.llm import common

    df = common.stored(spark.range(3), "x")
    assert df.count() == 3
    folder = common._MADE[-1].removeprefix("file:").replace("//", "/")
    assert os.path.isdir(folder)
    common.drop_scratch(spark)
    assert not os.path.exists(folder) and common._MADE == []


def test_op1_reads_back_what_the_library_encodes(spark, docs):
    t, at, expected = library(), 0, set()
    for i, text in docs:
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        expected.add((i, at, len(ids), zlib.crc32(u4(ids))))
        at += len(ids)
    got = queries.op1_token_file(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert set(map(tuple, got)) == expected and len(got) == len(docs)


def test_op1_odd_rows(spark, odd, none, tmp_path):
    token_file.write_token_files(odd, f"{tmp_path}/t", JSON, 0)
    rows = token_file.read_token_files(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5] and rows[3].ids == u4([0])
    assert [r.start for r in rows] == np.cumsum([0] + [len(r.ids) // 4 for r in rows])[:-1].tolist()
    assert token_file.token_output(none, JSON).collect() == []


def test_op2_is_tiktoken_and_round_trips(spark, docs):
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = {(i, len(ids := own.encode_ordinary(t)), sha(u4(ids)), sha(t.encode())) for i, t in docs}
    assert set(map(tuple, queries.op2_prefix_bpe(spark, SF).collect())) == expected


def test_op2_odd_rows(odd, none):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = bpe.encode_and_decode(odd, path, P.PATTERN).collect()
    assert len(rows) == len(ODD) and sorted(r.decoded for r in rows) == sorted((t or "").encode() for _, t, _, _ in ODD)
    assert bpe.encode_and_decode(none, path, P.PATTERN).collect() == []


def test_op3_same_as_sql(spark):
    same(queries.op3_chat_format(spark, SF), queries.OP3_SQL, connect(SF))


def test_reply_trees(spark):
    tree = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 2.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 2, "user", "more <|im_end|> <~| \\", 0.0), ("t", 5, 4, "assistant", "end", 0.5), ("t", 5, 4, "assistant", "end", 0.5), ("u", 1, 9, "user", None, None), ("c", 1, 2, "user", "x", 0.0), ("c", 2, 1, "user", "y", 0.0)]
    nodes = spark.createDataFrame(tree, "tree string, node long, parent long, role string, text string, score double")
    rows = {(r.tree, r.path): r for r in chat.read_formatted(chat.format_paths(nodes)).collect()}
    assert [t.text for t in rows["t", 1].turns] == ["q", "good", "more <|im_end|> <~| \\", "end"] and rows["t", 1].loss_text == "goodend" and rows["t", 1].score == 2.5
    assert [t.text for t in rows["t", 2].turns] == ["q", "bad"] and rows["u", 1].turns[0].text == "" and set(rows) == {("t", 1), ("t", 2), ("u", 1)}
    assert chat.format_paths(nodes, best=1).filter("tree = 't'").count() == 1
    assert chat.format_paths(nodes.limit(0)).collect() == []


TREE = "tree string, node long, parent long, role string, text string, score double"


def _paths(rows, best=None):
    """Root-to-leaf paths by definition: texts and score, ranked."""
    one = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, *((x is not None, x or "") for x in r[3:5]), r[5] is not None, r[5] or 0)):
        one.setdefault((r[0], r[1]), r)
    above = {k: (k[0], r[2]) if r[2] is not None and (k[0], r[2]) in one else None for k, r in one.items()}
    parents, found = set(above.values()), defaultdict(list)
    for leaf in one:
        way, at = [], leaf
        while at is not None and at not in way:
            way.insert(0, at)
            at = above[at]
        if at is None and leaf not in parents:
            found[leaf[0]].append((-sum(one[k][5] or 0 for k in way), leaf[1] is not None, leaf[1] or 0, [one[k][4] or "" for k in way]))
    return {(t, k + 1): (texts, -score) for t, paths in found.items() for k, (score, _, _, texts) in enumerate(sorted(paths)[:best])}


@pytest.mark.parametrize("best", [None, 2])
def test_reply_trees_are_brute_force(spark, best):
    """Null trees and ids, repeated nodes of unlike scores, parents that are not there, cycles, ties, hostile texts."""
    import random

    r = random.Random(3)
    rows = [(t, r.choice([None, *range(1, 30)]), r.choice([None, 99, *range(1, 30)]), r.choice(["user", "assistant", None]), r.choice(["a", "b <|im_end|>", None, "c\n<~|"]), r.choice([0.0, 1.0, 2.5, None])) for t in ("t", None, "u") for _ in range(40)]
    rows = [(t, n, None if p is not None and n is not None and p > n and r.random() < 0.9 else p, *more) for t, n, p, *more in rows]
    got = chat.read_formatted(chat.format_paths(spark.createDataFrame(rows, TREE).withColumn("path", F.lit("x")).withColumn("level", F.lit(1)), best)).collect()
    assert {(x.tree, x.path): ([t.text for t in x.turns], x.score) for x in got} == _paths(rows, best) and len(got) == len(_paths(rows, best))


def test_reply_cycles_end(spark):
    rows = [("t", k, k % 50 + 1, "user", str(k), 1.0) for k in range(1, 51)] + [("t", 60, None, "user", "alone", 1.0)]
    assert [[t.text for t in x.turns] for x in chat.read_formatted(chat.format_paths(spark.createDataFrame(rows, TREE))).collect()] == [["alone"]]


def test_op3_keeps_null_conversations(spark, tmp_path):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (7, 0, "user", None), (7, 0, "user", None), (7, None, None, "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(5)).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in queries.op3_chat_format(spark, str(tmp_path)).collect()}
    assert got == {None: (2, 1), 7: (3, 0), -1: (2, 34)}
    same(queries.op3_chat_format(spark, str(tmp_path)), queries.OP3_SQL, con)


def test_long_chain(spark):
    nodes = spark.range(1, 700).select(F.lit(1).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    row = chat.read_formatted(chat.format_paths(nodes)).first()
    assert [int(t.text) for t in row.turns] == list(range(1, 700)) and row.score == 699


def test_op4_edits_by_the_next_document(spark, docs):
    got = {r.doc_id: r for r in queries.op4_winnow(spark, SF).collect()}
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        own, changed, nxt = winnow.winnow(text), winnow.winnow(edited), winnow.winnow(after)
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (winnow.digest(*own), winnow.digest(*changed))
        assert r.near_edited == winnow.likeness(own[0], changed[0]) and r.near_next == winnow.likeness(own[0], nxt[0])
    assert len(got) == len(docs)


def test_op4_odd_rows(spark, odd, none):
    rows = winnow.edited_by_next(odd).collect()
    assert len(rows) == len(ODD) and winnow.edited_by_next(none).collect() == []
    assert winnow.edited_by_next(odd.filter("doc_id = 5")).first().near_next == 1.0
    assert len(winnow.fingerprints(odd).collect()) == len(ODD)


def test_op5_base_and_added(spark, docs):
    model = pii.default_model()
    got = {r.doc_id: r for r in queries.op5_boosted_pii(spark, SF).collect()}
    for i, text in docs:
        base = pii.base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(pii.named(base).encode()).hexdigest()
        assert got[i].n_phone == sum(k == 3 for _, k, _ in base) and got[i].spans == pii.named(base + model.added(text, base))


def test_op5_odd_rows(odd, none):
    assert len(pii.find(odd).collect()) == len(ODD) and pii.find(none).collect() == []
    assert sorted(pii.redact(odd).columns) == sorted(odd.columns) and pii.redact(odd).filter("text IS NULL").count() == 1


def test_op6_stores_without_loss(spark, docs):
    got = {r.doc_id: r for r in queries.op6_media(spark, SF).collect()}
    for i, text in docs:
        data = text.encode()
        padded = data + b"\xff" * (-len(data) % 576 if data else 576)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        image = np.frombuffer(padded, np.uint8).reshape(-1, 192, 3)
        rows, size = len(image), image.size
        if rows % 2 == 0:  # a PPM; else a BMP, whose rows go upward and whose channels are blue, green, red
            form = b"P6\n192 %d\n255\n" % rows + padded
        else:
            numbers = [(54 + size, 4), (0, 4), (54, 4), (40, 4), (192, 4), (rows, 4), (1, 2), (24, 2), (0, 4), (size, 4), (2835, 4), (2835, 4), (0, 4), (0, 4)]
            form = b"BM" + b"".join(n.to_bytes(k, "little") for n, k in numbers) + image[::-1, :, ::-1].tobytes()
        assert (r.media_bytes, r.media_sha256) == (len(form), hashlib.sha256(form).hexdigest())
        _, tile, bits = media.features(form)
        assert r.feature == f"{bits}:{zlib.crc32(tile):08x}"


def test_op6_tiles_are_stored(spark, docs):
    import io

    table = spark.read.parquet(f"{SF}/documents.parquet")
    tiles = media.stored_text_tiles(table)
    assert tiles.inputFiles() and tiles.count() == len(docs)
    for r in tiles.limit(20).collect():
        assert np.load(io.BytesIO(r.tile)).shape == media.TILE and len(r.dhash) == 16


def test_op6_odd_rows(spark, odd, none):
    rows = media.stored_text_digests(odd).collect()
    assert len(rows) == len(ODD) and len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == 5}) == 1
    assert media.stored_text_digests(none).collect() == []
    mixed = spark.createDataFrame([(1, bytearray(b"GIF")), (2, None), (3, bytearray(media.encode_ppm(np.zeros((2, 2, 3), np.uint8)))), (4, bytearray(b"P5 0 5 255 ")), (None, bytearray(b"P6 999999999999999999999999 1 255 "))], "id long, media binary")
    rows = {r.id: r for r in media.media_features(mixed).collect()}
    assert {i: r.error is None for i, r in rows.items()} == {1: False, 2: False, 3: True, 4: False, None: False}
    assert all((r.tile is None) == (r.dhash is None) == (r.error is not None) for r in rows.values())


def test_op7_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_mil_quality(spark, sf)
    truth = spark.read.parquet(f"{sf}/labels.parquet").join(got, "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got.limit(50).collect())
    assert np.mean([r.predicted == r.quality for r in truth]) > 0.97 and got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def _slow_passage(whole, at):
    """The numbers of the passage at a place by their definitions; a word counts whole where it begins."""
    text = whole[at : at + mil.PASSAGE]

    def kind(c):
        if c.isdigit() and ord(c) < 0x10000:
            return 2
        if c in "\n\r":
            return 4
        if ord(c) >= 0x10000:
            return 9
        if c.isspace():
            return 3
        if c in ".,;:'\"-?()":
            return 5
        if c.isascii() and not c.isalnum():
            return 6
        if c.isupper():
            return 1 if c.isascii() else 8
        return (0 if c.isascii() else 7) if c.isalpha() else 9

    out = [sum(kind(c) == k for c in text) / len(text) if text else 0.0 for k in range(mil.CLASSES)]
    blank = lambda k: k < 0 or k >= len(whole) or kind(whole[k]) in (3, 4)
    words = []
    for k in range(at, at + len(text)):
        if blank(k - 1) and not blank(k):
            end = k
            while not blank(end):
                end += 1
            words.append(whole[k:end])
    if not words:
        return [*out, *[0.0] * 9, 0.0 if text else 1.0]
    n, sizes = len(words), [len(x) for x in words]
    mean = sum(sizes) / n
    share = lambda it: sum(map(bool, it)) / n
    return [
        *out, (n - len(set(words))) / n, share(a == b for a, b in zip(words, words[1:], strict=False)), mean / 10, max(sum(x * x for x in sizes) / n - mean**2, 0) ** 0.5 / 10,
        share(kind(x[-1]) == 6 for x in words), share(kind(x[0]) in (1, 8) for x in words), share(len(x) == 1 and kind(x) == 6 for x in words), share(x > 20 for x in sizes), min(n / 100, 1), 0.0,
    ]


def _slow_score(model, text):
    """Gated attention by its formula, one passage after another."""
    from math import exp, tanh

    w = {k: np.asarray(v).tolist() for k, v in model.weights.items()}
    dot = lambda v, m, j: sum(x * row[j] for x, row in zip(v, m, strict=True))
    hs, raws = [], []
    for at in range(0, max(len(text), 1), mil.PASSAGE):
        x = [(f - m) / s for f, m, s in zip(_slow_passage(text, at), model.mean.tolist(), model.spread.tolist(), strict=True)]
        h = [tanh(dot(x, w["E"], j) + w["e"][j]) for j in range(mil.HIDDEN)]
        raws.append(sum(w["a"][j] * tanh(dot(h, w["V"], j)) / (1 + exp(-dot(h, w["U"], j))) for j in range(mil.ATTENTION)))
        hs.append(h)
    top = max(raws)
    weight = [exp(r - top) for r in raws]
    z = [sum(a * h[j] for a, h in zip(weight, hs, strict=True)) / sum(weight) for j in range(mil.HIDDEN)]
    return 1 / (1 + exp(-max(-30, min(30, sum(a * b for a, b in zip(z, w["o"], strict=True)) + w["b"]))))


def test_op7_is_brute_force(spark, docs):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = mil.train(table, labels)
    got = {r.doc_id: r for r in queries.op7_mil_quality(spark, SF).collect()}
    assert set(got) == {i for i, _ in docs}
    for i, text in docs:
        score = _slow_score(model, text or "")
        assert abs(got[i].score - score) < 1e-6 and got[i].predicted == (got[i].score >= 0.5) and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_op7_passages_are_their_definition(docs):
    for text in ["", " \n", "a A é É 9 ² \U0001f389!", "# # x" * 300, "w" * 900 + " v", *(t or "" for _, t in docs[:40])]:
        slow = [_slow_passage(text, at) for at in range(0, max(len(text), 1), mil.PASSAGE)]
        assert np.allclose(mil.passages(text), slow)


def test_op7_learns_from_every_passage(spark, monkeypatch):
    """Bags longer than any sample, gradients in pieces, ids that repeat."""
    seen = {}
    fit = mil.fit

    def note(bags, labels):
        seen["sizes"] = sorted(map(len, bags))
        return fit(bags, labels)

    monkeypatch.setattr(mil, "fit", note)
    monkeypatch.setattr(mil, "STEPS", 5)
    texts = [(1, "good words here " * 5000), (7, "# # #" * 100), (7, "# # #" * 90), (7, None)]
    texts = spark.createDataFrame([*texts, *[(1, "z" * 90_000)] * 50], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, quality int")
    whole = mil.train(texts, labels)
    assert seen["sizes"] == [1, 200]
    monkeypatch.setattr(mil, "CHUNK", 1)
    pieces = mil.train(texts, labels)
    assert all(np.allclose(whole.weights[k], pieces.weights[k]) for k in whole.weights)


def test_op7_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (3, 0), (99, 1), (4, None)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in mil.score(odd, mil.train(odd, labels)).collect())
    assert {r.score for r in mil.score(odd, mil.train(odd, labels.limit(0))).collect()} == {0.5}
    assert mil.score(none, None).collect() == [] and mil.accepted(odd, None).count() == len(ODD)


def _components(rows, distance=3):
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= distance:
                up[find(b)] = find(a)
    least = defaultdict(lambda: float("inf"))
    for i, f in rows:
        if i is not None:
            least[find(f)] = min(least[find(f)], i)
    return {i: least[find(f)] for i, f in rows}


def test_op8_is_brute_force(spark, docs):
    rows = [(i, simhash.fingerprint(t)) for i, t in docs]
    expected = _components(rows)
    got = queries.op8_simhash(spark, SF).collect()
    assert {r.doc_id: r.component_id for r in got} == expected and {r.doc_id: int(r.fingerprint, 16) for r in got} == dict(rows)


@pytest.mark.parametrize("cell", [simhash.CELL, 7])
def test_op8_chains_copies_and_hot_cells(spark, monkeypatch, cell):
    import random

    monkeypatch.setattr(simhash, "CELL", cell)
    r = random.Random(5)
    fps = []
    for _ in range(25):
        x = r.getrandbits(64)
        for _ in range(15):
            fps.append(x)
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
    rows = list(enumerate(fps)) + [(1000 + k, fps[k]) for k in range(20)]
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in rows]
    got = simhash.classes(spark.createDataFrame(signed, "doc_id long, fp long")).collect()
    assert {x.doc_id: x.component_id for x in got} == _components(rows)


def test_op8_odd_rows(odd, none):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == len(ODD) and {r.component_id for r in got if r.doc_id in (1, 5)} == {1} and {r.component_id for r in got if r.doc_id in (2, 3)} == {2}
    assert simhash.simhash_components(none).collect() == []
    assert sorted((r.doc_id or 0, r.text or "", r.hashes or "") for r in simhash.one_of_each(odd).collect()) == sorted([(0, "uno dos tres cuatro", "x"), (1, "a b c", "x"), (2, "", ""), (4, "palabra larga " * 20000, "y")])
    assert simhash.one_of_each(none).collect() == [] and simhash.one_of_each(odd).columns == odd.columns


def test_op8_rows_without_ids_link(spark):
    rows = [(None, 0b0), (5, 0b111), (None, 0b111111), (9, 0b111111111), (None, 0x7F << 40), (None, 0x7F << 40), (3, 0x7F << 50), (None, 0x3F << 40)]
    got = simhash.classes(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert sorted(((r.doc_id or 0, r.fp, r.component_id) for r in got), key=str) == sorted(((i or 0, f, 3 if f == 0x7F << 50 else None if f >> 40 else 5) for i, f in rows), key=str)


def test_components_of_hubs(spark):
    """A star, a chain and a clique against union-find, so many edges at one node that its rows are dealt by task."""
    edges = [(0, k) for k in range(1, 400)] + [(1000 + k, 1001 + k) for k in range(60)] + [(2000 + i, 2000 + j) for i in range(12) for j in range(i)] + [(7, 7), (5000, 399)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in [*range(1, 400), 5000]}, **{k: 1000 for k in range(1001, 1061)}, **{k: 2000 for k in range(2001, 2012)}}


def test_fair_join_is_a_join(spark):
    from tidewell.llm.common import fair_join

    many = [(k % 5 if k % 3 else 0, k) for k in range(300)]
    n = defaultdict(int)
    for u, _ in many:
        n[u] += 1
    one = [(u, c, None if u == 0 else f"x{u}") for u, c in n.items()]
    got = fair_join(spark.createDataFrame(many, "u long, v long"), spark.createDataFrame(one, "u long, n long, m string"), "u", "n", len(many))
    assert got.columns == ["u", "v", "m"] and sorted(map(tuple, got.collect()), key=str) == sorted([(u, v, None if u == 0 else f"x{u}") for u, v in many], key=str)


def _shingles(text, words=5):
    w = text.encode().lower().split()
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))}


def _check_classes(texts, classes):
    """Against all pairs: what is alike is together, and what is together is linked by brute force."""
    wide = {i: simhash.wide_fingerprint(t) for i, t in texts.items()}
    exact = {i: simhash.fingerprint(t) for i, t in texts.items()}
    sets = {i: _shingles(t) for i, t in texts.items()}
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (exact[a] ^ exact[b]).bit_count() <= 3 or np.bitwise_count(wide[a] ^ wide[b]).sum() <= simhash.WIDE:
                up[find(b)] = find(a)
            if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b]) or (exact[a] ^ exact[b]).bit_count() <= 3:
                assert classes[a] == classes[b]
    for i in ids:
        assert find(i) == find(classes[i]) and classes[i] <= i


def test_wide_classes_catch_edited_copies(spark):
    import random

    r = random.Random(7)
    vocabulary = ["".join(r.choice("aeioustrnlm") for _ in range(r.randint(3, 9))) for _ in range(2000)]
    texts, n = {}, 0
    for _ in range(40):
        words = [r.choice(vocabulary) for _ in range(r.randint(60, 500))]
        for _ in range(4):
            copy = list(words)
            for _ in range(len(words) // 100):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            texts[n] = " ".join(copy)
            n += 1
    got = {x.doc_id: x.component_id for x in simhash.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    _check_classes(texts, got)
    assert len(set(got.values())) == 40


def test_wide_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 3)
    texts = {i: "una frase comun que se repite en cada documento con " + " ".join(f"w{k}" for k in range(80)) + (f" x{i}" if i % 3 else "") for i in range(30)}
    got = simhash.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {x.component_id for x in got} == {0} and len(got) == 30


@pytest.mark.parametrize("small", [simhash.SMALL, 3])
def test_wide_pairs_of_a_hubs_family(spark, monkeypatch, small):
    """A hub and members of similarity 0.6 to it, each with a near copy, in one cell: the hub reaches all by their sketches."""
    import random

    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "CELLS", 1)
    monkeypatch.setattr(simhash, "wide_cells", lambda fp: [0])
    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioustrnlm") for _ in range(8))
    hub = [word() for _ in range(400)]
    texts = {0: " ".join(hub)}
    for k in range(200):
        at = r.randrange(300)
        member = hub[:at] + [word() for _ in range(100)] + hub[at + 100 :]
        copy = list(member)
        copy[r.randrange(400)] = word()
        texts |= {1 + k: " ".join(member), 1001 + k: " ".join(copy)}
    sets = {i: _shingles(t) for i, t in texts.items()}
    assert all(0.55 < len(sets[0] & sets[i]) / len(sets[0] | sets[i]) < 0.65 for i in texts if 0 < i < 1000)
    got = {x.doc_id: x.component_id for x in simhash.near_duplicate_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    _check_classes(texts, got)


def test_op9_packs_every_id_once(spark, docs):
    t, by, bins = library(), defaultdict(list), defaultdict(list)
    for r in queries.op9_best_fit(spark, SF).collect():
        by[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    lengths = []
    for i, text in docs:
        ids = t.encode(text, add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(by[i], key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(u4(ids[at : at + r.length])) and (r.length == 1024 or r.piece == 0)
            at += r.length
            lengths.append(r.length)
        assert at == len(ids)
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) == len(_best_fit(lengths))


def _best_fit(lengths, capacity=1024):
    """Best-fit decreasing without a tree: all open bins are looked at for each piece."""
    left = []
    for n in sorted(lengths, reverse=True):
        fit = [k for k, room in enumerate(left) if room >= n]
        if fit:
            left[min(fit, key=lambda k: left[k])] -= n
        else:
            left.append(capacity - n)
    return left


@pytest.mark.parametrize("spread", [packing.SPREAD, 30])
def test_op9_ranks_in_groups(spark, monkeypatch, spread):
    import random

    monkeypatch.setattr(packing, "SPREAD", spread)
    r = random.Random(8)
    lengths = [r.choice([10, 10, 10, 7, 3, 20]) for _ in range(300)]
    found = spark.createDataFrame([(k // 2, k % 2, n, k) for k, n in enumerate(lengths)], "doc_id long, piece int, length long, ids_crc32 long").withColumn("start", F.lit(0))
    bins = defaultdict(list)
    for x in packing.packed(found, 20).collect():
        bins[x.sequence_id].append((x.offset, x.length))
    assert sum(map(len, bins.values())) == 300 and len(bins) == len(_best_fit(lengths, 20))
    assert all(sum(n for _, n in rows[:k]) == at for rows in map(sorted, bins.values()) for k, (at, _) in enumerate(rows))


def test_op9_odd_rows(odd, none):
    rows = packing.packed_documents(odd, JSON).collect()
    assert sum(r.piece == 0 for r in rows) == len(ODD) and packing.packed_documents(none, JSON).collect() == []


def test_op10_gives_the_article(spark):
    import html as h
    import re

    pages = {r[0]: r[1] for r in duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()}
    for r in queries.op10_dom_model(spark, SF).collect():
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        body = re.sub(r"</?b>", "", re.sub(r"</?(p|br|h1)>", " ", body))
        assert r.text == re.sub(r"\s+", " ", h.unescape(body)).strip() and r.n_chars == len(r.text)


def test_op10_odd_rows(spark):
    rows = spark.createDataFrame([(1, "u", None, 1), (2, None, "", 2), (2, None, "", 2), (None, "u", "<p>" * 3000, 3)], "page_id long, url string, html string, text int")
    assert [r.text for r in extraction.extract(rows).collect()] == ["", "", "", ""] and extraction.extract(rows.limit(0)).collect() == []


def test_batches_are_bounded_by_bytes(spark):
    from tidewell.llm import common

    common.small_batches(spark)

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    rows = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 4 << 20).alias("t")).mapInArrow(sizes, "n long").collect()
    assert max(r.n for r in rows) <= 5


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with names that operators use."""
    import corpus_pipeline

    clash = {"wide": F.lit("a"), "fp": F.lit(1), "class": F.lit("c"), "hot_": F.lit(0), "n": F.lit(2), "score": F.lit(0.5), "wide_": F.lit(b"x"), "id_": F.lit(3), "piece": F.lit(4)}
    rows = [(1, "a good text " * 30, "en", "s", 360), (1, "a good text " * 30, "en", "s", 360), (None, None, None, None, None), (2, "", "en", None, 0), (None, "call +1 555 123 4567", "en", "s", None), (3, "word " * 60000, None, "s", 300000), (4, None, "es", "s", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns(clash)
    for name, rows in (("some", table), ("none", table.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1), (9, 0), (None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, f"{tmp_path}/{name}")
            assert docs.columns == table.columns
            docs = corpus_pipeline.stored(docs, "test")
        if name == "some":
            kept = sorted((r.doc_id or 0, (r.text or "")[:20]) for r in docs.collect())
            assert kept == sorted([(0, "call <PHONE>"), (1, "a good text a good t"), (2, ""), (3, "word word word word ")])
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/some").collect()} == {None, 1, 2, 3}


def test_pipeline_is_its_stages(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "PII", "best-fit packing"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, table, SF)
    assert kept.columns == table.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    one = corpus_pipeline.near_duplicates(spark, kept, SF)
    assert one.columns == table.columns
    survivors = {r.doc_id for r in one.collect()}
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicate_classes(kept).collect()}
    assert survivors == set(classes.values()) and set(classes) == set(rows)
    _check_classes(rows, classes)
    clean = corpus_pipeline.personal_data(spark, one, SF)
    model = pii.default_model()
    for r in clean.collect():
        base = pii.base_spans(rows[r.doc_id])
        assert r.text == pii.redacted(rows[r.doc_id], base + model.added(rows[r.doc_id], base)) and r.n_chars == len(r.text)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == survivors


def test_op7_labels_of_strange_ids_take_no_place_of_the_sample(spark):
    texts = spark.createDataFrame([(i, ("good words here " if i % 2 else "# # @@ 1") * 20) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(10**6 + i, i % 2) for i in range(4000)], "doc_id long, quality int")
    model = mil.train(texts, labels, sample=5)
    assert {r.doc_id % 2: r.score >= 0.5 for r in mil.score(texts, model).collect()} == {0: False, 1: True}


def test_op8_links_are_the_same_in_cells_of_any_fineness(spark):
    import random

    r = random.Random(21)
    base = [r.getrandbits(64) for _ in range(60)]
    fps = {b for b in base} | {b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 5))) for b in base for _ in range(4)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    expected = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3}
    node = {x: x for x in fps}

    def root(x):
        while node[x] != x:
            x = node[x]
        return x

    for a, b in expected:
        node[root(a)] = root(b)
    for groups in simhash.GROUPS:
        near = {(row.a % (1 << 64), row.b % (1 << 64)) for row in simhash.links(simhash.cells(df, 3, groups), 3).collect()}
        assert near and all((a ^ b).bit_count() <= 3 for a, b in near)
        own = {x: x for x in fps}

        def find(x):
            while own[x] != x:
                x = own[x]
            return x

        for a, b in near:
            own[find(a)] = find(b)
        assert {frozenset(y for y in fps if find(y) == find(x)) for x in fps} == {frozenset(y for y in fps if root(y) == root(x)) for x in fps}
    assert simhash.groups_for(10**5, 3) == 6 and simhash.groups_for(10**10, 3) > simhash.groups_for(10**8, 3) > 6

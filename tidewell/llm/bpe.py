"""Byte-level BPE by prefix dynamic programming.

For a word's every byte prefix the last token of the prefix's encoding is unique:
a token ``t`` that ends at byte ``i`` is the last one exactly if the prefix before
it ends with a token ``p`` such that the bytes of ``p`` and ``t`` together encode
to ``[p, t]``.  ``Prefixes`` stores that token for each prefix.  Following the
stored tokens back from the end gives the encoding of any prefix; appending bytes
only adds entries; after an edit at byte ``i`` the entries before ``i`` stay, so
only the part from the edit on is encoded again, and it stops as soon as the
stored tokens agree with the old ones for as many bytes as the longest token has.

Words are the matches of the tokenizer's pattern, each encoded by itself.
Encodings of units (see units.py) are kept in a store of bounded size.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import held, id_and_text, rows_of, small_batches
from tidewell.llm.units import UNITS, WHITE, Encoder

#: Token pairs kept in a worker.
STORE = 400_000
#: Rank of a pair that never merges.
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pairs: dict[tuple[int, int], bool] = {}
        self.wholes: dict[int, bool] = {}
        #: How long tokens of at least three bytes are at most, by their last three.
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > self.reach.get(token[-3:], 2):
                self.reach[token[-3:]] = len(token)

    def merge(self, data: bytes) -> list[int]:
        """The definition: merge the pair of lowest rank, leftmost first, until no pair has a rank."""
        rank = self.ranks.get
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [rank(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) != NEVER:
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = rank(parts[at] + parts[at + 1], NEVER)
            if at > 0:
                pairs[at - 1] = rank(parts[at - 1] + parts[at], NEVER)
        return [self.ranks[p] for p in parts]

    def fits(self, first: int, second: int) -> bool:
        """Whether the bytes of two tokens together encode to just these two."""
        key = (first, second)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= STORE:
                self.pairs.clear()
            found = self.pairs[key] = self.merge(self.bytes[first] + self.bytes[second]) == [first, second]
        return found


    def whole(self, token: int) -> bool:
        """Whether the bytes of a token encode to just it."""
        found = self.wholes.get(token)
        if found is None:
            found = self.wholes[token] = self.merge(self.bytes[token]) == [token]
        return found


class Prefixes:
    """The last token of each byte prefix of one word."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _last_of(self, data: bytes, end: int) -> int:
        v, last = self.v, self.last
        token_of, pair_of = v.ranks.get, v.pairs.get
        reach = v.reach.get(data[end - 3 : end], 2) if end >= 3 else end
        for start in range(max(0, end - reach), end):  # the longest candidate first
            token = token_of(data[start:end])
            if token is not None:
                if start == 0:
                    fits = v.whole(token)
                elif (fits := pair_of((last[start - 1], token))) is None:
                    fits = v.fits(last[start - 1], token)
                if fits:
                    return token
        raise ValueError("the vocabulary lacks a single byte")

    def append(self, more: bytes) -> None:
        """Exact: no earlier entry changes."""
        self.data += more
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self._last_of(self.data, end))

    def turn(self, data: bytes) -> None:
        """Become the prefixes of another word: entries of a common beginning stay, as they depend on it alone."""
        old, same = self.data, 0
        for a, b in zip(old, data):
            if a != b:
                break
            same += 1
        self.data = data[:same]
        del self.last[same:]
        self.append(data[same:])

    def edit(self, at: int, removed: int, inserted: bytes) -> int:
        """Replace ``removed`` bytes at ``at`` by ``inserted``; returns how many entries were computed."""
        data = self.data[:at] + inserted + self.data[at + removed :]
        old, shift = self.last, len(inserted) - removed
        self.last, agreed, done = old[:at], 0, 0
        for end in range(at + 1, len(data) + 1):
            if end > at + len(inserted) and agreed >= self.v.longest:
                self.last.extend(old[end - shift - 1 :])
                break
            token = self._last_of(data, end)
            self.last.append(token)
            done += 1
            before = end - shift - 1
            agreed = agreed + 1 if end > at + len(inserted) and 0 <= before < len(old) and old[before] == token else 0
        self.data = data
        return done

    def ids(self, end: int | None = None) -> list[int]:
        """Encoding of the first ``end`` bytes."""
        at, out = len(self.data) if end is None else end, []
        while at > 0:
            out.append(self.last[at - 1])
            at -= len(self.v.bytes[out[-1]])
        return out[::-1]


class PrefixEncoder(Encoder):
    """``encode(text)`` as little-endian unsigned 32-bit integers; ``decode`` gives the bytes again."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, size: int = UNITS):
        import regex

        super().__init__(size, [])
        self.v = Vocabulary(ranks)
        self.prefixes = Prefixes(self.v)
        # White space in the pattern's sense is Unicode White_Space, which the library's own \s is not exactly.
        self.word = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))

    def letters(self, word: str) -> bytes:
        data = word.encode("utf-8", "surrogatepass")
        whole = self.v.ranks.get(data)
        if whole is not None:
            return array("I", [whole]).tobytes()
        self.prefixes.turn(data)
        return array("I", self.prefixes.ids()).tobytes()

    def each(self, units: list[str]) -> list[bytes]:
        """New units are taken in order, so that words with a common beginning follow each other."""
        found = list(map(self.units.get, units))
        for i in sorted((i for i, ids in enumerate(found) if ids is None), key=units.__getitem__):
            found[i] = self.units[units[i]]
        return found

    def make(self, text: str) -> bytes:
        return b"".join(map(self.letters, self.word.findall(text)))

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        return b"".join(map(self.v.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def prefix_encoder(ranks_path: str, pattern: str) -> PrefixEncoder:
    """One for each worker process, so that its tasks share the stores."""
    return held(("prefixes", ranks_path, pattern), lambda: PrefixEncoder(read_ranks(ranks_path), pattern))


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: ids as little-endian unsigned 32-bit integers and the bytes they stand for.

    Cases: a null or empty text has no ids and no bytes; repeated rows and null ids of
    documents are each encoded; other columns are ignored; any length (work is linear
    in it, memory a few times the text).
    """
    small_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(ranks_path, pattern)
        for doc_ids, coded in encoder.groups(batches):
            yield rows_of(out, {"doc_id": doc_ids, "ids": [ids.tobytes() for ids in coded], "decoded": list(map(encoder.decode, coded))})

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary, decoded binary")


def bpe_digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


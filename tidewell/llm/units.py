"""Token ids of whole texts by a byte-level BPE file of the tokenizers library.

Byte-level BPE never merges across its pre-tokens, and each pre-token lies inside
one *unit*: an optional blank with the run of non-blanks after it, or a run of
white space.  A text's ids are therefore its units' ids in order, and units repeat
far more often than texts do.  The library encodes each unit once per worker; the
store of units holds two generations of at most ``UNITS`` bytes, keys, values and the
table around them counted, so memory is bounded in any language: where words are not set
apart, a unit is a sentence, and units of over ``LARGEST`` bytes are not kept.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewell.llm.common import held

#: Unicode White_Space, as the library's pre-tokenizer sees it (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
UNIT = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Marks that may end a unit after a letter.
MARKS = ".,;:!?)\"%$#&*"
#: Bytes of units kept in a worker, in each of two generations; bytes of a table's place for one; the largest unit kept.
UNITS, PLACE, LARGEST = 96 << 20, 100, 700
#: Text that is encoded at once.
GROUP_BYTES = 5_000_000


class Recent(dict):
    """A store of ``make(key)`` in bounded memory: when it has ``size`` bytes it becomes the old
    generation, and what is asked for again moves over to the new one."""

    def __init__(self, make: Callable[[str], bytes], size: int = UNITS):
        self.make, self.size, self.used, self.old = make, size, 0, {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        cost = getsizeof(key) + getsizeof(found) + PLACE
        if cost <= LARGEST:
            if self.used + cost > self.size:
                self.old, self.used = dict(self), 0
                self.clear()
            self.used += cost
            self[key] = found
        return found


class Encoder:
    """Ids of texts by those of their units; what a unit's ids are is left to ``make``."""

    def __init__(self, size: int, special: list[str]):
        self.special = special  # such a string is a token of its own wherever it stands
        self.units = Recent(self._unit, size)

    def make(self, text: str) -> bytes:
        """Ids of any text, as little-endian unsigned 32-bit integers."""
        raise NotImplementedError

    def letters(self, word: str) -> bytes:
        """Ids of letters that a blank may precede: one pre-token."""
        return self.make(word)

    def each(self, units: list[str]) -> list[bytes]:
        """Ids of the different units of a batch."""
        return list(map(self.units.__getitem__, units))

    def _unit(self, unit: str) -> bytes:
        core = unit.rstrip(MARKS)
        if not core.removeprefix(" ").isalpha():
            return self.make(unit)
        if core == unit:
            return self.letters(unit)
        return self.units[core] + self.units[unit[len(core) :]]  # a pre-token ends between a letter and such a mark

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self.make(text)
        return b"".join(map(self.units.__getitem__, UNIT.findall(text)))

    def encode_many(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text. Where all white space is single, units are what blanks and line ends
        separate; Arrow splits them and numbers the different ones, so each is looked up once a batch."""
        odd = pc.match_substring_regex(texts, f"[{WHITE}][{WHITE}]|\\A[{WHITE}]|[{WHITE}]\\z")
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        plain = texts.filter(pc.invert(odd))
        out: list[np.ndarray | None] = [None] * len(texts)
        numbers = np.flatnonzero(~odd.to_numpy(zero_copy_only=False))
        if len(numbers):
            lists = pc.split_pattern(pc.replace_substring(plain, "\n", " \n "), " ")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            coded = lists.flatten().dictionary_encode()
            at, words = coded.indices.to_numpy(zero_copy_only=False).copy(), coded.dictionary.to_pylist()
            line = words.index("\n") if "\n" in words else -1
            bare = np.zeros(len(at), bool)  # no blank before it: first of its text or line
            bare[offsets[:-1]] = True
            bare[1:] |= at[:-1] == line
            first, place = np.unique(at[bare], return_inverse=True)
            units = [" " + w for w in words]
            if line >= 0:
                units[line] = "\n"
            at[bare] = len(words) + place
            units += [words[i] for i in first.tolist()]
            found = self.each(units)
            sizes = np.fromiter(map(len, found), np.int32, len(found)) // 4
            flat = np.frombuffer(b"".join(found), "<u4")
            begins = np.cumsum(sizes, dtype=np.int32) - sizes
            each = sizes[at]
            ends = np.cumsum(each, dtype=np.int32)
            places = np.repeat(begins[at] - (ends - each), each)
            places += np.arange(len(places), dtype=np.int32)
            ids = flat[places]
            stops = ends[offsets[1:] - 1].tolist()
            for number, low, high in zip(numbers.tolist(), [0, *stops], stops, strict=False):
                out[number] = ids[low:high]
        for number, text in enumerate(texts):
            if out[number] is None:
                out[number] = np.frombuffer(self.encode(text.as_py()), "<u4")
        return out


    def groups(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        """``doc_id``s and ids of rows that are put together, or cut, to about ``GROUP_BYTES`` bytes of text."""
        held: list[pa.RecordBatch] = []
        total = 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).tolist()
            start = 0
            for row, size in enumerate(sizes):
                total += size
                if total >= GROUP_BYTES:
                    yield self._group([*held, batch.slice(start, row + 1 - start)])
                    held, total, start = [], 0, row + 1
            if start < len(sizes):
                held.append(batch.slice(start))
        if held:
            yield self._group(held)

    def _group(self, held: list[pa.RecordBatch]) -> tuple[list, list[np.ndarray]]:
        rows = pa.Table.from_batches(held).combine_chunks()
        return rows.column("doc_id").to_pylist(), self.encode_many(rows.column("text").chunk(0))


class UnitEncoder(Encoder):
    """The tokenizers library over units."""

    def __init__(self, path: str, size: int = UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        super().__init__(size, [str(t.content) for t in self.library.get_added_tokens_decoder().values()])
        self.model = self.library.model
        # Byte-level BPE writes a byte as a visible character: itself if it has a glyph, else the next one from 256 on.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(256 + k) for k, b in enumerate(hidden)}

    def make(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def letters(self, word: str) -> bytes:
        """One pre-token: the library's model encodes it directly."""
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))]).tobytes()


def unit_encoder(path: str, size: int = UNITS) -> UnitEncoder:
    """One for each worker process, so that its tasks share the store of twice ``size`` bytes."""
    return held(("units", path, size), lambda: UnitEncoder(path, size))

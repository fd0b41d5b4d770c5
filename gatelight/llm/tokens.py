"""Token ids of many texts by a tokenizers file, with a bounded memory of the words seen before.

Both vocabularies split a text by a pattern before they merge. The units and chunks used here end only where that
pattern always ends a match, so a text's ids are their ids in a row, and each worker encodes a frequent one
once. A unit is a word or a run of signs, with the white space before it. Units of up to 16 bytes are found in a table by their own bytes, all of
an Arrow batch's part at once; the others, and those not in the table, are looked up one by one. New units are
cut into chunks; a chunk that is one match by itself goes straight to the file's merge model.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa

from gatelight.llm.text import parts

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Latin letters up to U+024F, and ASCII signs without the apostrophe, which the patterns treat apart.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
WORDS = rf" ?[{LETTERS}]+(?=[\s{SIGNS}]|\Z)| ?[{SIGNS}]+(?=[\sA-Za-z0-9]|\Z)"
#: White space as the byte-level pattern deals with it: one space goes to the word behind it.
SPACED = re.compile(rf"{WORDS}| ?\S+|\s+(?!\S)|\s+").findall
#: For vocabularies that drop white space.
BARE = re.compile(rf"{WORDS}| ?[^ \t\n]+".replace(" ?", "")).findall
ONE_MATCH = re.compile(rf" ?[{LETTERS}]+| ?[{SIGNS}]+").fullmatch
#: The same for the bytes of letters up to U+00FF.
PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
#: Python counts these as white space, Unicode and the tokenizers do not: such texts are encoded whole.
CONTROL = re.compile("[\x1c-\x1f]").search
#: Beyond these, lower case and composed forms may depend on neighbours: left to the tokenizer.
BEYOND_LATIN = re.compile("[^\x00-įı-ɏ]").search

#: Chunks that a worker remembers, and the longest chunk that is remembered; slots of the table of units, and ids of all units.
MAX_CHUNKS, MAX_CHUNK_CHARS = 500_000, 48
MAX_LONG, SLOT_BITS, MAX_IDS = 50_000, 21, 8_000_000

_SPACES, _BREAKS = np.zeros(256, bool), np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_BREAKS[[32, 9, 10]] = True
_LETTER, _SIGN, _LEAD = 1, 2, 3
_CLASS = np.zeros(256, "u1")
_CLASS[[b for b in range(128) if re.match(f"[{SIGNS}]", chr(b))]] = _SIGN
_CLASS[[b for b in range(128) if chr(b).isalpha()]] = _LETTER
#: First bytes of two-byte letters: U+00C0 to U+027F but two signs.
_CLASS[0xC3:0xCA] = _LEAD
#: First bytes of white space beyond ASCII, and control characters that count as such.
_ODD = np.zeros(256, bool)
_ODD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], "u8")


def _looked_up(table: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """table[raw] for a table of 256 entries of a byte each, many times faster."""
    return np.frombuffer(bytearray(raw.tobytes().translate(table.tobytes())), table.dtype)


def _odd_places(raw: np.ndarray) -> np.ndarray:
    """Where characters begin that may be white space to a pattern but are none in ASCII."""
    at = np.flatnonzero(_looked_up(_ODD, raw))
    a, b, c = (np.append(raw, [0, 0]).astype("i4")[at + k] for k in range(3))
    wide = (a == 0xC2) & ((b == 0x85) | (b == 0xA0)) | (a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E))) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    general = (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return at[(a < 0x20) | wide | general]


def byte_letters() -> str:
    """The character that stands for each byte value in byte-level vocabularies: printable ones for
    themselves, the others in order from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


class Memory(dict):
    """What encode gives for the chunks seen, made when a chunk is first looked up."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.encode(chunk)).tobytes()
        if len(chunk) <= MAX_CHUNK_CHARS:
            self[chunk] = ids
        return ids

    def bounded(self) -> Memory:
        if len(self) > MAX_CHUNKS:
            self.clear()
        return self


class ChunkedTokenizer:
    """Encodes texts as the tokenizers library does, special strings being ordinary text.

    spaced: whether white space yields ids (byte-level vocabularies) or is dropped and case folded.
    """

    #: The type of ids.
    kind = "u2"

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced = spaced
        self.letters = byte_letters()
        self.known = Memory(self._ids)
        self.merge = self.tokenizer.model.tokenize
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids")
        self._forget()

    def _chunks(self, text: str) -> list[str]:
        if CONTROL(text):
            return [text]
        if self.spaced:
            return SPACED(text)
        return BARE(text if BEYOND_LATIN(text) else text.lower())

    def _ids(self, chunk: str) -> list[int]:
        if ONE_MATCH(chunk) and (self.spaced or chunk.islower() or chunk.isascii()):
            if not self.spaced:
                chunk = chunk.lower()
            word = chunk.replace(" ", "Ġ") if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.letters)
            return [x.id for x in self.merge(word)]
        return self.tokenizer.encode(chunk, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        return [b"".join(map(self.known.bounded().__getitem__, self._chunks(text))) for text in texts]

    def _forget(self) -> None:
        slots = 1 << SLOT_BITS
        self.first, self.second, self.at = np.zeros(slots, "u8"), np.zeros(slots, "u8"), np.zeros(slots, "i4")
        self.size, self.count = np.zeros(slots, "u1"), np.zeros(slots, "u1")
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0
        self.long: dict[bytes, list[int]] = {}

    def _unit_ids(self, unit: bytes) -> list[int]:
        if self.spaced and unit[1:].isalpha() and unit[0] == 32:  # ASCII letters behind a space
            return [x.id for x in self.merge("Ġ" + unit[1:].decode())]
        if self.spaced and PLAIN(unit):
            return [x.id for x in self.merge(unit.decode("latin-1").translate(self.letters))]
        if unit in self.long:
            return self.long[unit]
        text = unit.decode()
        chunks = self._chunks(text)
        ids = self._ids(chunks[0]) if len(chunks) == 1 else np.frombuffer(self.encode([text])[0], "<u4").tolist()
        if 16 < len(unit) <= MAX_CHUNK_CHARS:
            self.long[unit] = ids
        return ids

    def _learn(self, units: list[bytes], stay: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the units' ids among all ids, where those of the first units, as many as stay says, remain."""
        number = {unit: k for k, unit in enumerate(dict.fromkeys(units))}
        of = np.fromiter(map(number.__getitem__, units), "i8", len(units))
        new = [self._unit_ids(unit) for unit in number]
        count = np.fromiter(map(len, new), "i8", len(new))
        at = self.used + np.cumsum(count) - count
        end = self.used + int(count.sum())
        if end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), end - len(self.ids)), self.kind)])
        self.ids[self.used : end] = np.fromiter(chain.from_iterable(new), self.kind, end - self.used)
        self.used += int(count[: of[:stay].max(initial=-1) + 1].sum())
        return at[of], count[of]

    def _units(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where units begin and end. edges: where rows begin, and the end of all."""
        kind = _looked_up(_CLASS, raw)
        leads = np.flatnonzero(kind == _LEAD)
        if len(leads):
            after = np.minimum(leads + 1, len(raw) - 1)
            own = np.where((raw[leads] == 0xC3) & ((raw[after] == 0x97) | (raw[after] == 0xB7)), 0, _LETTER)
            kind[leads], kind[after] = own, own
        changes = kind[1:] + kind[:-1] == _LETTER + _SIGN
        heads, tails = edges[:-1][edges[:-1] < len(raw)], edges[1:][edges[1:] > 0] - 1
        if not self.spaced:
            inside = ~_looked_up(_BREAKS, raw)
            begins, ends = inside.copy(), inside.copy()
            begins[1:] &= ~inside[:-1] | changes
            ends[:-1] &= ~inside[1:] | changes
            begins[heads], ends[tails] = inside[heads], inside[tails]
            return np.flatnonzero(begins), np.flatnonzero(ends) + 1
        white = _looked_up(_SPACES, raw)
        begins = white.copy()
        begins[1:] &= ~white[:-1]
        begins[1:] |= changes
        for row in np.unique(np.searchsorted(edges, _odd_places(raw), "right") - 1):  # left to the pattern as a whole
            begins[edges[row] : edges[row + 1]] = False
        begins[heads] = True
        starts = np.flatnonzero(begins)
        return starts, np.append(starts[1:], len(raw))

    def _part(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, self.kind), np.zeros(len(edges), "i8")
        if self.used > MAX_IDS or len(self.long) > MAX_LONG:
            self._forget()
        starts, ends = self._units(raw, edges)
        padded = np.concatenate([raw, np.zeros(16, "u1")])
        eights = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))
        size = ends - starts
        one = eights[starts] & _MASKS[np.minimum(size, 8)]
        two = eights[np.minimum(starts + 8, len(raw))] & _MASKS[np.clip(size - 8, 0, 8)]
        code = (one ^ (two * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        slot = (((code ^ (code >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - SLOT_BITS)).astype("i8")
        new = np.flatnonzero((self.first[slot] != one) | (self.second[slot] != two) | (self.size[slot] != size))
        at, count = self.at[slot], self.count[slot].astype("i8")
        if len(new):
            data, short = raw.tobytes(), size[new] <= 16
            new = np.concatenate([new[short], new[~short]])
            at[new], count[new] = self._learn([data[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())], int(short.sum()))
            new = new[: int(short.sum())]
            to = slot[new]
            self.first[to], self.second[to], self.size[to], self.at[to], self.count[to] = one[new], two[new], size[new], at[new], count[new]
        before = np.zeros(len(starts) + 1, "i8")
        np.cumsum(count, out=before[1:])
        return self.ids[np.repeat(at - before[:-1], count) + np.arange(before[-1])], before[np.searchsorted(starts, edges)]

    def encode_column(self, column: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by the id end if there is one, and the bounds of the texts. Null is empty."""
        ids, bounds, total = [], [np.zeros(1, "i8")], 0
        for raw, edges in parts(column):
            own, places = self._part(raw, edges)
            ids.append(own if end is None else np.insert(own, places[1:], end))
            bounds.append(total + places[1:] + (0 if end is None else np.arange(1, len(places))))
            total = int(bounds[-1][-1])
        return np.concatenate([np.zeros(0, self.kind), *ids]), np.concatenate(bounds)


def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The texts' values as little-endian bytes, one binary value for each text."""
    data = pa.py_buffer(values.astype(values.dtype.newbyteorder("<"), copy=False))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds * values.itemsize), data]).cast(pa.binary())


_made: dict[tuple, ChunkedTokenizer] = {}


def tokenizer(path: str, spaced: bool) -> ChunkedTokenizer:
    """One for each worker process."""
    if (path, spaced) not in _made:
        _made[path, spaced] = ChunkedTokenizer(path, spaced)
    return _made[path, spaced]

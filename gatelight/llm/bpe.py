"""Byte-level BPE by prefix dynamic programming over a rank file.

In any BPE encoding of a byte string, each byte prefix has exactly one last token. Knowing these for all
shorter prefixes, the last token of the next prefix is the one token that ends there and that stands
validly behind the last token of the prefix before it; two tokens stand validly side by side if the merges
that build them never meet a merge across their border that comes first. So an encoding is one pass over the
bytes, appended bytes only add entries to the table, and after an edit only the touched matches of the
splitting pattern are done again.

A match's table is kept in full by Encoding; encode_table keeps whole units' ids by worker instead, and finds those of a batch's
texts all at once (see tokens).

Defined results. A null text counts as empty, and an empty text has no ids. Repeated rows each give a row.
Null ids decode to null. Columns of the input besides the named ones are neither read nor returned.
"""

from __future__ import annotations

import base64
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.llm import scratch
from gatelight.llm.tokens import MAX_CHUNK_CHARS, MAX_CHUNKS, ChunkedTokenizer, binary

#: What Unicode calls white space; the regex module's own class has four control characters more.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NEVER = 1 << 62
#: Ids that are decoded at once.
DECODED = 1 << 18


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def compiled(pattern: str):
    """The pattern with white space as Unicode has it, whatever the module thinks of it."""
    pattern = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
    return regex.compile(pattern)


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = compiled(pattern)
        self.matches = self.pattern.findall
        self._spines: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        self._beside: dict[tuple[int, int], bool] = {}

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that merge last into a token, None for a single byte."""
        if len(token) == 1:
            return None
        parts, own = [token[i : i + 1] for i in range(len(token))], self.ranks[token]
        while len(parts) > 2:
            found = [(self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            rank, i = min(found)
            if rank >= own:
                return None  # no merges lead to this token
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _spine(self, rank: int, right: bool) -> list[tuple[bytes, int]]:
        """The parts that stand at a token's right or left end, smallest first, each with the rank of the merge
        that ends it."""
        if (rank, right) not in self._spines:
            spine, part, ends = [], self.tokens[rank], NEVER
            while part is not None:
                spine.append((part, ends))
                halves = self._halves(part)
                ends = self.ranks[part]
                part = halves and halves[right]
            self._spines[rank, right] = spine[::-1]
        return self._spines[rank, right]

    def stand_together(self, first: int, second: int) -> bool:
        """Whether BPE over the two tokens' bytes leaves these two tokens."""
        known = self._beside.get((first, second))
        if known is None:
            left, right = self._spine(first, True), self._spine(second, False)
            i = j = 0
            known = True
            while True:
                (a, a_ends), (b, b_ends) = left[i], right[j]
                across = self.ranks.get(a + b, NEVER)
                if across < a_ends and across <= b_ends and across != NEVER:
                    known = False  # a merge over the border comes before either part is gone
                    break
                if a_ends == b_ends == NEVER:
                    break
                # Equal ranks merge from the left.
                if a_ends <= b_ends:
                    i += 1
                else:
                    j += 1
            if len(self._beside) > 2_000_000:
                self._beside.clear()
            self._beside[first, second] = known
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Lengthen the table of last tokens, one for each prefix of data, to the whole of data."""
        ranks, tokens, beside = self.ranks, self.tokens, self._beside
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                rank = ranks.get(data[start:end])
                if rank is None:
                    continue
                if start == 0:
                    if end == 1 or self._halves(tokens[rank]) is not None:
                        last.append(rank)
                        break
                    continue
                before = last[start - 1]
                valid = beside.get((before, rank))
                if valid is None:
                    valid = self.stand_together(before, rank)
                if valid:
                    last.append(rank)
                    break
            else:
                raise ValueError("the ranks lack a byte")
        return last

    def walk_back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def encode_match(self, data: bytes) -> list[int]:
        rank = self.ranks.get(data)
        if rank is not None and self._halves(data) is not None:
            return [rank]
        return self.walk_back(self.extend(data, []))

    def encode(self, text: str) -> list[int]:
        return [rank for match in self.matches(text) for rank in self.encode_match(match.encode())]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Encoding:
    """A text with the prefix tables of its matches, for exact appends and edits."""

    def __init__(self, bpe: PrefixBPE, text: str = ""):
        self.bpe = bpe
        self.matches: list[str] = []
        self.tables: list[list[int]] = []
        self.append(text)

    @property
    def text(self) -> str:
        return "".join(self.matches)

    @property
    def ids(self) -> list[int]:
        return [x for table in self.tables for x in self.bpe.walk_back(table)]

    def _splice(self, first: int, stop: int, new: list[str]) -> None:
        """Put new matches in the place of those from first to stop; tables of equal beginnings are taken over."""
        was = dict(zip(self.matches[first:stop], self.tables[first:stop]))
        tables = []
        for match in new:
            known = next((table for old, table in was.items() if match.startswith(old)), [])
            tables.append(self.bpe.extend(match.encode(), list(known)))
        self.matches[first:stop] = new
        self.tables[first:stop] = tables

    def append(self, text: str) -> None:
        """The last two matches may end otherwise with more text behind them; all before stay."""
        first = max(0, len(self.matches) - 2)
        self._splice(first, len(self.matches), self.bpe.matches("".join(self.matches[first:]) + text))

    def replace(self, start: int, end: int, text: str) -> None:
        """Put text in the place of the characters from start to end.

        The pattern looks ahead by one character and never back. So the matches before the one in front of
        the edit stay, and once a new match ends behind the edit where an old one did, so do all that follow.
        """
        bounds = np.cumsum([0, *map(len, self.matches)]).tolist()
        first = max(0, int(np.searchsorted(bounds, start)) - 2)
        old, base = self.text, bounds[first]
        changed = old[base:start] + text + old[end:]
        shift = len(text) - (end - start)
        places = {b: k for k, b in enumerate(bounds) if b >= end}
        new, stop = [], len(self.matches)
        for match in self.bpe.pattern.finditer(changed):
            new.append(match[0])
            if (at := base + match.end() - shift) in places and base + match.end() >= start + len(text):
                stop = places[at]
                break
        self._splice(first, stop, new)


class ChunkMemory(ChunkedTokenizer):
    """Encodes whole texts; remembers the ids of frequent units between two certain borders of matches. Decodes many ids at once."""

    kind = "u4"

    def __init__(self, bpe: PrefixBPE):
        self.bpe, self.spaced, self.known = bpe, True, {}
        self._forget()
        self.lengths, self.starts = np.zeros(max(bpe.tokens) + 1, "i8"), np.zeros(max(bpe.tokens) + 1, "i8")
        ranks = list(bpe.tokens)
        sizes = np.fromiter(map(len, bpe.tokens.values()), "i8", len(ranks))
        self.lengths[ranks], self.starts[ranks] = sizes, np.cumsum(sizes) - sizes
        self.bytes = np.frombuffer(b"".join(bpe.tokens.values()), "u1")

    def _unit_ids(self, unit: bytes) -> array:
        ids = self.known.get(unit)
        if ids is None:
            ids = array("I", self.bpe.encode(unit.decode()))
            if len(unit) <= MAX_CHUNK_CHARS:
                if len(self.known) >= MAX_CHUNKS:
                    self.known.clear()
                self.known[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text]), None)[0].astype("<u4", copy=False).tobytes()

    def decode_column(self, column: pa.Array) -> pa.Array:
        """The bytes that each row's ids (little-endian, unsigned, 32 bits) stand for; null for null."""
        rows = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(rows.buffers()[1], "i8", len(rows) + 1, rows.offset * 8) if len(rows) else np.zeros(1, "i8")
        ids = np.frombuffer(rows.buffers()[2] or b"", "u1")[offsets[0] : offsets[-1]].view("<u4")
        bounds = (offsets - offsets[0]) // 4
        out, ends = [np.zeros(0, "u1")], np.zeros(len(ids) + 1, "i8")
        for at in range(0, len(ids), DECODED):
            own = ids[at : at + DECODED]
            sizes = self.lengths[own]
            if not sizes.all():
                raise ValueError("an id without a token")
            own_ends = np.cumsum(sizes)
            out.append(self.bytes[np.repeat(self.starts[own] - (own_ends - sizes), sizes) + np.arange(own_ends[-1])])
            ends[at + 1 : at + 1 + len(own)] = ends[at] + own_ends
        found = binary(np.concatenate(out), ends[bounds])
        return pc.if_else(pc.is_valid(column), found, pa.scalar(None, pa.binary())) if column.null_count else found


_made: dict[tuple[str, str], ChunkMemory] = {}


def _memory(path: str, pattern: str) -> ChunkMemory:
    """One for each worker process."""
    if (path, pattern) not in _made:
        _made[path, pattern] = ChunkMemory(PrefixBPE(read_ranks(path), pattern))
    return _made[path, pattern]


def encode_table(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the ids of the whole text as little-endian unsigned 32-bit integers."""
    scratch.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encoded(batches):
        memory = _memory(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), binary(*memory.encode_column(batch.column(1), None))], names=["doc_id", "ids"])

    return rows.mapInArrow(encoded, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_table(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The rows of encode_table with decoded, the bytes that the ids stand for."""

    def decoded(batches):
        memory = _memory(ranks_path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, memory.decode_column(batch.column("ids"))], names=[*batch.schema.names, "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(decoded, f"doc_id {kind}, ids binary, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

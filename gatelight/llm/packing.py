"""Sequences of token ids that hold neighbouring documents, with no padding but at the very end.

Each document's words are hashed into a vector, which is projected to DIMENSIONS numbers; their Hilbert key
(Skilling's transform) orders documents so that those close on the curve are alike. The documents' ids follow each
other along the curve and are cut every LENGTH ids. So every sequence but the last is full, and the last is cut
into powers of two, which need no padding.

Ranges of the curve are processed apart: the ids before each range are known from a sum over all
documents, so a task cuts its documents at the right places without seeing others. Documents with one key, as all copies have,
are ordered by id and may be divided over ranges.

Defined results. A null or empty text is its end id alone. A null id comes first among equal keys. Repeated rows
are packed each. Columns besides the named ones are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.llm import ranges, scratch
from gatelight.llm.text import words
from gatelight.llm.tokens import binary, tokenizer

LENGTH, END = 2048, 1
DIMENSIONS, BITS, BUCKETS = 6, 10, 1024
_PROJECTION = np.random.default_rng(77).normal(size=(BUCKETS, DIMENSIONS))


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows x dimensions, each below 2**bits)."""
    x = points.astype("i8").T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations and reflections of each level
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_keys(column: pa.Array) -> np.ndarray:
    """Hilbert keys of texts by their words."""
    out = []
    for part in words(column, lower=True):
        total = part.last - part.first
        cells = part.of * BUCKETS + (part.hashes % np.uint64(BUCKETS)).astype("i8")
        sums = np.zeros((total, DIMENSIONS))
        for d in range(DIMENSIONS):
            sums[:, d] = np.bincount(part.of, _PROJECTION[cells % BUCKETS, d], total)
        length = np.sqrt(np.maximum(1, np.diff(part.bounds)))[:, None]
        # Rank-like coordinates: the normal shape of the sums makes the cells about even.
        place = 1 / (1 + np.exp(-np.clip(sums / length, -30, 30)))
        out.append(hilbert_keys((place * ((1 << BITS) - 1)).astype("i8")))
    return np.concatenate(out) if out else np.zeros(0, "i8")


def _encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, key, n, ids (unsigned 16-bit) of each document, its end id last."""

    def encoded(batches):
        own = tokenizer(path, spaced=False)
        for batch in batches:
            ids, bounds = own.encode_column(batch.column(1), end)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve_keys(batch.column(1))), pa.array(np.diff(bounds)), binary(ids, bounds)], names=["doc_id", "key", "n", "ids"])

    return docs.mapInArrow(encoded, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key long, n long, ids binary")


def pieces_of(start: int, n: int, total: int, length: int) -> list[tuple[int, int, int, int]]:
    """(first id, ids, sequence, offset) of the pieces of n ids that begin at the place start of total."""
    full = total // length * length
    out, at = [], start
    while at < start + n:
        if at < full:
            sequence, offset = divmod(at, length)
            room = length - offset
        else:  # the rest, as powers of two from the largest down
            first, sequence, rest = full, full // length, total - full
            while at >= first + (1 << (rest.bit_length() - 1)):
                part = 1 << (rest.bit_length() - 1)
                first, rest, sequence = first + part, rest - part, sequence + 1
            offset = at - first
            room = (1 << (rest.bit_length() - 1)) - offset
        size = min(room, start + n - at)
        out.append((at - start, size, sequence, offset))
        at += size
    return out


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned 32-bit little-endian), doc_tokens, sequence_id, offset.

    For vocabularies of at most 65,536 ids.
    """
    spark = docs.sparkSession
    scratch.bounded_batches(spark)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, _ = scratch.written(_encoded(texts, tokenizer_path, end), "encoded")
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    marked, before = ranges.split(rows, ["key", "doc_id"], "n", n_ranges)
    total = before[-1]
    kind = rows.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        at, current = 0, None
        for batch in batches:
            out = []
            for doc, n, ids, place in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n", "ids", "range_"))):
                if place != current:
                    current, at = place, before[place]
                for first, size, sequence, offset in pieces_of(at, n, total, length):
                    out.append((doc, first, size, np.frombuffer(ids, "<u2", size, 2 * first).astype("<u4").tobytes(), n, sequence, offset))
                at += n
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * 7, kinds)], names=names)

    ordered = ranges.in_order(marked, ["key", "doc_id"], n_ranges)
    return ordered.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with ids_crc32 in place of ids."""
    return pieces.select(*[F.crc32("ids").alias("ids_crc32") if c == "ids" else c for c in pieces.columns])

"""Token ids of documents in compressed, checksummed files, in ascending order of id.

A file holds the ids of a run of documents, cut into blocks of BLOCK ids that the range coder codes each from a fresh start.
Layout, all numbers little-endian:

    magic (8 bytes), version, ids per block, documents, blocks, different ids, magnitudes (6 x u4), ids before this file, ids (2 x u8)
    document ids (i8 each), whether null (u1 each), numbers of ids (u8 each), the ids from the most frequent on (u2 each),
    bounds of the magnitudes of their ranks (u2 each, one more than magnitudes), CRC-32 of these five (u4)
    for each block: bytes of code, CRC-32 of the code, CRC-32 of the ids as u4 (3 x u4)
    the codes of the blocks

Documents are divided into ranges of doc_id; a range's place in the whole is known from sums over all
documents. Each range writes its own files to the shared folder under names that depend on the place alone; a
file is moved there once it is complete, so a task that runs again replaces it by the same bytes. For
vocabularies of at most 65,535 ids; doc_id is a long.

Defined results. A null or empty text is its end id alone. Rows with a null id come first. Repeated rows are
written each. Without documents there are no files. Columns besides the named ones are neither read nor written.
A damaged file raises an error that names it.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.llm import rangecoder, ranges, scratch
from gatelight.llm.tokens import binary, tokenizer

MAGIC, VERSION, BLOCK = b"GLTOKENS", 2, 512
#: Ids after which a file is closed.
FILE_IDS = 8 << 20
_HEAD = np.dtype([("magic", "S8"), ("version", "<u4"), ("block", "<u4"), ("docs", "<u4"), ("blocks", "<u4"), ("different", "<u4"), ("magnitudes", "<u4"), ("before", "<u8"), ("ids", "<u8")])
_ROW = np.dtype([("bytes", "<u4"), ("code_crc", "<u4"), ("ids_crc", "<u4")])


def _columns(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids as steps x blocks, and the blocks' lengths."""
    blocks = -(-len(ids) // block)
    lengths = np.full(blocks, block)
    if blocks:
        lengths[-1] = len(ids) - (blocks - 1) * block
    full = np.zeros(blocks * block, "u2")
    full[: len(ids)] = ids
    return np.ascontiguousarray(full.reshape(blocks, block).T), lengths


def _ids_crcs(ids: np.ndarray, block: int) -> list[int]:
    """The CRC-32 of each block's ids as u4."""
    data = memoryview(ids.astype("<u4").tobytes())
    return [zlib.crc32(data[at : at + 4 * block]) for at in range(0, len(data), 4 * block)]


def to_bytes(doc_ids: list, sizes: list[int], ids: np.ndarray, before: int, block: int = BLOCK) -> bytes:
    grid, lengths = _columns(ids, block)
    ranks = rangecoder.Ranks.of(ids)
    codes = rangecoder.encode(grid, lengths, ranks)
    head = np.array([(MAGIC, VERSION, block, len(doc_ids), len(codes), len(ranks.ids), len(ranks.bounds) - 1, before, len(ids))], _HEAD)
    index = b"".join([
        np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes(),
        np.array([x is None for x in doc_ids], "u1").tobytes(),
        np.array(sizes, "<u8").tobytes(),
        ranks.ids.astype("<u2").tobytes(),
        ranks.bounds.astype("<u2").tobytes(),
    ])
    rows = np.zeros(len(codes), _ROW)
    rows["bytes"], rows["code_crc"], rows["ids_crc"] = list(map(len, codes)), list(map(zlib.crc32, codes)), _ids_crcs(ids, block)
    return b"".join([head.tobytes(), index, np.array([zlib.crc32(index)], "<u4").tobytes(), rows.tobytes(), *codes])


def from_bytes(data: bytes) -> tuple[list, np.ndarray, np.ndarray, int]:
    """Document ids, numbers of ids, all ids, and the ids before the file."""
    head = np.frombuffer(data, _HEAD, 1)[0] if len(data) >= _HEAD.itemsize else None
    if head is None or head["magic"] != MAGIC or head["version"] != VERSION:
        raise ValueError("not a file of this format")
    docs, blocks, at = int(head["docs"]), int(head["blocks"]), _HEAD.itemsize
    different, bounds = int(head["different"]), int(head["magnitudes"]) + 1
    size = 17 * docs + 2 * (different + bounds)
    index = data[at : at + size]
    if len(data) < at + size + 4 or zlib.crc32(index) != np.frombuffer(data, "<u4", 1, at + size)[0]:
        raise ValueError("the index is damaged")
    ranks = rangecoder.Ranks(np.frombuffer(index, "<u2", different, 17 * docs), np.frombuffer(index, "<u2", bounds, 17 * docs + 2 * different).astype("i8"))
    names, null, sizes = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "u1", docs, 8 * docs), np.frombuffer(index, "<u8", docs, 9 * docs)
    at += size + 4
    rows = np.frombuffer(data, _ROW, blocks, at)
    at += rows.nbytes
    ends = at + np.cumsum(rows["bytes"], dtype="i8")
    codes = [data[end - n : end] for end, n in zip(ends.tolist(), rows["bytes"].tolist())]
    if any(zlib.crc32(c) != r for c, r in zip(codes, rows["code_crc"])):
        raise ValueError("a block is damaged")
    total, block = int(head["ids"]), int(head["block"])
    lengths = np.minimum(block, total - block * np.arange(blocks))
    ids = rangecoder.decode(codes, lengths, ranks).T.reshape(-1)[:total] if blocks else np.zeros(0, "u2")
    if _ids_crcs(ids, block) != rows["ids_crc"].tolist():
        raise ValueError("a block decodes to other ids")
    return [None if z else x for x, z in zip(names.tolist(), null.tolist())], sizes.astype("i8"), ids, int(head["before"])


def write(docs: DataFrame, tokenizer_path: str, end: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents; one row per file: path, first (ids before it), ids, docs, bytes."""
    spark = docs.sparkSession
    scratch.bounded_batches(spark)
    folder = folder or scratch.new_path(spark, "token-files")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def encoded(batches):
        own = tokenizer(tokenizer_path, spaced=True)
        for batch in batches:
            ids, bounds = own.encode_column(batch.column(1), end)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), binary(ids, bounds)], names=["doc_id", "n", "ids"])

    rows, path = scratch.written(texts.mapInArrow(encoded, "doc_id long, n long, ids binary"), "encoded")
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    marked, before = ranges.split(rows, ["doc_id"], "n", n_ranges)

    def filed(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        place, at, number = None, 0, 0
        held: tuple[list, list, list] = ([], [], [])

        def close():
            nonlocal number
            names, sizes, ids = held
            data = to_bytes(names, sizes, np.frombuffer(b"".join(ids), "<u2"), at)
            name = f"range-{place:06d}-{number:04d}.glt"
            with store.open_output_stream(part := f"{base}/.{name}.{uuid.uuid4().hex}") as out:
                out.write(data)
            store.move(part, f"{base}/{name}")
            row = [[f"{folder}/{name}"], [at], [sum(sizes)], [len(names)], [len(data)]]
            number += 1
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(row[0]), *(pa.array(x, pa.int64()) for x in row[1:])], names=["path", "first", "ids", "docs", "bytes"])

        for batch in batches:
            for doc, n, ids, range_ in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "n", "ids", "range_"))):
                if held[0] and (range_ != place or sum(held[1]) >= FILE_IDS):
                    done = sum(held[1])
                    yield close()
                    at += done
                if range_ != place:
                    place, at, number = range_, before[range_], 0
                for x, v in zip(held, (doc, n, ids)):
                    x.append(v)
        if held[0]:
            yield close()

    ordered = ranges.in_order(marked, ["doc_id"], n_ranges)
    files, _ = scratch.written(ordered.mapInArrow(filed, "path string, first long, ids long, docs long, bytes long"), "files")
    scratch.drop(spark, path)
    return files


def read(files: DataFrame) -> DataFrame:
    """The documents in the files of write: doc_id, start (ids of all documents before it), n_tokens, ids (u4 each, little-endian)."""

    def opened(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at) as source:
                    data = source.read()
                try:
                    names, sizes, ids, first = from_bytes(data)
                except ValueError as error:
                    raise ValueError(f"{path}: {error}") from error
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                for k in range(0, len(names), 1000):
                    last = min(k + 1000, len(names))
                    parts = [ids[bounds[j] : bounds[j + 1]].astype("<u4").tobytes() for j in range(k, last)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[k:last], pa.int64()), pa.array(bounds[k:last] + first, pa.int64()), pa.array(sizes[k:last]), pa.array(parts, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
                    )

    spread = files.select("path").repartition(max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))
    return spread.mapInArrow(opened, "doc_id long, start long, n_tokens long, ids binary")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers)."""
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

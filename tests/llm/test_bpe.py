import hashlib
import random

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken

from gatelight.llm import bpe
from tests.llm.test_tokens import PIECES

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.PrefixBPE(bpe.read_ranks(PATH), P.PATTERN)


@pytest.fixture(scope="module")
def theirs(own):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def texts(n, seed=3):
    rng = random.Random(seed)
    letters = "aaabcdeéilnnorsstttu  '.\nß日"
    made = ["".join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(n)]
    return made + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(n)]


def test_same_ids_as_the_public_library(own, theirs):
    memory = bpe.ChunkMemory(own)
    for text in ["", *texts(3000), " " * 3000, "ab" * 3000, "\n" * 500, "=" * 999, "a" * 2000]:
        ids = theirs.encode_ordinary(text)
        assert own.encode(text) == ids, repr(text[:100])
        assert np.frombuffer(memory.encode(text), "<u4").tolist() == ids, repr(text[:100])
        assert own.decode(ids) == text.encode()


def test_columns_of_texts_are_encoded_and_decoded_at_once(own, theirs, monkeypatch):
    memory, rows = bpe.ChunkMemory(own), [*texts(300), None, "", "\x1c a", "x " * 5000, "é\u2003b", None]
    monkeypatch.setattr(bpe, "DECODED", 1000)
    monkeypatch.setattr("gatelight.llm.text.PART_BYTES", 2000)
    monkeypatch.setattr("gatelight.llm.tokens.MAX_IDS", 500)
    monkeypatch.setattr(bpe, "MAX_CHUNKS", 50)
    for column in (pa.array(rows), pa.array(["skipped", *rows])[1:]):
        ids, bounds = memory.encode_column(column, None)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [theirs.encode_ordinary(t or "") for t in rows]
    coded = pa.array([None if t is None else np.array(theirs.encode_ordinary(t), "<u4").tobytes() for t in ["skipped", *rows]], pa.binary())[1:]
    assert memory.decode_column(coded).to_pylist() == [None if t is None else t.encode() for t in rows]
    assert memory.decode_column(coded[:0]).to_pylist() == [] and memory.decode_column(pa.array([None], pa.binary())).to_pylist() == [None]
    with pytest.raises((ValueError, IndexError)):
        memory.decode_column(pa.array([np.array([60_000], "<u4").tobytes()], pa.binary()))


def test_appends_and_edits(own, theirs):
    rng = random.Random(5)
    for _ in range(60):
        parts = texts(3, rng.random())
        state = bpe.Encoding(own)
        for part in parts:
            state.append(part)
            assert state.ids == theirs.encode_ordinary(state.text)
        for _ in range(8):
            text = state.text
            a, b = sorted(rng.choices(range(len(text) + 1), k=2))
            b = min(b, a + 9)
            new = "".join(rng.choices(PIECES, k=rng.randint(0, 3)))
            state.replace(a, b, new)
            assert state.text == text[:a] + new + text[b:]
            assert state.ids == theirs.encode_ordinary(state.text)


def test_tables(spark, theirs):
    rows = [(1, "The the the", 1), (2, None, 2), (3, "", 3), (3, "é" * 9000, 4), (None, "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = bpe.digests(bpe.decode_table(bpe.encode_table(docs, PATH, P.PATTERN), PATH, P.PATTERN)).collect()
    expected = []
    for i, text, _ in rows:
        ids = theirs.encode_ordinary(text or "")
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode_table(bpe.encode_table(none, PATH, P.PATTERN), PATH, P.PATTERN).count() == 0

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from gatelight.llm import rangecoder, token_files
from tokenizers import Tokenizer

PATH = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", range(5))
def test_coder_round_trip(kind):
    rng = np.random.default_rng(kind)
    for blocks, steps in ((1, 1), (3, 50), (9, 400)):
        shape = (steps, blocks)
        ids = [rng.integers(0, 50257, shape), rng.integers(0, 4, shape), np.zeros(shape), np.minimum(rng.geometric(0.001, shape), 50256), np.full(shape, 65534)][kind].astype("u2")
        lengths = np.full(blocks, steps)
        lengths[-1] = max(1, steps // 3)
        ranks = rangecoder.Ranks.of(np.concatenate([ids[:n, k] for k, n in enumerate(lengths)]))
        codes = rangecoder.encode(ids, lengths, ranks)
        found = rangecoder.decode(codes, lengths, ranks)
        for k in range(blocks):
            assert (found[: lengths[k], k] == ids[: lengths[k], k]).all()
        if kind in (1, 2) and steps == 400:
            assert sum(map(len, codes)) < lengths.sum()


def test_file_bytes():
    ids = np.random.default_rng(3).integers(0, 900, 5000).astype("u2")
    data = token_files.to_bytes([None, -5, 7], [1, 0, 4999], ids, 77, block=300)
    names, sizes, found, before = token_files.from_bytes(data)
    assert names == [None, -5, 7] and sizes.tolist() == [1, 0, 4999] and before == 77 and (found == ids).all()
    assert token_files.from_bytes(token_files.to_bytes([], [], ids[:0], 0))[0] == []
    for at in (3, 60, len(data) - 5):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_files.from_bytes(bytes(bad))


def test_documents_come_back_in_order(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_IDS", 500)
    rng = random.Random(1)
    rows = [(i * 3 - 60, " ".join(rng.choices("The river! town's old 12 école".split(), k=rng.randint(0, 50)))) for i in range(120)]
    rows += [(5000, None), (5001, ""), (5002, "long " * 20_000), (None, "no id")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n int").repartition(4)
    files = token_files.write(docs, PATH)
    assert files.count() > 4
    found = {r.doc_id: r for r in token_files.digests(token_files.read(files)).collect()}
    own, start = Tokenizer.from_file(PATH), 0
    assert len(found) == len(rows)
    for i, t in sorted(rows, key=lambda r: -(10**9) if r[0] is None else r[0]):
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(found[i])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    found = sorted((r.doc_id, r.start, r.n_tokens) for r in token_files.digests(token_files.read(token_files.write(docs, PATH))).collect())
    assert found == [(1, 0, 2), (1, 2, 2), (2, 4, 2)]
    assert token_files.read(token_files.write(docs.limit(0), PATH)).count() == 0


def test_sums_of_blocks_are_of_their_ids():
    ids = np.arange(70, dtype="u2")
    assert token_files._ids_crcs(ids, 32) == [zlib.crc32(ids[k : k + 32].astype("<u4").tobytes()) for k in (0, 32, 64)]
    assert token_files._ids_crcs(ids[:0], 32) == []

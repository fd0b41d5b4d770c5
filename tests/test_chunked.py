"""Digests in pieces equal those of whole files, and take memory for a piece only."""

import hashlib
import io
import tracemalloc

import pytest

from gatelight.sources import chunked, files

TEXTS = {"a.txt": b"one\r\ntwo\rthree\n", "sub/b.txt": "é\r\n".encode() * 50 + b"\r", "sub/c.bin": b"\xff\r\n\xfe", "d.bin": b"ok\r\n\xc3", "empty": b"", "e": b"\r", "f": b"\r\r\n\n\r"}


@pytest.mark.parametrize("size", [1, 2, 3, 1 << 20])
def test_equal_to_digests_of_whole_files(spark, tmp_path, size):
    for name, data in TEXTS.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = {r.path: r for r in chunked.file_digests(spark, str(tmp_path), size).collect()}
    assert {p: (r.sha256, r.length) for p, r in found.items()} == {p: (hashlib.sha256(d).hexdigest(), len(d)) for p, d in TEXTS.items()}
    for canonical, column in ((True, "canonical_sha256"), (False, "sha256")):
        whole = {r.path: r.digest for r in files.digests(spark, str(tmp_path), canonical, whole=True).collect()}
        assert {p: r[column] for p, r in found.items() if r.length} == whole  # that source leaves empty files out
        assert {r.path: r.digest for r in files.digests(spark, str(tmp_path), canonical).collect()} == {p: r[column] for p, r in found.items()}
    one = chunked.file_digests(spark, f"file://{tmp_path}/a.txt").collect()
    assert len(one) == 1 and one[0].sha256 == found["a.txt"].sha256


def test_empty_folder(spark, tmp_path):
    assert chunked.file_digests(spark, str(tmp_path)).count() == 0


def test_files_are_dealt_by_size(tmp_path, monkeypatch):
    monkeypatch.setattr(chunked, "MAX_BYTES", 10)
    for k in range(5):
        (tmp_path / str(k)).write_bytes(b"x" * 6)
    assert len(chunked._Reader({"path": str(tmp_path)}).partitions()) == 5


def test_memory_is_that_of_a_piece():
    class Long(io.RawIOBase):
        left = 200 << 20

        def read(self, size=-1):
            size = min(size, self.left)
            self.left -= size
            return b"line\r\n"[:1] * size

    tracemalloc.start()
    *_, size = chunked.digests(chunked.pieces(Long()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size == 200 << 20 and peak < 12 << 20

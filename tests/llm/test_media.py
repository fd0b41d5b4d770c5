import hashlib
import zlib

import numpy as np

from gatelight.llm import media

ROWS = [(1, "abc", 5), (2, None, 6), (3, "", 7), (4, "é" * 64, 1), (5, "The quick brown fox. " * 4000, 2), (5, "abc", 2), (None, "x" * 64, 3)]


def test_round_trip_and_digests(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, media int")
    found = media.digests(media.fingerprints(media.to_wav(docs))).collect()
    assert len(found) == len(ROWS)
    by_sha = {r.payload_sha256: r for r in found}
    for _, text, _ in ROWS:
        raw = (text or "").encode()
        full = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        row = by_sha[hashlib.sha256(full).hexdigest()]
        assert (row.n_bytes, row.payload_bytes, row.tail_crc32) == (len(raw), len(full), zlib.crc32(full[-64:]))
        wav = media.wav_bytes(raw)
        assert (row.media_bytes, row.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert media.samples(wav) == full


def test_peaks_do_not_depend_on_segments(monkeypatch):
    data = np.random.default_rng(1).integers(32, 122, 60_000).astype("u1").tobytes()
    whole = media.landmark_pairs(data)
    monkeypatch.setattr(media, "SEGMENT", 37)
    cut = media.landmark_pairs(data)
    assert len(whole[0]) > 100 and all((a == b).all() for a, b in zip(whole, cut))


def test_tone_is_found_at_its_bin():
    t = np.arange(8000)
    tone = (128 + 100 * np.sin(2 * np.pi * t * 50 / media.FRAME) * np.hanning(8000)).astype("u1").tobytes()
    at, bins = media._peaks(np.frombuffer(tone, "u1"))
    assert 50 in bins


def test_damaged_media_and_empty_table(spark):
    bad = spark.createDataFrame([(1, 3, bytearray(b"xx")), (2, 0, None)], "doc_id long, n_bytes long, media binary")
    assert [r.payload for r in media.fingerprints(bad).collect()] == [None, None]
    assert media.digests(media.fingerprints(bad)).count() == 2
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert media.fingerprints(media.to_wav(docs)).count() == 0


def test_peaks_equal_a_naive_transform():
    """Bins by the sums of the definition, and peaks one frame and band at a time."""
    data = np.random.default_rng(8).integers(32, 122, 9_000).astype("u1")
    n = max(1, -(-(len(data) - media.FRAME) // media.HOP) + 1)
    padded = np.zeros((n - 1) * media.HOP + media.FRAME)
    padded[: len(data)] = data.astype("f8") - 128
    turns = np.outer(np.arange(media.BANDS[-1]), np.arange(media.FRAME)) / media.FRAME
    waves = np.exp(-2j * np.pi * turns)
    power = np.array([[abs((padded[k * media.HOP : k * media.HOP + media.FRAME] * media._WINDOW * w).sum()) for w in waves] for k in range(n)])
    expected = set()
    for a, b in zip(media.BANDS, media.BANDS[1:]):
        for k in range(n):
            top = power[k, a:b].max()
            around = [power[j, a:b].max() for j in range(max(0, k - media.NEAR), min(n, k + media.NEAR + 1)) if j != k]
            if top > max(around, default=0) and top > 1:
                expected.add((k, a + int(power[k, a:b].argmax())))
    at, bins = media._peaks(data)
    assert set(zip(at.tolist(), bins.tolist())) == expected and len(expected) > 20

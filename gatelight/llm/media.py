"""Texts as sound: lossless 8-bit WAV columns, and spectral-peak fingerprints read back from them.

to_wav stores each text's bytes as the samples of a mono WAV file (wave module), filled with bytes 0 up
to a positive multiple of BLOCK. fingerprints reads such files back, takes short-time Fourier transforms,
picks in each band the bins that are the largest of their neighbourhood in time, and pairs every peak with
the next few: a pair's code is (bin, bin, frames between). The codes are kept beside the frames they start
in, as two arrays of equal length in order of time. A file is transformed in runs of frames, so memory is bounded
by SEGMENT, not by the file, and runs overlap so that the result doesn't depend on where they are cut.

Defined results. A null text counts as empty and yields one block of zeros; a null or damaged file
yields null columns. Silence (all samples equal) has no peaks and so no pairs. Repeated rows each give a row.
Columns of the input besides the two named ones are neither read nor returned.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.llm import scratch

BLOCK, RATE = 64, 8000
#: Samples in a frame, between frames, and frames transformed at once.
FRAME, HOP, SEGMENT = 256, 128, 2048
#: First bins of the bands, frames on either side that a peak must exceed, partners of a peak, reach in frames.
BANDS, NEAR, PARTNERS, REACH = (2, 12, 24, 40, 64, 129), 2, 3, 31
_WINDOW = np.hanning(FRAME).astype("f4")


def wav_bytes(data: bytes) -> bytes:
    size = max(BLOCK, -(-len(data) // BLOCK) * BLOCK)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(data.ljust(size, b"\0"))
    return out.getvalue()


def samples(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _peaks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, by frame and then bin."""
    n = max(1, -(-(len(data) - FRAME) // HOP) + 1)
    wave_ = np.zeros((n - 1) * HOP + FRAME, "f4")
    wave_[: len(data)] = data[: len(wave_)]
    wave_[: len(data)] -= np.float32(128)
    frames = np.lib.stride_tricks.sliding_window_view(wave_, FRAME)[::HOP]
    at, bins = [], []
    for first in range(0, n, SEGMENT):
        lo, hi = max(0, first - NEAR), min(n, first + SEGMENT + NEAR)
        power = np.abs(np.fft.rfft(frames[lo:hi] * _WINDOW, axis=1)).astype("f4")
        own = slice(first - lo, min(n, first + SEGMENT) - lo)
        for a, b in zip(BANDS, BANDS[1:]):
            best = power[:, a:b].argmax(axis=1)
            top = power[np.arange(len(power)), a + best]
            wide = np.pad(top, NEAR)
            around = np.max([wide[k : k + len(top)] for k in range(2 * NEAR + 1) if k != NEAR], axis=0)
            hit = np.flatnonzero(((top > around) & (top > 1))[own])
            at.append(hit + first)
            bins.append(a + best[own][hit])
    at, bins = np.concatenate(at), np.concatenate(bins)
    order = np.lexsort((bins, at))
    return at[order], bins[order]


def landmark_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start frames and codes of the peak pairs of 8-bit samples."""
    at, bins = _peaks(np.frombuffer(data, "u1"))
    times, codes = [], []
    for k in range(1, min(PARTNERS, len(at) - 1) + 1):
        gap = at[k:] - at[:-k]
        ok = gap <= REACH
        times.append(at[:-k][ok])
        codes.append((bins[:-k][ok] << 16) | (bins[k:][ok] << 8) | gap[ok])
    if not times:
        return np.zeros(0, "i4"), np.zeros(0, "i4")
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype("i4"), codes[order].astype("i4")


def to_wav(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes of the text in UTF-8, media (the WAV file)."""
    scratch.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))

    def stored(batches):
        for batch in batches:
            data = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, data), pa.int64()), pa.array(map(wav_bytes, data), pa.binary())],
                names=["doc_id", "n_bytes", "media"],
            )

    return rows.mapInArrow(stored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def fingerprints(media: DataFrame) -> DataFrame:
    """The rows of to_wav with payload (the samples read back), times and codes of the peak pairs."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def read(blob):
        try:
            data = samples(blob)
        except (TypeError, EOFError, wave.Error):
            return None, None, None
        return data, *landmark_pairs(data)

    def heard(batches):
        for batch in batches:
            payload, times, codes = zip(*map(read, batch.column("media").to_pylist())) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(payload, pa.binary()), pa.array(times, pa.list_(pa.int32())), pa.array(codes, pa.list_(pa.int32()))],
                names=[*batch.schema.names, "payload", "times", "codes"],
            )

    rows = media.select("doc_id", "n_bytes", "media")
    return rows.mapInArrow(heard, f"doc_id {kind}, n_bytes long, media binary, payload binary, times array<int>, codes array<int>")


def digests(found: DataFrame) -> DataFrame:
    """Digest columns of fingerprints' rows, computed by Spark from the stored and read bytes.

    feature: number of pairs, last start frame, and the first 16 hex digits of a SHA-256 over times and codes.
    """
    arrays = F.concat_ws(";", F.array_join("times", ","), F.array_join("codes", ","))
    feature = F.concat_ws(":", F.size("times"), F.coalesce(F.try_element_at("times", F.lit(-1)), F.lit(-1)), F.substring(F.sha2(arrays, 256), 1, 16))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, octet_length(payload) - {BLOCK - 1}, {BLOCK})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
        F.size("times").cast("long").alias("n_pairs"),
    )

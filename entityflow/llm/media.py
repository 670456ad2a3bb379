"""Media columns: texts as 8-bit WAV, spectral-peak pair fingerprints (operator 5)."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entityflow.shipping import map_arrow

from . import words as W

UNIT = 192
RATE = 8000
#: Short-time Fourier transform: frame and step in samples, local peaks a frame keeps, frames a peak is paired with.
FRAME, STEP, PEAKS, AHEAD = 384, 192, 3, 2
_FRAMES_AT_ONCE = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_payload(data: bytes) -> bytes:
    """The bytes with spaces appended up to a positive multiple of UNIT."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(rate)
        file.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono WAV, read by the wave module."""
    with wave.open(io.BytesIO(media), "rb") as file:
        if file.getsampwidth() != 1 or file.getnchannels() != 1:
            raise ValueError("8-bit mono is expected")
        return file.readframes(file.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of spectral peaks: the PEAKS strongest local maxima of each frame's magnitudes,
    ties by the lower bin. The last frame is filled with the middle level; frames go in blocks."""
    n = max(1, -(-(len(samples) - FRAME) // STEP) + 1)
    filled = np.full((n - 1) * STEP + FRAME, 128, dtype=np.uint8)
    filled[: len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(filled, FRAME)[::STEP]
    times, bins = [], []
    for at in range(0, n, _FRAMES_AT_ONCE):
        part = (frames[at : at + _FRAMES_AT_ONCE].astype(np.float32) - 128) * _WINDOW
        power = np.abs(np.fft.rfft(part, axis=1))[:, 1:].astype(np.float32)
        power = np.round(np.log1p(power) * 64).astype(np.int32)
        local = np.zeros(power.shape, dtype=bool)
        local[:, 1:-1] = (power[:, 1:-1] > power[:, :-2]) & (power[:, 1:-1] >= power[:, 2:])
        score = np.where(local, power * 512 - np.arange(power.shape[1]), -(1 << 30))
        best = np.argpartition(-score, PEAKS, axis=1)[:, :PEAKS]
        best = np.sort(np.where(np.take_along_axis(score, best, axis=1) > -(1 << 30), best + 1, 0), axis=1)
        row, col = np.nonzero(best)
        times.append(row + at)
        bins.append(best[row, col])
    return np.concatenate(times), np.concatenate(bins)


def fingerprints(samples: np.ndarray) -> np.ndarray:
    """Pairs of a peak with each higher peak of its frame and each peak of the AHEAD frames after: time << 32 | bin << 16 |
    other bin << 4 | distance in frames, in ascending order."""
    time, bin_ = peaks(samples)
    first = np.arange(1, len(time) + 1)
    last = np.searchsorted(time, time + AHEAD + 1)
    size = last - first
    a = np.repeat(np.arange(len(time)), size)
    b = first[a] + np.arange(len(a)) - np.repeat(np.cumsum(size) - size, size)
    return np.sort(time[a].astype(np.int64) << 32 | bin_[a].astype(np.int64) << 16 | bin_[b].astype(np.int64) << 4 | (time[b] - time[a]).astype(np.int64))


_COLUMNS = {"media": "media binary", "fingerprints": "fingerprints array<long>"}


def media_columns(docs: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("media", "fingerprints")) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32 (of the last
    16 payload bytes), media_bytes, media_sha256, n_frames, n_pairs, feature (SHA-256 of the
    fingerprints as little-endian 64-bit numbers), and as asked for in keep the WAV file and the
    time-coded fingerprints.

    The text's UTF-8 bytes, with spaces to a positive multiple of UNIT, are the samples; all figures
    are of the samples read back from the stored file. Null is an empty text. Equal texts give equal
    values; repeated rows are judged alike; no rows give no rows; other columns are not read.
    """
    extra = [k for k in _COLUMNS if k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in W.slices(whole, "text", W.SLICE_BYTES):
                data, offsets = W.buffers(batch.column("text"))
                raw = data.tobytes()
                out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "n_pairs", "feature", *extra)}
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    media = to_wav(to_payload(raw[a:b]))
                    payload = from_wav(media)
                    pairs = fingerprints(np.frombuffer(payload, dtype=np.uint8))
                    values = {
                        "n_bytes": b - a, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(),
                        "n_frames": max(1, len(payload) // STEP - 1), "n_pairs": len(pairs), "feature": hashlib.sha256(pairs.astype("<i8").tobytes()).hexdigest(), "media": media, "fingerprints": pairs,
                    }
                    for k in out:
                        out[k].append(values[k])
                kinds = {"payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string(), "media": pa.binary(), "fingerprints": pa.list_(pa.int64())}
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items())], ["doc_id", *out])

    read = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = read.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, n_pairs long, feature string"
    return map_arrow(read, run, ", ".join([schema, *(_COLUMNS[k] for k in extra)]))

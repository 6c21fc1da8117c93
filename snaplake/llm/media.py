"""Media columns: texts' bytes kept as 8-bit WAV sound, read by the wave module, with spectral-peak pair fingerprints.

The sounds are a binary column of a table written to the shared folder; features are computed from what is read back from it.

The samples of a document are its UTF-8 bytes, filled up with bytes 255 to a positive multiple of FRAME.  A short-time
Fourier transform with frames of FRAME samples gives, for each frame, the strongest bin of each of BANDS bands.  A peak is
a band's bin that isn't weaker than those of the band in the frames beside it; each frame keeps its PEAKS strongest.  Every peak is
paired with the next FAN peaks within REACH frames.  A pair is stored at the anchor's frame number (its time code) as
(first bin * 512 + second bin) * 32 + frames between.

Nulls and edge cases: a null text is an empty one; a null id stays null.  Equal texts have equal values.  Of equally strong bins of a band, and of
equally strong bands of a frame, the lower one counts.  Frames are handled in blocks, so memory doesn't grow with a text beyond its own
bytes.  An empty table gives an empty one.  Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, materialize, text_chunks

FRAME, RATE, BANDS, PEAKS, FAN, REACH, BLOCK = 576, 8000, 6, 2, 2, 15, 4096
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pair_times array<int>, pair_codes array<int>"


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((-len(raw)) % FRAME if raw else FRAME), len(raw)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("one channel of 8-bit samples is expected")
        return r.readframes(r.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)
_WIDTH = (FRAME // 2) // BANDS


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin of each band in each frame, and how strong it is."""
    bins, power = [], []
    for at in range(0, len(samples), FRAME * BLOCK):
        frames = samples[at : at + FRAME * BLOCK].reshape(-1, FRAME).astype(np.float32) - np.float32(128)
        spectrum = np.abs(np.fft.rfft(frames * _WINDOW, axis=1))[:, 1 : 1 + BANDS * _WIDTH].reshape(len(frames), BANDS, _WIDTH)
        best = spectrum.argmax(axis=2)
        bins.append(best + 1 + np.arange(BANDS) * _WIDTH)
        power.append(np.take_along_axis(spectrum, best[:, :, None], 2)[:, :, 0])
    return np.concatenate(bins), np.concatenate(power)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time codes, pair codes) of the sound, in time order."""
    bins, power = band_peaks(samples)
    before = np.vstack([np.zeros((1, BANDS)), power[:-1]])
    after = np.vstack([power[1:], np.zeros((1, BANDS))])
    rank = np.argsort(np.argsort(-power, axis=1, kind="stable"), axis=1, kind="stable")
    t, band = np.nonzero((power >= before) & (power >= after) & (rank < PEAKS) & (power > 0))
    f = bins[t, band]
    times, codes, order = [], [], []
    for k in range(1, FAN + 1):
        gap = t[k:] - t[:-k]
        near = np.nonzero(gap <= REACH)[0]
        times.append(t[near])
        codes.append((f[near] * 512 + f[near + k]) * 32 + gap[near])
        order.append(near * FAN + k)
    by = np.argsort(np.concatenate(order), kind="stable")
    return np.concatenate(times)[by].astype(np.int32), np.concatenate(codes)[by].astype(np.int32)


def _batches(columns: Iterable[tuple[pa.RecordBatch, list[tuple]]], kinds: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    for rows, found in columns:
        cols = list(zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(text: str | None) -> tuple[int, bytes]:
        payload, n = padded(text)
        return n, to_wav(payload)

    yield from _batches(((rows, [made(t) for t in texts]) for rows, texts in text_chunks(batches)), [pa.int64(), pa.binary()], ["n_bytes", "media"])


def describe(n: int, media: bytes) -> tuple:
    back = from_wav(media)
    times, codes = fingerprint(np.frombuffer(back, np.uint8))
    feature = f"{len(times)}:{hashlib.sha1(times.tobytes() + codes.tobytes()).hexdigest()}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, times, codes


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pair_times", "pair_codes"]
    found = ((rows, [describe(n, m) for n, m in zip(rows.column("n_bytes").to_pylist(), media, strict=True)]) for rows, media in text_chunks(batches, "media"))
    yield from _batches(found, kinds, names)


def media_table(docs: DataFrame) -> DataFrame:
    """The written table (doc_id, n_bytes, media) of docs (doc_id, text): each text's sound as a WAV file in a binary column."""
    bounded_batches(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return materialize(rows.mapInArrow(_store, "doc_id long, n_bytes long, media binary"), "media")


def media_features(stored: DataFrame) -> DataFrame:
    """Sizes and digests of each stored sound (doc_id, n_bytes, media) and its fingerprint as time-coded arrays."""
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_features, SCHEMA)


def media_columns(docs: DataFrame) -> DataFrame:
    """media_features of the sounds that are written for docs."""
    return media_features(media_table(docs))

"""Media columns: bytes as WAV, spectra by short-time Fourier transform, and
spectral-peak pair fingerprints as time-coded arrays.

A payload is stored as unsigned 8-bit mono samples by the wave module, in a
table in the shared folder, and everything else is computed from the bytes that
are read back from there.  Each frame's strongest bin in each of three bands
is a peak where no neighbouring frame is stronger in that band; each peak is
paired with the next few, and a pair is (time of the first, code of the two
bins and their distance).
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import documents, materialize, prepare

FRAME, HOP, RATE = 256, 128, 8000
#: Bands of bins, first and last plus one; bin 0 is the mean and is left out.
BANDS = ((1, 20), (20, 60), (60, 129))
#: A peak is paired with so many later peaks, at most so many frames apart.
FAN, REACH = 3, 63
#: Frames transformed at once.
FRAMES_AT_ONCE = 4096

STORED = "doc_id long, n_bytes long, media binary"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, times array<int>, codes array<int>"


def padded(raw: bytes, unit: int = 64) -> bytes:
    """raw and zero bytes up to a positive multiple of unit."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Strongest bin and its power, by frame and band."""
    x = samples.astype(np.float32) - 128
    if len(x) < FRAME:
        x = np.pad(x, (0, FRAME - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    hann = np.hanning(FRAME).astype(np.float32)
    bins, power = [], []
    for k in range(0, len(frames), FRAMES_AT_ONCE):
        spectrum = np.fft.rfft(frames[k : k + FRAMES_AT_ONCE] * hann, axis=1)
        strength = spectrum.real**2 + spectrum.imag**2
        best = [a + np.argmax(strength[:, a:b], axis=1) for a, b in BANDS]
        bins.append(np.stack(best, 1))
        power.append(np.take_along_axis(strength, bins[-1], 1))
    return np.concatenate(bins), np.concatenate(power)


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of the pairs of spectral peaks, in order of time."""
    bins, power = band_peaks(samples)
    low = np.full((1, len(BANDS)), -1.0)
    around = np.concatenate([low, power, low])
    time, band = np.nonzero((power >= around[:-2]) & (power > around[2:]) & (power > 0))
    f = bins[time, band]
    times, codes = [], []
    for step in range(1, FAN + 1):
        apart = time[step:] - time[:-step]
        near = apart <= REACH
        times.append(time[:-step][near])
        codes.append((f[:-step][near] << 16) | (f[step:][near] << 8) | apart[near])
    t, c = np.concatenate(times).astype("<i4"), np.concatenate(codes).astype("<i4")
    order = np.lexsort((c, t))
    return t[order], c[order]


def stored_media(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes of the text, and its payload as a WAV file, written to the shared folder."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array((to_wav(padded(x)) for x in raw), pa.binary())], ["doc_id", "n_bytes", "media"])

    return materialize(documents(docs).select("doc_id", F.col("text").cast("binary").alias("raw")).mapInArrow(run, STORED), "media")


def media_columns(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, digests of payload and media, feature, media, times, codes.

    ``feature`` is the number of peak pairs and a digest of their times and
    codes.  Null text counts as empty: a payload of 64 zero bytes, which has no
    peak.  Null doc_ids and repeated rows are rows like others, and equal texts
    have equal values; an empty table gives an empty result.  There is no
    shuffle.
    """

    def run(batches):
        for batch in batches:
            rows = [[] for _ in range(8)]
            for media in batch.column(2).to_pylist():
                payload = from_wav(media)
                times, codes = fingerprint(np.frombuffer(payload, np.uint8))
                mark = hashlib.sha256(times.tobytes() + codes.tobytes()).hexdigest()[:32]
                values = [len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(times)}:{mark}", times, codes]
                for column, value in zip(rows, values):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            found = [pa.array(x, k) for x, k in zip(rows, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found[:6], batch.column(2), *found[6:]], [x.split()[0] for x in SCHEMA.split(", ")])

    return stored_media(docs).mapInArrow(run, SCHEMA)

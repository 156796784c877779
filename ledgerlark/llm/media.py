"""Media columns: WAV bytes, short-time Fourier transforms, peak fingerprints.

A payload becomes an 8-bit mono WAV file in a binary column.  Reading goes
through the ``wave`` module; frames of the samples are transformed, the
strongest peak of each band of a frame is kept, and pairs of peaks in one
frame and in neighbouring frames become hashes with their time, the
fingerprint of a recording.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE = 8000
#: Payloads are padded with spaces to a positive multiple of this.
UNIT = 192
#: The shortest payload has five frames.
FRAME, HOP, PEAKS, FAN_OUT = 64, 32, 2, 2
#: Share of a frame's loudest peak under which the peak of a band is leakage of the other (-20 dB).
AUDIBLE = 0.1
#: Frames transformed at once, so that a long recording takes bounded memory.
FRAMES_AT_ONCE = 2048
#: Rows handled at once inside an Arrow batch.
ROWS_AT_ONCE = 256


def payload(text: Column) -> Column:
    """UTF-8 bytes of a text (null: empty) with bytes 32 up to a positive multiple of ``UNIT``."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    n = F.octet_length(text)
    whole = F.greatest(F.lit(UNIT), F.ceil(n / UNIT).cast("int") * UNIT)
    return F.encode(F.concat(text, F.repeat(F.lit(" "), whole - n)), "utf-8")


def wav_bytes(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def wav_samples(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of an 8-bit mono WAV."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not an 8-bit mono WAV")
        return w.readframes(w.getnframes()), w.getframerate()


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, loudness): the strongest local peak of each band, for each frame.

    Frames of ``FRAME`` samples every ``HOP``; the last is filled with
    silence.  A frame's mean is taken off first, as the window would spread it
    over the lowest bin.  The spectrum is split into ``PEAKS`` bands of equal
    width.
    """
    frames = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    window = np.hanning(FRAME).astype(np.float32)
    bins, loud = [], []
    for a in range(0, frames, FRAMES_AT_ONCE):
        n = min(FRAMES_AT_ONCE, frames - a)
        part = np.full((n - 1) * HOP + FRAME, 128, np.uint8)
        own = samples[a * HOP : a * HOP + len(part)]
        part[: len(own)] = own
        at = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        wave_form = at.astype(np.float32)
        wave_form -= wave_form.mean(1, keepdims=True)
        power = np.abs(np.fft.rfft(wave_form * window, axis=1))[:, 1:]
        bands = power[:, : PEAKS * (power.shape[1] // PEAKS)].reshape(n, PEAKS, -1)
        top = bands.argmax(2)
        bins.append(top + np.arange(PEAKS) * bands.shape[2] + 1)
        loud.append(np.take_along_axis(bands, top[:, :, None], 2)[:, :, 0])
    return np.concatenate(bins), np.concatenate(loud)


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded hashes of peak pairs: (frame << 32) | (bin << 20) | (later bin << 8) | distance.

    Every kept peak is paired with the other ones of its frame (distance 0)
    and with those of the next ``FAN_OUT`` frames.  The only peak of a
    recording of one frame is paired with itself.
    """
    if not samples:
        return np.empty(0, np.int64)
    bins, loud = spectral_peaks(np.frombuffer(samples, np.uint8))
    bins, heard = bins.astype(np.int64), loud >= AUDIBLE * loud.max(1, keepdims=True)
    pairs = []
    for d in range(FAN_OUT + 1):
        t = np.arange(max(0, len(bins) - d), dtype=np.int64)
        for i in range(PEAKS):
            for j in range(PEAKS) if d else range(i + 1, PEAKS):
                both = heard[: len(t), i] & heard[d:, j]
                pairs.append(((t << 32) | (bins[: len(t), i] << 20) | (bins[d:, j] << 8) | d)[both])
    if len(bins) == 1 and heard.sum() == 1:
        pairs.append((bins[heard] << 20) | (bins[heard] << 8))
    return np.sort(np.concatenate(pairs))


def with_wav(df: DataFrame, payload_col: str = "payload", media_col: str = "media") -> DataFrame:
    """``df`` with ``payload_col`` (binary) replaced by its WAV file in ``media_col``.  A null payload is an empty recording."""
    at, names = df.columns.index(payload_col), [media_col if c == payload_col else c for c in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                media = pa.array([wav_bytes(x.as_py() or b"") for x in part.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([media if k == at else c for k, c in enumerate(part.columns)], names)

    schema = ", ".join(f"`{n}` {t}" for n, (_, t) in zip(names, df.dtypes, strict=True))
    return df.mapInArrow(run, schema)


def with_features(df: DataFrame, media_col: str = "media") -> DataFrame:
    """``df`` and what its WAV files hold: samples binary, sample_rate int, fingerprint array<long>.

    Defined cases: a null file gives nulls; a recording without samples has
    an empty fingerprint; other columns pass through, those named like the
    added ones are replaced.
    """
    df = df.drop("samples", "sample_rate", "fingerprint")
    at, names = df.columns.index(media_col), [*df.columns, "samples", "sample_rate", "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                read = [wav_samples(m) if (m := x.as_py()) is not None else (None, None) for x in part.column(at)]
                marks = [None if s is None else fingerprint(s) for s, _ in read]
                added = [pa.array([s for s, _ in read], pa.binary()), pa.array([r for _, r in read], pa.int32()), pa.array(marks, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names)

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return df.mapInArrow(run, f"{schema}, samples binary, sample_rate int, fingerprint array<bigint>")

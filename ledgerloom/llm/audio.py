"""Audio columns: lossless 8-bit media, polyphase resampling, log-mel frames, hysteresis segments.

``store`` writes bytes as 8-bit mono WAV; ``features`` reads such a file back, resamples it by a polyphase
filter, takes overlapped log-mel frames, finds spans of high energy with two thresholds, and cuts the
frames into patches of one fixed shape. Patches travel as an Arrow fixed-shape tensor column with their
time spans, in Arrow's stream format. Frames are made in blocks; samples, resampled samples and frames' results are held
whole, so a medium needs some 24 bytes of memory for each of its own while it is worked on, whatever its length.

Null texts count as empty; an empty payload is one block of zeros. Equal texts have equal values; the
sums are taken in double precision and rounded. Frames exactly at a threshold neither open nor close a segment. Repeated rows
stay; an empty table gives an empty one. Result columns replace columns of the same names, all others are kept.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import whole

BLOCK = 64
RATE = 16_000
#: Resampling by 3/4, to 12 kHz; taps on either side of a phase's centre.
UP, DOWN, HALF = 3, 4, 12
FRAME, HOP, MELS = 256, 128, 32
#: Frames of a patch.
PATCH = 64
#: A segment begins this many dB over the mean frame energy and ends this many under it.
RISE_DB, FALL_DB = 1.0, 0.5
FRAMES_AT_ONCE = 4096


def payload(text: str) -> bytes:
    data = text.encode("utf-8", "surrogatepass")
    return data.ljust(max(1, -(-len(data) // BLOCK)) * BLOCK, b"\0")


def store(data: bytes) -> bytes:
    """The bytes as samples of a WAV file."""
    file = io.BytesIO()
    with wave.open(file, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(1)
        out.setframerate(RATE)
        out.writeframes(data)
    return file.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


@functools.cache
def phases() -> list[tuple[int, np.ndarray]]:
    """For each output sample modulo UP: its first input sample and its taps (a windowed sinc's phase)."""
    width = HALF * UP
    at = np.arange(-width, width + 1)
    cut = 1 / max(UP, DOWN)
    taps = UP * cut * np.sinc(at * cut) * np.hanning(2 * width + 3)[1:-1]
    found = []
    for r in range(UP):
        first, phase = divmod(r * DOWN, UP)
        own = np.zeros(2 * HALF + 1)
        for k in range(-HALF, HALF + 1):  # input first + k stands at k * UP - phase of the filter
            if abs(k * UP - phase) <= width:
                own[k + HALF] = taps[k * UP - phase + width]
        found.append((first, own))
    return found


def resample(x: np.ndarray) -> np.ndarray:
    """UP/DOWN times as many samples; silence beyond either end."""
    n = -(-len(x) * UP // DOWN)
    padded = np.concatenate([np.zeros(HALF), x, np.zeros(HALF + DOWN)])
    out = np.empty(n)
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * HALF + 1)
    for r, (first, taps) in enumerate(phases()):
        own = out[r::UP]
        for at in range(0, len(own), 1 << 16):
            part = windows[first + at * DOWN : first + min(at + (1 << 16), len(own)) * DOWN : DOWN]
            own[at : at + len(part)] = part @ taps
    return out


@functools.cache
def mel_weights() -> np.ndarray:
    """Triangles, evenly spaced in mel from 0 to half the rate."""
    top = RATE * UP / DOWN / 2
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(top), MELS + 2) / 2595) - 1)
    f = np.linspace(0, top, FRAME // 2 + 1)
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None)


def log_mels(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapped frames: log mel energies, and each frame's energy in dB."""
    x = np.concatenate([x, np.zeros(max(0, FRAME - len(x)))])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, mels, energy = np.hanning(FRAME), [], []
    for at in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[at : at + FRAMES_AT_ONCE]
        power = np.abs(np.fft.rfft(part * window)) ** 2
        mels.append(np.log(power @ mel_weights() + 1e-8))
        energy.append(10 * np.log10((part * part).mean(axis=1) + 1e-8))
    return np.round(np.concatenate(mels), 3), np.round(np.concatenate(energy), 3)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames that begin above the higher threshold and last to the lower one."""
    mean = np.round(energy.mean(), 3)
    vote = np.where(energy > mean + RISE_DB, 1, np.where(energy < mean - FALL_DB, -1, 0))
    last = np.maximum.accumulate(np.where(vote != 0, np.arange(len(vote)), -1))
    on = np.where(last >= 0, vote[last], -1) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


@dataclass(frozen=True)
class Features:
    mels: np.ndarray
    spans: list[tuple[float, float]]

    def tensors(self) -> bytes:
        """An Arrow stream: one fixed-shape tensor for each patch, with its start and end in seconds."""
        n = -(-len(self.mels) // PATCH)
        padded = np.zeros((n * PATCH, MELS), np.float32)
        padded[: len(self.mels)] = self.mels
        step = HOP * DOWN / UP / RATE
        starts = np.arange(n) * PATCH * step
        ends = np.minimum((np.arange(n) + 1) * PATCH, len(self.mels)) * step
        batch = pa.record_batch({"start_s": starts, "end_s": ends, "log_mel": pa.FixedShapeTensorArray.from_numpy_ndarray(padded.reshape(n, PATCH, MELS))})
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, batch.schema) as stream:
            stream.write_batch(batch)
        return out.getvalue().to_pybytes()

    def summary(self) -> str:
        """Frames, segments and their seconds, mean log mel energies."""
        means = ",".join(f"{v:.3f}" for v in self.mels.mean(axis=0) + 0.0)
        return f"{len(self.mels)}|{len(self.spans)}|{sum(e - s for s, e in self.spans):.3f}|{means}"


def features(media: bytes) -> Features:
    samples = (np.frombuffer(load(media), np.uint8).astype(np.float64) - 128) / 128
    mels, energy = log_mels(resample(samples))
    step = HOP * DOWN / UP / RATE
    return Features(mels, [(s * step, e * step) for s, e in segments(energy)])


def audio_columns(docs: DataFrame, text: str = "text", out: str = "audio") -> DataFrame:
    """``docs`` with a struct of the medium, its tensors and its segments under ``out``, which replaces a column of that name."""

    @F.pandas_udf("media binary, tensors binary, segments array<struct<start_s:double,end_s:double>>")
    def make(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = features(media := store(payload(t)))
            rows.append((media, found.tensors(), [{"start_s": s, "end_s": e} for s, e in found.spans]))
        return pd.DataFrame(rows, columns=["media", "tensors", "segments"])

    return docs.withColumn(out, make(whole(text)))


def audio_report_column(text: Column | str) -> Column:
    @F.pandas_udf("n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_patches bigint, tensors_sha256 string")
    def report(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            media = store(payload(t))
            back, found = load(media), features(media)
            rows.append((len(t.encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), found.summary(), -(-len(found.mels) // PATCH), hashlib.sha256(found.tensors()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_patches", "tensors_sha256"])

    return report(whole(text))


def audio_report(docs: DataFrame) -> DataFrame:
    """Per document the digests of its payload and medium, and its features."""
    return docs.select("doc_id", audio_report_column("text").alias("r")).select("doc_id", "r.*")

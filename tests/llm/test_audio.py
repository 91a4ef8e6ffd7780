import hashlib
import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import audio


def test_round_trip_and_resampling():
    data = bytes(range(256)) * 3
    assert audio.load(audio.store(data)) == data
    assert audio.payload("") == bytes(64) and len(audio.payload("é" * 32)) == 64 and len(audio.payload("a" * 65)) == 128
    x = np.random.default_rng(1).normal(size=400)
    got = audio.resample(x)
    width, cut = audio.HALF * audio.UP, 1 / max(audio.UP, audio.DOWN)
    window = np.hanning(2 * width + 3)[1:-1]
    for n in range(0, len(got), 7):  # the plain form: zeros between samples, filter, every DOWN-th
        want = 0.0
        for i in range(len(x)):
            k = n * audio.DOWN - i * audio.UP
            if abs(k) <= width:
                want += x[i] * audio.UP * cut * np.sinc(k * cut) * window[width - k]
        assert abs(got[n] - want) < 1e-9
    tone = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    made = audio.resample(tone)[100:-100]
    assert abs(np.abs(np.fft.rfft(made)).argmax() * 12000 / len(made) - 440) < 2 and abs(made.max() - 1) < 0.02


def test_segments():
    rng = np.random.default_rng(2)
    for _ in range(50):
        energy = np.round(rng.normal(size=60) * 2, 3)
        mean, on, want = np.round(energy.mean(), 3), False, []
        for i, e in enumerate(energy):
            if not on and e > mean + audio.RISE_DB:
                on, start = True, i
            elif on and e < mean - audio.FALL_DB:
                on = False
                want.append((start, i))
        assert audio.segments(energy) == want + ([(start, len(energy))] if on else [])


def test_report(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    for r in audio.audio_report(docs).collect():
        data = texts[r.doc_id]
        padded = data + bytes(-len(data) % 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_bytes == len(padded) + 44


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "ab" * 200_000, 0), (3, "same", 0), (3, "same", 0)], "doc_id bigint, text string, audio int")
    rows = audio.audio_report(docs).collect()
    assert len({r.feature for r in rows if r.doc_id == 3}) == 1 and len({r.media_sha256 for r in rows if r.doc_id in (1, None)}) == 1
    made = audio.audio_columns(docs).select("audio.*").collect()
    batch = pa.ipc.open_stream(io.BytesIO(made[2].tensors)).read_all()
    assert batch.schema.field("log_mel").type.shape == [audio.PATCH, audio.MELS] and batch.num_rows == len(batch["start_s"])
    assert audio.audio_report(docs.filter(F.lit(False))).count() == 0


def plain_features(data):
    """Samples, frames, mel energies and segments with one loop each, as the docstring says."""
    x = [(b - 128) / 128 for b in data]
    width, cut = audio.HALF * audio.UP, 1 / max(audio.UP, audio.DOWN)
    window = np.hanning(2 * width + 3)[1:-1]
    y = []
    for n in range(-(-len(x) * audio.UP // audio.DOWN)):
        total = 0.0
        for i in range(max(0, (n * audio.DOWN - width) // audio.UP), min(len(x), (n * audio.DOWN + width) // audio.UP + 1)):
            k = n * audio.DOWN - i * audio.UP
            if abs(k) <= width:
                total += x[i] * audio.UP * cut * np.sinc(k * cut) * window[width - k]
        y.append(total)
    y += [0.0] * max(0, audio.FRAME - len(y))
    rate = audio.RATE * audio.UP / audio.DOWN
    edge = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), audio.MELS + 2)]
    mels, energy = [], []
    for at in range(0, len(y) - audio.FRAME + 1, audio.HOP):
        part = np.array(y[at : at + audio.FRAME])
        n = np.arange(audio.FRAME)
        row = np.zeros(audio.MELS)
        for k in range(audio.FRAME // 2 + 1):
            power = abs(np.sum(part * np.hanning(audio.FRAME) * np.exp(-2j * np.pi * k * n / audio.FRAME))) ** 2
            f = k * rate / audio.FRAME
            for m in range(audio.MELS):
                low, mid, high = edge[m : m + 3]
                row[m] += power * max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid)))
        mels.append([round(float(v), 3) for v in np.log(row + 1e-8)])
        energy.append(round(10 * np.log10(np.mean(part * part) + 1e-8), 3))
    mean, start, spans, step = round(float(np.mean(energy)), 3), None, [], audio.HOP / rate
    for i, e in enumerate(energy):
        if start is None and e > mean + audio.RISE_DB:
            start = i
        elif start is not None and e < mean - audio.FALL_DB:
            spans.append((start * step, i * step))
            start = None
    return mels, spans + ([(start * step, len(energy) * step)] if start is not None else [])


def test_features_tensors_and_spans_equal_the_plain_ones(spark):
    rng = np.random.default_rng(5)
    texts = ["", "short", "loud ~~~~~~ and quiet " * 20, "".join(chr(rng.integers(32, 127)) for _ in range(1500)) + " " * 700 + "~!" * 500, "é漢 " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    reports = {r.doc_id: r for r in audio.audio_report(docs).collect()}
    for r in audio.audio_columns(docs).collect():
        data = texts[r.doc_id].encode()
        mels, spans = plain_features(data + bytes(-len(data) % 64 if data else 64))
        frames, found, seconds, means = reports[r.doc_id].feature.split("|")
        assert (int(frames), int(found)) == (len(mels), len(spans)) and abs(float(seconds) - sum(b - a for a, b in spans)) < 2e-3
        assert np.allclose([float(v) for v in means.split(",")], np.mean(mels, axis=0), atol=2e-3)
        assert np.allclose([(s.start_s, s.end_s) for s in r.audio.segments], spans) if spans else r.audio.segments == []
        batch = pa.ipc.open_stream(io.BytesIO(r.audio.tensors)).read_all()
        patches = batch["log_mel"].combine_chunks().to_numpy_ndarray()
        n = -(-len(mels) // audio.PATCH)
        assert patches.shape == (n, audio.PATCH, audio.MELS) and reports[r.doc_id].n_patches == n
        flat = patches.reshape(-1, audio.MELS)
        assert np.allclose(flat[: len(mels)], mels, atol=2e-3) and not flat[len(mels) :].any()
        step = audio.HOP * audio.DOWN / audio.UP / audio.RATE
        assert np.allclose(batch["start_s"], [i * audio.PATCH * step for i in range(n)]) and np.allclose(batch["end_s"], [min((i + 1) * audio.PATCH, len(mels)) * step for i in range(n)])

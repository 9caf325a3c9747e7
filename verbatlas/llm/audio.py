"""Media columns: audio stored losslessly in WAV, and log-mel features with time spans.

A payload of 8-bit samples is wrapped in a mono WAV file and read back. Features: polyphase
resampling by UP/DOWN with a windowed-sinc filter, overlapped frames, a log-mel filterbank, and
segments of speech-like energy by hysteresis (a segment opens above the higher level and closes
below the lower one). The log-mel frames are stored as Arrow tensors of fixed shape, (FRAMES, MELS),
each with its time span; the last is padded with the lowest level. They are an Arrow IPC stream in a
binary column (``packed``), as Spark has no tensor type; the features are computed from what is read back
from it (``unpacked``).

Everything is computed from one text's bytes alone, in pieces of fixed size, so equal texts have
equal values; a text's frames and tensors take memory in proportion to it (about its own size), the
resampled signal and its spectra a fixed amount.

Defined results: a null or empty text is one unit of padding. A signal whose frames all have one level
(such as padding alone) has no segment. Repeated rows repeat; an empty table gives an empty result; columns
with the names of the new ones are replaced.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts

#: A payload's size is a multiple of this many bytes; the padding's value.
UNIT, PAD = 576, 255
RATE, UP, DOWN, TAPS = 8000, 3, 4, 12
NEW_RATE = RATE * UP // DOWN
WINDOW, HOP, MELS = 256, 128, 20
#: Frames in a tensor; resampled samples computed at once.
FRAMES, PIECE = 32, 1 << 17
#: Levels of the hysteresis, as shares of the way from the quietest to the loudest frame's mean level; the lowest level in dB.
OPEN_AT, CLOSE_AT, FLOOR_DB = 0.6, 0.4, -100.0


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    units = max(1, -(-len(raw) // UNIT))
    return raw.ljust(units * UNIT, bytes([PAD])), len(raw)


def stored(payload: bytes) -> bytes:
    """A WAV file: one channel, unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_back(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def phases() -> np.ndarray:
    """The low-pass filter, a row of taps for each of the UP phases."""
    n = 2 * TAPS * UP + 1
    t = np.arange(n) - n // 2
    h = np.sinc(t / max(UP, DOWN)) * np.hamming(n) * UP / max(UP, DOWN)
    h = np.append(h, np.zeros(-len(h) % UP))
    return h.reshape(-1, UP).T[:, ::-1].copy()


def mel_bank() -> np.ndarray:
    """Triangular filters of equal width on the mel scale, one row for each."""
    edges = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + NEW_RATE / 2 / 700), MELS + 2) / 2595) - 1)
    f = np.linspace(0, NEW_RATE / 2, WINDOW // 2 + 1)
    up = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


PHASES, BANK, HANN = phases(), mel_bank(), np.hanning(WINDOW + 1)[:-1]


def resampled(x: np.ndarray, start: int, count: int) -> np.ndarray:
    """Samples start..start+count of the signal resampled by UP/DOWN; zero outside the signal.

    Sample m stands at m * DOWN in the upsampled signal: its phase picks the taps, so only the
    products that are not zero are computed.
    """
    m = np.arange(start, start + count) * DOWN
    taps = PHASES.shape[1]
    first = (m + TAPS * UP) // UP - taps + 1  # the filter's middle stands over the sample
    lo, hi = int(first[0]), int(first[-1]) + taps
    part = np.zeros(hi - lo, np.float64)
    a, b = max(lo, 0), min(hi, len(x))
    if a < b:
        part[a - lo : b - lo] = (x[a:b].astype(np.float64) - 128) / 128
    phase, out = (m + TAPS * UP) % UP, np.empty(count)
    rows = np.lib.stride_tricks.sliding_window_view(part, taps)
    for p in range(UP):
        at = np.flatnonzero(phase == p)
        if len(at):
            out[at] = rows[first[at] - lo] @ PHASES[p]
    return out


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames of log-mel levels in dB, one row for each HOP of the resampled signal."""
    total = -(-len(x) * UP // DOWN)
    n = max(1, -(-(total - WINDOW) // HOP) + 1)
    per, out = (PIECE - WINDOW) // HOP + 1, []
    for at in range(0, n, per):
        k = min(per, n - at)
        y = resampled(x, at * HOP, (k - 1) * HOP + WINDOW)
        frames = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP] * HANN
        power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
        out.append(10 * np.log10(np.maximum(power @ BANK.T, 10 ** (FLOOR_DB / 10))).astype(np.float32))
    return np.concatenate(out)


def segments(level: np.ndarray) -> list[tuple[int, int]]:
    """[first, last) frames of the runs that rise above the higher level and last until the lower."""
    lo, hi = float(level.min()), float(level.max())
    if lo == hi:
        return []
    above, below = level >= lo + OPEN_AT * (hi - lo), level < lo + CLOSE_AT * (hi - lo)
    event = np.where(above, 1, np.where(below, -1, 0))
    set_at = np.maximum.accumulate(np.where(event != 0, np.arange(len(level)), -1))
    on = (set_at >= 0) & (event[np.maximum(set_at, 0)] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def tensors(mel: np.ndarray) -> np.ndarray:
    """The frames as (n, FRAMES, MELS), the last padded."""
    n = -(-len(mel) // FRAMES)
    out = np.full((n * FRAMES, MELS), FLOOR_DB, np.float32)
    out[: len(mel)] = mel
    return out.reshape(n, FRAMES, MELS)


MS = 1000 * HOP / NEW_RATE  # from one frame to the next
TENSOR = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS), dim_names=["frame", "mel"])


def packed(mel: np.ndarray) -> bytes:
    """The frames as an Arrow IPC stream: a tensor and its span (from_ms, to_ms), which ends with the last frame."""
    parts = tensors(mel)
    at = np.arange(len(parts)) * FRAMES
    values = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(parts.ravel()), FRAMES * MELS))
    batch = pa.RecordBatch.from_arrays([pa.array(at * MS), pa.array(np.minimum(at + FRAMES, len(mel)) * MS), values], names=["from_ms", "to_ms", "mel"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def unpacked(data: bytes) -> pa.Table:
    """(from_ms, to_ms, mel): the tensors of a text."""
    with pa.ipc.open_stream(data) as r:
        return r.read_all()


def frames_of(tensors: pa.Table) -> np.ndarray:
    """The frames again, without the padding of the last tensor."""
    mel = tensors.column("mel").combine_chunks()
    n = round(tensors.column("to_ms")[-1].as_py() / MS)
    return mel.to_numpy_ndarray().reshape(-1, MELS)[:n]


def spans_ms(mel: np.ndarray) -> list[tuple[float, float]]:
    """The segments' beginnings and ends in milliseconds."""
    return [(a * MS, b * MS) for a, b in segments(mel.mean(axis=1, dtype=np.float64))]


def feature(mel: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """A short account: frames, each filter's mean level in tenths of dB, and the number of segments with their time in ms."""
    means = np.rint(mel.mean(axis=0, dtype=np.float64) * 10).astype(int)
    return f"rate={NEW_RATE};frames={len(mel)};mel={','.join(map(str, means))};segments={len(spans)};active_ms={round(sum(b - a for a, b in spans))}"


#: What ``media`` adds: Spark's type of each column.
COLUMNS = {
    "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media": "binary", "mel": "binary", "n_tensors": "long",
    "segments": "array<struct<from_ms:double,to_ms:double>>", "feature": "string",
}


def media(docs: DataFrame) -> DataFrame:
    """``docs`` with media columns computed from ``text``.

    n_bytes, payload_bytes, payload_sha256 and tail_crc32 (of the payload, read back from the file), ``media`` binary (the
    WAV file), ``mel`` binary (the tensors with their time spans, see ``unpacked``), n_tensors, ``segments``
    (from_ms, to_ms) and feature, both from the stored tensors.
    """
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), COLUMNS["segments"]: pa.list_(pa.struct([("from_ms", pa.float64()), ("to_ms", pa.float64())]))}

    def one(text: str | None) -> tuple:
        payload, n = payload_of(text)
        wav = stored(payload)
        back = read_back(wav)
        mel = packed(log_mel(np.frombuffer(back, np.uint8)))
        kept = unpacked(mel)
        frames = frames_of(kept)
        spans = spans_ms(frames)
        own = [{"from_ms": a, "to_ms": b} for a, b in spans]
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), wav, mel, kept.num_rows, own, feature(frames, spans)

    def make():
        return lambda texts: list(zip(*map(one, texts), strict=True))

    return map_texts(docs, "text", {c: types[t] for c, t in COLUMNS.items()}, ", ".join(f"{c} {t}" for c, t in COLUMNS.items()), make)

"""Signals: down-mixing, resampling, chunking and filter-bank features, in numpy over Arrow batches.

What an encoder wants of its audio is a ``Plan``: rate, down-mix, greatest length, chunks, extractor and what counts as
the length. Plans are looked up by the encoder's name, once per query or per row of a routed table.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.audio import HELD, nested

RATE = 16000
#: Weights of a resampling table at most (4 MB).
MOST_WEIGHTS = 1 << 19


def downmix(x: np.ndarray, policy: str = "mean") -> np.ndarray:
    """(channels, samples) to samples by the ``mean`` or the ``first`` channel."""
    if policy not in ("mean", "first"):
        raise ValueError(f"no policy {policy!r}")
    return x[0] if policy == "first" or len(x) == 1 else x.mean(0)


def resample(x: np.ndarray, old: int, new: int, zeros: int = 16) -> np.ndarray:
    """Windowed-sinc interpolation to another rate; the same rate returns the input."""
    return resampled([x], old, new, zeros)[0]


def _weights(d: np.ndarray, cut: float, half: int) -> np.ndarray:
    """Weights of samples at distances ``d``."""
    return cut * np.sinc(cut * d) * np.where(np.abs(d) < half, 0.5 + 0.5 * np.cos(np.pi * d / half), 0)


@lru_cache(16)
def _bank(up: int, down: int, cut: float, half: int) -> np.ndarray:
    """(samples, up) weights of a block: ``up`` outputs stand over ``down`` inputs in the same way in every block."""
    at = np.arange(up) * down
    out = np.zeros((up, at[-1] // up + 2 * half))
    k = np.arange(2 * half)[None]
    out[np.arange(up)[:, None], (at // up)[:, None] + k] = _weights((at % up / up)[:, None] - k + half - 1, cut, half)
    return np.ascontiguousarray(out.T)


def _at_once(x: np.ndarray, old: int, new: int, cut: float, half: int) -> np.ndarray:
    """``resample`` with the weights of every output computed anew, for rates whose blocks are too long for a table."""
    n = math.ceil(len(x) * new / old)
    out = np.zeros(n)
    for lo in range(0, n, 8192):
        at = np.arange(lo, min(n, lo + 8192)) * old / new
        i = np.floor(at).astype(int)[:, None] + np.arange(-half + 1, half + 1)[None]
        out[lo : lo + len(at)] = (np.where((i >= 0) & (i < len(x)), x[np.clip(i, 0, len(x) - 1)], 0) * _weights(at[:, None] - i, cut, half)).sum(1)
    return out


def resampled(signals: list[np.ndarray], old: int, new: int, zeros: int = 16) -> list[np.ndarray]:
    """``resample`` of many signals of one rate: their blocks are products with one table of weights."""
    if old == new:
        return list(signals)
    shared = math.gcd(old, new)
    up, down, cut = new // shared, old // shared, min(1.0, new / old)
    half = math.ceil(zeros / cut)
    together = max(1, 2 * half // down)  # else blocks of a few samples would copy each of them many times
    up, down = up * together, down * together
    width = (up - 1) * down // up + 2 * half
    if up * width > MOST_WEIGHTS or not all(np.isfinite(x).all() for x in signals):  # what isn't finite must not spread over a block
        return [_at_once(x, old, new, cut, half) if len(x) else x for x in signals]
    sizes = [math.ceil(len(x) * new / old) for x in signals]
    blocks = np.array([-(-n // up) for n in sizes], int)
    held = np.where(blocks > 0, (blocks - 1) * down + width, 0)
    begin, first = np.cumsum(held) - held, np.cumsum(blocks) - blocks
    stream = np.zeros(max(int(held.sum()), width))
    for x, lo in zip(signals, begin):
        stream[lo + half - 1 : lo + half - 1 + len(x)] = x
    starts = np.repeat(begin - first * down, blocks) + np.arange(blocks.sum()) * down
    windows, bank, out = np.lib.stride_tricks.sliding_window_view(stream, width), _bank(up, down, cut, half), np.empty((len(starts), up))
    step = max(1, (1 << 17) // width)
    for lo in range(0, len(starts), step):
        np.matmul(windows[starts[lo : lo + step]], bank, out=out[lo : lo + step])
    return [out[lo : lo + n].ravel()[:size] if size else x for x, lo, n, size in zip(signals, first, blocks, sizes)]


def chunked(x: np.ndarray, size: int, always: bool = False) -> np.ndarray:
    """(chunks, size) with zeros at the end; shorter signals stay one row of their own length unless ``always``."""
    if len(x) <= size and not always:
        return x[None]
    n = max(1, math.ceil(len(x) / size))
    return np.pad(x, (0, n * size - len(x))).reshape(n, size)


@lru_cache(32)
def mel_filters(n_mels: int, n_fft: int, rate: int, low: float = 20.0, high: float | None = None, straight_in: str = "mel") -> np.ndarray:
    """Triangular filters at equal distances on the mel scale 1127 ln(1 + f / 700), with sides straight in mel or hertz."""
    mel = lambda f: 1127 * np.log1p(np.asarray(f) / 700)
    edges = np.linspace(mel(low), mel(high or rate / 2), n_mels + 2)
    at = np.arange(n_fft // 2 + 1) * rate / n_fft
    edges, at = (edges, mel(at)) if straight_in == "mel" else (700 * np.expm1(edges / 1127), at)
    up = (at - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - at) / (edges[2:] - edges[1:-1])[:, None]
    out = np.maximum(0, np.minimum(up, down))
    out.flags.writeable = False  # it is shared
    return out


def log_mel(x: np.ndarray, rate: int = RATE, n_mels: int = 128, window: float = 0.025, hop: float = 0.010, floor: float = 1e-7) -> np.ndarray:
    """(frames, n_mels) logarithms of mel energies; signals shorter than a window give no frame."""
    w, h = round(window * rate), round(hop * rate)
    n = 1 + (len(x) - w) // h if len(x) >= w else 0
    if not n:
        return np.zeros((0, n_mels), np.float32)
    n_fft = 1 << (w - 1).bit_length()
    frames = np.lib.stride_tricks.sliding_window_view(x, w)[:: h][:n]
    frames = (frames - frames.mean(1, keepdims=True)) * np.hanning(w)
    power = np.abs(np.fft.rfft(frames, n_fft)) ** 2
    return np.log(np.maximum(power @ mel_filters(n_mels, n_fft, rate).T, floor)).astype(np.float32)


@lru_cache(16)
def _hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def mel_spectrogram(x: np.ndarray, rate: int = 24000, n_fft: int = 960, hop: int = 240, n_mels: int = 128, floor: float = 1e-7) -> np.ndarray:
    """(frames, n_mels) logarithms of mel magnitudes of frames centred at every ``hop``-th sample, the signal being
    mirrored at its ends; what is below ``floor`` counts as ``floor``."""
    if not len(x):
        return np.zeros((0, n_mels), np.float32)
    half = n_fft // 2
    padded = np.concatenate([x[half:0:-1], x, x[-2 : -half - 2 : -1]]) if len(x) > half + 1 else np.pad(x, half, mode="reflect" if len(x) > 1 else "edge")
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    size = np.abs(np.fft.rfft(frames * _hann(n_fft), n_fft))
    return np.log(np.maximum(size @ mel_filters(n_mels, n_fft, rate, 0.0, straight_in="hertz").T, floor)).astype(np.float32)


@dataclass(frozen=True)
class Padded:
    """Frames with constant ones behind them up to ``total``, which are made when they are read (``np.asarray``)."""

    own: np.ndarray
    total: int
    fill: float

    @property
    def shape(self) -> tuple[int, int]:
        return self.total, self.own.shape[1]

    def __len__(self) -> int:
        return self.total

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        out = np.full(self.shape, self.fill, dtype or self.own.dtype)
        out[: len(self.own)] = self.own
        return out


def held_mel(x: np.ndarray, seconds: int = 30, n_mels: int = 128, hop: int = 160) -> tuple[Padded, np.ndarray]:
    """Features of ``seconds`` of audio, silence behind it included, and a mask of the frames that hold audio. Silent
    frames are constant and aren't computed."""
    total, x = seconds * RATE // hop, x[: seconds * RATE]
    held = -(-len(x) // hop)
    own = mel_spectrogram(np.concatenate([x, np.zeros(400)]), RATE, 400, hop, n_mels)[:total]
    return Padded(own, total, np.log(1e-7)), np.arange(total) < held


def padded_mel(x: np.ndarray, seconds: int = 30, n_mels: int = 128, hop: int = 160) -> tuple[np.ndarray, np.ndarray]:
    """``held_mel`` with all frames made."""
    frames, mask = held_mel(x, seconds, n_mels, hop)
    return np.asarray(frames), mask


def raw(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """The samples as frames of one value."""
    return np.asarray(x, np.float32)[:, None]


#: Extractors by name, from samples to frames or to (frames, mask); register more for other encoders.
EXTRACTORS: dict[str, Callable[[np.ndarray], np.ndarray | tuple[np.ndarray | Padded, np.ndarray]]] = {"log_mel": log_mel, "raw": raw, "mel_24k": mel_spectrogram, "padded_mel": held_mel}


@dataclass(frozen=True)
class Plan:
    """How audio is prepared. ``length`` is what counts as the length of a chunk: its ``frames``, the ``mask``'s sum, the
    ``samples`` or a number. Chunks are as long as ``chunk_seconds``, for audio that is longer or with ``always`` for all."""

    extractor: str = "log_mel"
    rate: int | None = RATE
    policy: str = "mean"
    most_seconds: float = 120
    chunk_seconds: float | None = None
    always: bool = False
    length: str | int = "frames"


# Encoders by name.
PLANS: dict[str, Plan] = {
    "zipformer2": Plan("log_mel", chunk_seconds=30),
    "dasheng": Plan("log_mel"),
    "dasheng_wavlm": Plan("raw", length="samples"),
    "whisper_beats": Plan("padded_mel", policy="first", most_seconds=30, length="samples"),
    "whisper": Plan("padded_mel", policy="first", length=1500),
    "qwenomni": Plan("padded_mel", policy="first", length="mask"),
    "qwen3omni": Plan("padded_mel", policy="first", length="mask"),
    "mimo": Plan("mel_24k", rate=24000),
    "perception_av": Plan("padded_mel", length="mask"),
    "audio_flamingo": Plan("padded_mel", policy="first", most_seconds=30, length="mask"),
}


def plan_of(encoder: str) -> Plan:
    try:
        return PLANS[encoder]
    except KeyError:
        raise ValueError(f"no encoder {encoder!r}; there are {', '.join(sorted(PLANS))}") from None


def prepared(channels: list[np.ndarray], old: int, plan: Plan) -> Iterator[tuple[int, np.ndarray, int]]:
    """(chunk, frames, length) of decoded audio: mixed down, brought to the plan's rate, cut, chunked and described. The
    last chunk's length is that of its audio, 50 frames at least, as an encoder of fixed chunks wants it."""
    rate = plan.rate or old
    yield from ((k, np.asarray(y), n) for k, y, n in _chunks(resample(_mixed(channels, plan), old, rate), rate, plan))


def _mixed(channels: list[np.ndarray], plan: Plan) -> np.ndarray:
    return downmix(np.stack(channels).astype(float), plan.policy) if channels else np.zeros(0)


def _chunks(x: np.ndarray, rate: int, plan: Plan) -> Iterator[tuple[int, np.ndarray | Padded, int]]:
    f, x = EXTRACTORS[plan.extractor], x[: round(plan.most_seconds * rate)]
    size = round(plan.chunk_seconds * rate) if plan.chunk_seconds else max(1, len(x))
    parts = chunked(x, size, plan.always)
    for k, c in enumerate(parts):
        y = f(c)
        frames, mask = y if isinstance(y, tuple) else (y, None)
        n = {"frames": len(frames), "samples": len(c)}.get(plan.length, plan.length)
        if plan.length == "mask":
            n = int(mask.sum()) if mask is not None else len(frames)
        last = k + 1 == len(parts) and len(parts) * size > len(x) and len(x) > 0 and (len(parts) > 1 or plan.always)
        if last and plan.length == "frames" and plan.extractor == "log_mel":
            n = max(math.ceil((size - (len(parts) * size - len(x))) / 160), 50)
        yield k, frames, int(n)


_FEATURES = pa.schema([("path", pa.string()), ("chunk", pa.int32()), ("length", pa.int64()), ("n_frames", pa.int32()), ("frames", pa.list_(pa.list_(pa.float32())))])


def features(audio: DataFrame, encoder: str | Column | Plan = "zipformer2") -> DataFrame:
    """Decoded audio (path, ok, sample_rate, channels) to (path, chunk, length, n_frames, frames), one row per chunk.

    ``encoder`` is the name of a plan for all rows, a plan, or a column of names by which rows are routed; a null name
    and a broken row give nothing, an unknown name is an error.
    """
    given = encoder if isinstance(encoder, Plan) else plan_of(encoder) if isinstance(encoder, str) else None
    name = encoder if isinstance(encoder, Column) else F.lit("")
    if given is not None and given.extractor not in EXTRACTORS:
        raise ValueError(f"no extractor {given.extractor!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, rate, channels, route = (b.column(c)[i] for c in range(4))
                own = [np.asarray(c.values) for c in channels]
                for k, y, n in prepared(own, rate.as_py(), given or plan_of(route.as_py())):
                    cols = [pa.array([path.as_py()]), pa.array([k], pa.int32()), pa.array([n], pa.int64()), pa.array([len(y)], pa.int32()), nested([list(y)])]
                    yield pa.RecordBatch.from_arrays(cols, schema=_FEATURES)

    rows = audio.where(F.col("ok")).select("path", "sample_rate", "channels", name.alias("encoder")).where("encoder is not null")
    return rows.mapInArrow(run, "path string, chunk int, length long, n_frames int, frames array<array<float>>")


_CHUNK = pa.struct([("encoder", pa.int32()), ("chunk", pa.int32()), ("length", pa.int64()), ("n_frames", pa.int32()), ("width", pa.int32())])
_DESCRIBED = pa.schema([("path", pa.string()), ("chunks", pa.list_(_CHUNK))])


def described(audio: DataFrame, *encoders: str | Column | Plan) -> DataFrame:
    """What ``features`` says of its frames, for callers that don't read the frames themselves, which are computed and
    stay where they are: (path, chunks), one row per file, a chunk being (encoder, chunk, length, n_frames, width).

    Every file is decoded once for all ``encoders``, each as in ``features``; a chunk has the encoder's place among
    them. Files of one rate and plan are resampled together, ``HELD`` samples at a time.
    """
    given = [e if isinstance(e, Plan) else plan_of(e) if isinstance(e, str) else None for e in encoders]
    names = [F.lit("") if g else e for g, e in zip(given, encoders)]
    if unknown := [g.extractor for g in given if g and g.extractor not in EXTRACTORS]:
        raise ValueError(f"no extractor {unknown[0]!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            outer = b.column(2)
            files, parts, values = outer.offsets.to_numpy(), outer.values.offsets.to_numpy(), outer.values.values.to_numpy(zero_copy_only=False)
            own = lambda i: [values[parts[k] : parts[k + 1]] for k in range(files[i], files[i + 1])]
            rates, found = b.column(1).to_pylist(), [[] for _ in range(b.num_rows)]
            for e, plan in enumerate(given):
                alike = defaultdict(list)
                for i, name in enumerate(b.column(3 + e).to_pylist()):
                    if name is not None:
                        alike[rates[i], plan or plan_of(name)].append(i)
                for (old, p), rows in alike.items():
                    rate, at = p.rate or old, 0
                    while at < len(rows):
                        signals, held = [], 0
                        while at + len(signals) < len(rows) and held < HELD:
                            signals.append(_mixed(own(rows[at + len(signals)]), p))
                            held += len(signals[-1])
                        for i, x in zip(rows[at:], resampled(signals, old, rate)):
                            found[i] += [(e, k, n, len(y), y.shape[1] if len(y) else None) for k, y, n in _chunks(x, rate, p)]
                        at += len(signals)
            cols = list(zip(*(c for f in found for c in f))) or [()] * len(_CHUNK)
            chunks = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(cols, _CHUNK)], fields=list(_CHUNK))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), chunks)], schema=_DESCRIBED)

    rows = audio.where(F.col("ok")).select("path", "sample_rate", "channels", *[n.alias(f"encoder_{k}") for k, n in enumerate(names)])
    return rows.mapInArrow(run, "path string, chunks array<struct<encoder int, chunk int, length long, n_frames int, width int>>")

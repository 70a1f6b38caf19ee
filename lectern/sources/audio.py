"""Recordings before they are recognised: size, RIFF and PCM, 16 kHz mono, duration; an error instead where one fails."""

from __future__ import annotations

import functools
import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bounded_batches

RATE = 16_000
MAX_BYTES, MAX_MS = 10 * 1024 * 1024, 60_000
#: Zero crossings of the low-pass filter on either side.
CROSSINGS = 16
#: Outputs that are computed at once.
BLOCK = 4096
PREPARED = "struct<pcm:binary,rate:int,duration_ms:int,error:string>"


class UnsupportedAudioFormatError(ValueError):
    """A recording that is no PCM in RIFF."""


class AudioTooLongError(ValueError):
    """A recording above the limit of bytes or time; of one above the time, ``rate`` and ``ms`` are known."""

    rate = ms = None


def samples_of(content: bytes) -> tuple[np.ndarray, int]:
    """``[frame, channel]`` between -1 and 1, and the rate, of PCM with 8, 16, 24 or 32 bits."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise UnsupportedAudioFormatError("no RIFF file")
    at, form, data = 12, None, None
    while at + 8 <= len(content) and data is None:
        name, length = struct.unpack("<4sI", content[at : at + 8])
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
        elif name == b"data":
            data = content[at + 8 : at + 8 + length]
        at += 8 + length + length % 2
    if form is None or data is None:
        raise UnsupportedAudioFormatError("no format or no data")
    kind, channels, rate, _, _, bits = form
    if kind not in (1, 0xFFFE) or bits not in (8, 16, 24, 32) or not channels or not rate:
        raise UnsupportedAudioFormatError(f"format {kind} with {bits} bits")
    size = bits // 8
    data = data[: len(data) // (size * channels) * size * channels]
    if bits == 24:
        wide = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        values = ((wide[:, 0] | wide[:, 1] << 8 | wide[:, 2] << 16) ^ 0x800000) - 0x800000
    else:
        values = np.frombuffer(data, {1: "u1", 2: "<i2", 4: "<i4"}[size]).astype(np.float64) - (128 if bits == 8 else 0)
    return values.reshape(-1, channels) / float(1 << (bits - 1)), rate


@functools.lru_cache(maxsize=64)
def _filter(up: int, down: int) -> np.ndarray:
    """A low-pass filter at the lower of both rates, as the rows of its ``up`` phases."""
    widest = max(up, down)
    half = CROSSINGS * widest
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / widest) * np.kaiser(2 * half + 1, 8.0) * up / widest
    rows = np.zeros((up, -(-(2 * half + 1) // up)))
    for phase in range(up):
        own = taps[phase::up]
        rows[phase, : len(own)] = own
    return rows


def resampled(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """``x`` at another rate by a polyphase filter: ``ceil(n * to / rate)`` samples.

    Each output takes the one phase of the filter that meets input samples, so no sample in between is computed.
    """
    if rate == to or not len(x):
        return x
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    rows = _filter(up, down)
    half, n, taps = CROSSINGS * max(up, down), -(-len(x) * up // down), rows.shape[1]
    padded = np.concatenate((np.zeros(taps), x, np.zeros(half // up + 2)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)[:, ::-1]
    out = np.empty(n)
    for a in range(0, n, BLOCK):  # all taps of a block of outputs at once
        place = np.arange(a, min(n, a + BLOCK)) * down + half  # of the filter's start, on the grid of the common rate
        own = windows[np.minimum(place // up + 1, len(windows) - 1)]
        out[a : a + BLOCK] = np.add.accumulate(rows[place % up] * own, axis=1)[:, -1]  # tap by tap, so equal whatever the block
    return out


def prepare(content: bytes, suffix: str = "", max_bytes: int = MAX_BYTES, max_ms: int = MAX_MS) -> tuple[bytes, int, int]:
    """16 kHz mono samples of 16 bits, the rate before and the duration; raises what is wrong with a recording."""
    if len(content) > max_bytes:
        raise AudioTooLongError(f"Audio upload exceeds {max_bytes // (1 << 20)} MB limit." if max_bytes >= 1 << 20 else f"Audio upload exceeds {max_bytes} bytes.")
    try:
        frames, rate = samples_of(content)
    except (UnsupportedAudioFormatError, struct.error) as error:
        raise UnsupportedAudioFormatError(f"Could not decode audio ({suffix}): {error}") from error
    ms = len(frames) * 1000 // rate
    if ms > max_ms:
        error = AudioTooLongError(f"Audio exceeds {max_ms // 1000}s recording limit." if max_ms >= 1000 else f"Audio exceeds {max_ms} ms.")
        error.rate, error.ms = rate, ms
        raise error
    channels = frames.shape[1]
    mono = resampled(functools.reduce(np.add, frames.T) / channels if channels < 8 else frames.mean(axis=1), rate)
    return np.clip(np.round(mono * 32768), -32768, 32767).astype("<i2").tobytes(), rate, ms


def prepared(recordings: DataFrame, content: str = "content", filename: str = "filename", max_bytes: int = MAX_BYTES, max_ms: int = MAX_MS) -> DataFrame:
    """``recordings`` with ``pcm`` for the recogniser, ``rate`` before, ``duration_ms`` and ``error``, in place of the content.

    The size is looked at first, then the format, then the duration; a recording that fails has its error, with its
    type, and no samples, and is not asked of any model. Null content is an undecodable recording.
    """

    def one(content: bytes | None, name: str | None) -> tuple:
        suffix = "." + name.rpartition(".")[2] if name and "." in name else ""
        try:
            return (*prepare(bytes(content or b""), suffix, max_bytes, max_ms), None)
        except AudioTooLongError as error:
            return None, error.rate, error.ms, f"{type(error).__name__}: {error}"
        except UnsupportedAudioFormatError as error:
            return None, None, None, f"{type(error).__name__}: {error}"

    @F.pandas_udf(PREPARED)
    def prepare_all(contents: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = [one(c, n) for c, n in zip(contents, names)]
        return pd.DataFrame(rows, columns=["pcm", "rate", "duration_ms", "error"]).astype({"rate": "Int32", "duration_ms": "Int32"})

    bounded_batches(recordings.sparkSession)
    return recordings.withColumn("_a", prepare_all(F.col(content), F.col(filename))).drop(content).select("*", "_a.*").drop("_a")


def recognised(prepared_: DataFrame, model: Column) -> DataFrame:
    """``prepared_`` with ``heard``: a column over ``pcm``, asked only of recordings without an error."""
    return prepared_.withColumn("heard", F.when(F.col("error").isNull(), model))

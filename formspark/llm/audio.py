"""Audio columns: chroma fingerprints and their alignment.

Samples are cut into overlapping frames; the power of a frame's spectrum is gathered by pitch class, and
frames are scaled to unit length. Over the resulting image (frames by pitch classes) sixteen rectangle
filters are laid at every frame. Each compares two sums that an integral image gives in a few lookups;
the logarithm of their ratio is cut into four grades, two bits in Gray code, and sixteen filters make one
packed 32-bit integer a frame.

Recordings are aligned by offset histograms: anchors of a query (parts of integers, first of a run, that are
least by hash in a window, as in winnowing) meet equal anchors of all recordings, each meeting votes for an
offset, and the offset with most votes is judged by the share of differing bits over the whole overlap.
Recordings with equal fingerprints are one class and searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formspark.llm.common import bounded_batches, materialise

RATE = 4096
FRAME = 512
HOP = 256
LOWEST, HIGHEST = 100.0, 1800.0   # Hz
WINDOW = 4                        # frames of which one gives an anchor
MOST_ERRORS = 0.12                # share of differing bits up to which recordings match
LEAST_OVERLAP = 12                # frames
GRADE = 0.25                      # log-ratio from which a filter's answer counts as strong
SPAN = 16                         # frames that the widest filter covers
CHUNK = 1 << 12                   # frames whose spectra are in memory at a time
GRAY = np.array([0, 1, 3, 2], np.uint32)


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, first pitch class, pitch classes, frames) of the sixteen filters."""
    out = []
    for k in range(16):
        height = (4, 6, 8, 12)[k % 4]
        out.append((k % 5, (k * 5) % (13 - height), height, (4, 8, 12, 16)[(k // 4 + k) % 4]))
    return out


def pitch_classes() -> np.ndarray:
    """Which pitch class each bin of the spectrum belongs to, as a matrix."""
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    inside = (hertz >= LOWEST) & (hertz <= HIGHEST)
    out = np.zeros((len(hertz), 12), np.float32)
    out[np.flatnonzero(inside), np.round(12 * np.log2(hertz[inside] / 440)).astype(int) % 12] = 1
    return out


def chroma(samples: np.ndarray) -> np.ndarray:
    n = 1 + (len(samples) - FRAME) // HOP if len(samples) >= FRAME else 0
    out = np.zeros((n, 12), np.float32)
    hann, bins = np.hanning(FRAME).astype(np.float32), pitch_classes()
    for at in range(0, n, CHUNK):
        part = np.lib.stride_tricks.sliding_window_view(samples[at * HOP:(min(n, at + CHUNK) - 1) * HOP + FRAME], FRAME)[::HOP]
        power = np.abs(np.fft.rfft(part * hann, axis=1)).astype(np.float32) ** 2
        rows = power @ bins
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        out[at:at + len(rows)] = np.where(length > 1e-3, rows / np.maximum(length, 1e-3), 0)
    return out


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One integer for each frame that the widest filter still fits on."""
    image = chroma(samples)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    integral = np.zeros((len(image) + 1, 13))
    integral[1:, 1:] = image.cumsum(axis=0, dtype=float).cumsum(axis=1)
    start = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return integral[start + t1, y1] - integral[start + t0, y1] - integral[start + t1, y0] + integral[start + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in filters():
        whole = area(0, w, y, y + h)
        if kind == 0:      # lower against upper half
            a = area(0, w, y, y + h // 2)
        elif kind == 1:    # earlier against later half
            a = area(0, w // 2, y, y + h)
        elif kind == 2:    # opposite quarters
            a = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif kind == 3:    # middle band against the others
            a = area(0, w, y + h // 4, y + h - h // 4)
        else:              # middle time against the rest
            a = area(w // 4, w - w // 4, y, y + h)
        ratio = np.log((1 + a) / (1 + np.maximum(whole - a, 0)))
        out = (out << np.uint32(2)) | GRAY[np.digitize(ratio, [-GRADE, 0, GRADE])]
    return out


def fingerprints(recordings: DataFrame, pcm: str = "pcm", out: str = "fingerprint") -> DataFrame:
    """Add ``out``: the packed little-endian 32-bit integers of each recording.

    ``pcm`` holds 16-bit little-endian mono samples at ``RATE``. Null and empty recordings and those too
    short for a filter get an empty fingerprint; an odd last byte is left out. Other columns stay.
    """
    bounded_batches(recordings.sparkSession)

    @F.pandas_udf("binary")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([fingerprint(np.frombuffer(x[:len(x) // 2 * 2], "<i2").astype(np.float32) / 32768).astype("<u4").tobytes() if x else b"" for x in rows], dtype=object)

    return recordings.withColumn(out, made(F.col(f"`{pcm}`")))


def anchors_of(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, key) of a fingerprint's anchors. A key is an integer without one of its four bytes, so that
    differing bits in one byte leave three of the four keys of a frame as they were."""
    values = np.frombuffer(packed, "<u4")
    frames, keys = [], []
    for k in range(4 if len(values) else 0):
        key = (values & np.uint32(0xFFFFFFFF ^ (0xFF << (8 * k)))).astype(np.uint64) | np.uint64(k << 40)
        first = np.append(True, key[1:] != key[:-1])
        mixed = np.where(first, (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20), np.uint64(2**63))
        if len(values) <= WINDOW:
            at = np.array([int(mixed.argmin())])
        else:
            at = np.unique(np.arange(len(values) - WINDOW + 1) + np.lib.stride_tricks.sliding_window_view(mixed, WINDOW).argmin(axis=1))
        at = at[first[at]]
        frames.append(at)
        keys.append(key[at])
    return (np.concatenate(frames), np.concatenate(keys).astype(np.int64)) if frames else (np.empty(0, np.int64), np.empty(0, np.int64))


def anchors(rows: DataFrame, key: str) -> DataFrame:
    """(key, frame, value) from rows of (key, fingerprint)."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, *anchors_of(p)) for k, p in zip(batch[key], batch["fingerprint"], strict=True)]
            yield pd.DataFrame({key: [k for k, at, _ in found for _ in range(len(at))], "frame": np.concatenate([at for _, at, _ in found] or [[]]).astype(np.int64),
                                "value": np.concatenate([v for _, _, v in found] or [[]]).astype(np.int64)})

    return rows.select(key, "fingerprint").mapInPandas(cut, f"{key} bigint, frame bigint, value bigint")


def differing(query: bytes, other: bytes, offset: int) -> tuple[int, int]:
    """Differing bits and compared bits, with the query's first frame on the other's frame ``offset``."""
    q, r = np.frombuffer(query, "<u4"), np.frombuffer(other, "<u4")
    low, high = max(0, -offset), min(len(q), len(r) - offset)
    if high <= low:
        return 0, 0
    return int(np.bitwise_count(q[low:high] ^ r[low + offset:high + offset]).sum()), 32 * (high - low)


def align(queries: DataFrame, recordings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of two tables (id: bigint, fingerprint).

    ``classes`` has id and class_id for each row of ``recordings``: the smallest id with the same
    fingerprint. ``links`` has id of a query and class_id, offset (frames), votes, bit_errors and bits
    where at most ``MOST_ERRORS`` of the bits over at least ``LEAST_OVERLAP`` common frames differ, at
    the offset with most votes (ties: the smallest). Rows with a null id are left out; empty
    fingerprints are a class without links.
    """
    known = materialise(recordings.where("id is not null").select("id", "fingerprint"))
    classes = materialise(known.groupBy("fingerprint").agg(F.min("id").alias("class_id")))
    asked = materialise(queries.where("id is not null").select("id", "fingerprint").distinct())
    left = anchors(asked, "id").withColumnRenamed("frame", "at")
    right = anchors(classes, "class_id")
    votes = left.join(right, "value").groupBy("id", "class_id", (F.col("frame") - F.col("at")).alias("offset")).count()
    best = votes.groupBy("id", "class_id").agg(F.max(F.struct("count", (-F.col("offset")).alias("back"))).alias("best"))
    best = best.select("id", "class_id", (-F.col("best.back")).alias("offset"), F.col("best.count").alias("votes"))

    @F.pandas_udf("struct<bit_errors: bigint, bits: bigint>")
    def judged(query: pd.Series, other: pd.Series, offset: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([differing(q, r, o) for q, r, o in zip(query, other, offset, strict=True)], columns=["bit_errors", "bits"])

    pairs = best.join(asked.withColumnRenamed("fingerprint", "query"), "id").join(classes, "class_id")
    links = pairs.select("id", "class_id", "offset", "votes", judged("query", "fingerprint", "offset").alias("j")).select("id", "class_id", "offset", "votes", "j.bit_errors", "j.bits")
    links = links.where((F.col("bits") >= 32 * LEAST_OVERLAP) & (F.col("bit_errors") <= MOST_ERRORS * F.col("bits")))
    return known.join(classes, "fingerprint").select("id", "class_id"), links


NOTES = 256        # samples of a note


def melody(vector: np.ndarray | None) -> bytes | None:
    """A recording whose notes are the values of a vector: sound to fingerprint, made from a table of vectors."""
    if vector is None:
        return None
    values = np.nan_to_num(np.array([0.0 if v is None else v for v in vector], float))
    spread = values.std() or 1.0
    hertz = 220 * 2 ** (np.clip(np.round(values / spread * 5) + 14, 0, 28) / 12)
    phase = np.cumsum(np.repeat(hertz, NOTES) * (2 * np.pi / RATE))
    return (np.sin(phase) * 12_000).astype("<i2").tobytes()


def clip(pcm: bytes | None, start: int, stop: int, seed: int) -> bytes | None:
    """Samples ``start`` to ``stop`` of a recording with faint noise, as a second recording of it would have."""
    if pcm is None:
        return None
    part = np.frombuffer(pcm, "<i2")[start:stop].astype(float)
    return np.clip(part + np.random.default_rng(seed).normal(0, 200, len(part)), -32768, 32767).astype("<i2").tobytes()

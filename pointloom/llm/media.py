"""Chroma fingerprints of audio columns, their search, and a renderer of vectors as recordings.

A recording's short-time spectra are folded into 12 pitch classes a frame and smoothed.
Rectangle filters over pitch classes and frames, summed in constant time from an
integral image, compare neighbouring areas; each is quantised to two bits in Gray code,
and 16 of them make one 32-bit integer a frame. Two recordings align where integers
that both have agree on one offset; there the share of differing bits decides.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pointloom.llm.common import bound_batches, written

RATE, FRAME, HOP = 4000, 512, 128
LOW, HIGH = 80.0, 1800.0
SMOOTH = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
WIDTH = 16
#: 16 filters: kind (which areas are compared), first pitch class, pitch classes, frames; by rule.
FILTERS = [(k % 4, (5 * k) % 8, 4 - k % 2, (4, 8, 12, 16)[k // 4]) for k in range(16)]
STEP = 0.12
#: Frames that must agree on an offset, frames that must overlap, share of bits that may differ.
VOTES, OVERLAP, ERROR = 4, 24, 0.15
#: Bytes of query fingerprints searched in one pass.
QUERY_BYTES = 16 << 20


def pcm(audio: bytes | None) -> np.ndarray:
    """Mono samples of WAV bytes (PCM of any width), resampled to RATE; null, empty and broken audio gives no samples."""
    if not audio:
        return np.empty(0)
    try:
        with wave.open(io.BytesIO(audio)) as w:
            width, channels = w.getsampwidth(), w.getnchannels()
            raw = np.frombuffer(w.readframes(w.getnframes()), np.uint8)
            raw = raw[: len(raw) // (width * channels) * width * channels].reshape(-1, width)
            if width == 1:  # unsigned
                x = raw[:, 0].astype(float) / 128 - 1
            else:
                most = np.zeros((len(raw), 4), np.uint8)
                most[:, -min(width, 4) :] = raw[:, -4:]
                x = most.view("<i4")[:, 0] / 2.0**31
            x = x.reshape(-1, channels).mean(1)
            rate = w.getframerate()
    except (wave.Error, EOFError):
        return np.empty(0)
    if rate != RATE and len(x):
        x = np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x)
    return x


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12 pitch classes, each frame scaled to length 1 (silence: zeros)."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP] * np.hanning(FRAME)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    used = np.flatnonzero((hertz >= LOW) & (hertz <= HIGH))
    note = np.rint(12 * np.log2(hertz[used] / 440.0)).astype(int) % 12
    fold = np.zeros((len(used), 12))
    fold[np.arange(len(used)), note] = 1
    found = power[:, used] @ fold
    if len(found) >= len(SMOOTH):
        found = sum(w * found[i : len(found) - len(SMOOTH) + 1 + i] for i, w in enumerate(SMOOTH))
    size = np.sqrt((found**2).sum(1, keepdims=True))
    return np.where(size > 1e-9, found / np.maximum(size, 1e-9), 0.0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """One uint32 a place in the chroma image (none where the recording is shorter than the widest filter)."""
    image = chroma(samples)
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.empty(0, np.uint32)
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)

    def area(t: int, c: int, frames: int, classes: int) -> np.ndarray:
        at = np.arange(n) + t
        return whole[at + frames, c + classes] - whole[at, c + classes] - whole[at + frames, c] + whole[at, c]

    out = np.zeros(n, np.uint32)
    for i, (kind, c, classes, frames) in enumerate(FILTERS):
        half, low = frames // 2, classes // 2
        if kind == 0:  # earlier against later
            a, b = area(0, c, half, classes), area(half, c, frames - half, classes)
        elif kind == 1:  # lower against higher
            a, b = area(0, c, frames, low), area(0, c + low, frames, classes - low)
        elif kind == 2:  # the two diagonals
            a = area(0, c, half, low) + area(half, c + low, frames - half, classes - low)
            b = area(0, c + low, half, classes - low) + area(half, c, frames - half, low)
        else:  # the middle against both sides
            third = max(1, frames // 3)
            a = area(third, c, frames - 2 * third, classes)
            b = area(0, c, third, classes) + area(frames - third, c, third, classes)
        value = np.log((1 + a) / (1 + b))
        level = np.searchsorted([-STEP, 0.0, STEP], np.round(value, 9))
        out |= (np.array([0, 1, 3, 2], np.uint32)[level]) << np.uint32(2 * i)
    return out


def render(vector: list[float] | np.ndarray | None) -> bytes:
    """WAV bytes of a vector: a note per component, its pitch and overtone from the component's value."""
    x = np.asarray([] if vector is None else vector, float)
    x = np.nan_to_num(x)
    n = 256
    t = np.arange(n) / RATE
    steps = np.rint(x * 60).astype(int)
    hertz = 220.0 * 2 ** ((steps % 24) / 12)
    tone = np.sin(2 * np.pi * hertz[:, None] * t) + 0.3 * np.sin(2 * np.pi * 1.5 * hertz[:, None] * t)
    samples = (tone * np.hanning(n) * 0.5).reshape(-1)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((samples * 32767).astype("<i2").tobytes())
    return out.getvalue()


@F.pandas_udf(BinaryType())
def rendered(vector: pd.Series) -> pd.Series:
    """An audio column from a column of vectors."""
    return vector.map(render, na_action=None)


@F.pandas_udf(BinaryType())
def fingerprints(audio: pd.Series) -> pd.Series:
    """A fingerprint column (little-endian uint32 bytes) from a column of WAV bytes; no audio gives an empty one."""
    return audio.map(lambda a: fingerprint(pcm(a)).astype("<u4").tobytes(), na_action=None)


def align(a: np.ndarray, b: np.ndarray, votes: int = VOTES, overlap: int = OVERLAP) -> tuple[float, int] | None:
    """The best alignment: (share of differing bits, offset of b in a), over offsets that enough equal integers vote for."""
    order = np.argsort(a, kind="stable")
    left, right = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    n = right - left
    if not n.sum():
        return None
    at_a = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)]
    offset, count = np.unique(at_a - np.repeat(np.arange(len(b)), n), return_counts=True)
    found = []
    for o in offset[count >= votes].tolist():
        x, y = a[max(0, o) : o + len(b)], b[max(0, -o) : len(a) - o]
        m = min(len(x), len(y))
        if m >= overlap:
            found.append((float(np.bitwise_count(x[:m] ^ y[:m]).sum()) / (32 * m), abs(o), o))
    return (min(found)[0], min(found)[2]) if found else None


def match(recordings: DataFrame, key: str = "rec_id", every: int = 100, error: float = ERROR) -> DataFrame:
    """A row per recording: the query recordings that it aligns with.

    ``recordings``: ``key`` (long) and fingerprint (binary). Queries are the rows whose
    key is divisible by ``every``, searched block by block against all rows; recordings
    with one fingerprint form a class and are searched once. Gives key, class_id (the
    least key of the class), frames, queries (aligned query rows, itself not counted), and
    the best one's best_query, offset and bit_error (ties: the least key; null: none).
    Null keys are no queries; empty fingerprints match nothing; repeated rows get repeated results.
    """
    rows = recordings.select(F.col(key).cast("long").alias(key), F.coalesce("fingerprint", F.lit(b"")).alias("fingerprint"))
    rows = written(rows.withColumn("class", F.xxhash64("fingerprint")), "recordings")
    asks = F.coalesce(F.col(key) % every == 0, F.lit(False)) & (F.octet_length("fingerprint") > 0)
    classes = rows.groupBy("class").agg(
        F.min(F.struct(F.col(key).isNull(), key, "fingerprint")).alias("r"), F.min(F.when(asks, F.col(key))).alias("query"), F.count(F.when(asks, 1)).alias("asking")
    )
    classes = written(classes.select("class", F.col(f"r.{key}").alias("class_id"), "r.fingerprint", "query", "asking"), "recording_classes")
    queries = classes.where("query is not null").select("query", "fingerprint", "asking", "class")
    size = queries.agg(F.sum(F.octet_length("fingerprint"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    found = None
    for block in range(blocks):  # one block at a time is on the driver
        mine = queries.where(F.pmod(F.xxhash64("query", "class"), F.lit(blocks)) == block)
        held = sorted(((r[0], np.frombuffer(r[1], "<u4"), r[2], r[3]) for r in mine.collect()), key=lambda h: h[0])
        sent = recordings.sparkSession.sparkContext.broadcast(held)
        part = classes.mapInPandas(_searcher(sent, error), "class long, queries long, best_query long, offset long, bit_error double")
        if blocks > 1:
            part = written(part, "searched")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    best = F.min(F.when(F.col("best_query").isNotNull(), F.struct("bit_error", "best_query", "offset"))).alias("b")
    found = found.groupBy("class").agg(F.sum("queries").alias("others"), best)
    known = classes.join(found, "class", "left").select("class", "class_id", (F.octet_length("fingerprint") / 4).cast("long").alias("frames"), "query", "asking", "others", "b")
    out = rows.select(key, "class", asks.alias("__asks")).join(known, "class")
    copies = F.col("asking") - F.when(F.col("__asks"), 1).otherwise(0)  # queries with the very same fingerprint
    same = (copies > 0) & ~F.col("query").eqNullSafe(F.when(F.col("__asks"), F.col(key)))
    return out.select(
        key, "class_id", "frames", (F.coalesce("others", F.lit(0)) + copies).alias("queries"), F.when(same, F.col("query")).otherwise(F.col("b.best_query")).alias("best_query"),
        F.when(same, F.lit(0)).otherwise(F.col("b.offset")).cast("long").alias("offset"), F.when(same, F.lit(0.0)).otherwise(F.col("b.bit_error")).alias("bit_error"),
    )


def _searcher(sent, error: float):
    """Searches a broadcast block of queries: (key, integers, how many rows ask, class)."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = sent.value
        values = np.concatenate([h[1] for h in held]) if held else np.empty(0, np.uint32)
        owner = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        order = np.argsort(values, kind="stable")
        known, first, counts = np.unique(values[order], return_index=True, return_counts=True)
        for frame in frames:
            out = []
            for number, raw in zip(frame["class"].tolist(), frame["fingerprint"], strict=True):
                mine = np.unique(np.frombuffer(raw, "<u4"))
                at = np.searchsorted(known, mine)
                hit = at[known[np.minimum(at, len(known) - 1)] == mine] if len(known) else np.empty(0, np.int64)
                n = counts[hit]
                spots = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[hit], n)]
                votes = np.bincount(owner[spots], minlength=len(held)) if len(spots) else np.zeros(len(held), int)
                total, best = 0, (None, None, None)
                for q in np.flatnonzero(votes >= VOTES).tolist():
                    key, its, asking, its_class = held[q]
                    if its_class == number:
                        continue
                    found = align(its, np.frombuffer(raw, "<u4"))
                    if found and found[0] <= error:
                        total += asking
                        if best[0] is None or (found[0], key) < best[:2]:
                            best = (found[0], key, found[1])
                out.append((number, total, best[1], best[2], best[0]))
            out = pd.DataFrame(out, columns=["class", "queries", "best_query", "offset", "bit_error"])
            yield out.astype({"best_query": "Int64", "offset": "Int64", "bit_error": "Float64"})

    return apply


def match_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Renders each row's vector as a recording, fingerprints it and searches; see match."""
    bound_batches(vectors.sparkSession)
    audio = vectors.select(F.col(key), rendered(F.col(column)).alias("audio"))
    return match(audio.select(key, fingerprints("audio").alias("fingerprint")), key)

"""Vectorised word cutting and hashing over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

import numpy as np

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Bytes hashed at once: bounds the eight-fold arrays of a step.
SLICE = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_weights = np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


def weights(n: int) -> np.ndarray:
    """Odd 64-bit weights of the first n places in a word."""
    global _weights
    if len(_weights) < n:
        _weights = mix(np.arange(1, max(n, 2 * len(_weights), 256) + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    return _weights


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes with a newline after each, and each text's end (place of its newline)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    return data, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """64-bit multilinear hashes of spans that together cover exactly the bytes where inside holds; SLICE bytes at a time."""
    out, ends, i = np.empty(len(starts), np.uint64), starts + lengths, 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE, "right")))
        span, n = slice(starts[i], ends[j - 1]), lengths[i:j]
        first = np.cumsum(n) - n
        within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first, n)
        terms = weights(int(n.max()))[within] * (data[span][inside[span]].astype(np.uint64) + np.uint64(1))
        out[i:j] = mix(np.add.reduceat(terms, first) ^ (n.astype(np.uint64) * _STEP))
        i = j
    return out


def plain_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased), and each text's number of words."""
    data, ends = joined(texts)
    data = _LOWER[data]
    inside = ~SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edge == 1)
    lengths = np.flatnonzero(edge == -1) - starts
    upto = np.searchsorted(starts, ends)
    return hash_spans(data, starts, lengths, inside), np.diff(upto, prepend=0)


_LETTER = np.zeros(256, bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = _LETTER[0x80:] = True


def letter_terms(texts: list[str | None], stems: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all letter runs, and of the first bytes (``stems``: how many) of longer runs, with each one's text.

    Letters are A-Z and every character beyond ASCII; A-Z and À-Þ are lower-cased.
    """
    data, ends = joined(texts)
    inside = _LETTER[data]
    folded = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    folded[lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)] + 1] += 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edge == 1)
    lengths = np.flatnonzero(edge == -1) - starts
    text = np.searchsorted(ends, starts)
    whole = hash_spans(folded, starts, lengths, inside)
    terms, owners = [whole], [text]
    for stem in stems:
        long = np.flatnonzero(lengths > stem)
        spelt = folded[starts[long][:, None] + np.arange(stem)].astype(np.uint64) + np.uint64(1)
        terms.append(mix((weights(stem)[:stem] * spelt).sum(1, dtype=np.uint64) + np.uint64(stem)))
        owners.append(text[long])
    return np.concatenate(terms), np.concatenate(owners)


_ALNUM = _LETTER.copy()
_ALNUM[ord("0") : ord("9") + 1] = True


def alnum_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of letters and digits (folded as in letter_terms), and each text's number of them."""
    data, ends = joined(texts)
    inside = _ALNUM[data]
    folded = _LOWER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    second = data[lead + 1]
    folded[lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)] + 1] += 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edge == 1)
    lengths = np.flatnonzero(edge == -1) - starts
    return hash_spans(folded, starts, lengths, inside), np.diff(np.searchsorted(starts, ends), prepend=0)

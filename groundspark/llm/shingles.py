"""Word shingles of many texts at once, as sets of 64-bit hashes, in numpy.

Words are maximal runs of bytes other than space and 0x09 to 0x0D, with A-Z lower-cased. A text's set holds the hashes of
its distinct runs of WIDTH words; a shorter text has its whole sequence as the only one; a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes of text that are hashed together; bounds the working arrays.
TOGETHER = 400_000
#: Odd multipliers for the bytes of a word and the words of a shingle.
BYTE_STEP = np.uint64(0x9E3779B97F4A7C55)
WORD_STEP = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _hashed(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    white = (data == 32) | ((data >= 9) & (data <= 13))
    begins = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    if not len(begins):
        return [np.zeros(0, np.uint64) for _ in texts]
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    place = np.zeros(len(data), kind)
    place[begins] = begins
    place = np.arange(len(data), dtype=kind) - np.maximum.accumulate(place)
    place[white] = 0
    step = powers(BYTE_STEP, int(place.max()) + 1)
    terms = (data.astype(np.uint64) + np.uint64(1)) * step[place]
    terms[white] = 0
    words = mixed(np.add.reduceat(terms, begins))
    ends = np.cumsum([len(t) + 1 for t in texts])
    to = np.searchsorted(begins, ends)
    since = np.concatenate([[0], to[:-1]])
    factor = powers(WORD_STEP, WIDTH + 1)
    n = len(words) - WIDTH + 1
    runs = np.zeros(max(n, 0), np.uint64)
    for k in range(WIDTH):
        if n > 0:
            runs += words[k : k + n] * factor[k + 1]
    runs = mixed(runs)
    out = []
    for a, b in zip(since.tolist(), to.tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(np.unique(runs[a : b - WIDTH + 1]))
        elif b > a:
            whole = (words[a:b] * factor[1 : b - a + 1]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(mixed(np.array([whole], np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted set of each text, in order."""
    with np.errstate(over="ignore"):
        part: list[bytes] = []
        size = 0
        for t in texts:
            raw = (t or "").encode("utf-8", "surrogatepass").lower()
            if part and size + len(raw) > TOGETHER:
                yield from _hashed(part)
                part, size = [], 0
            part.append(raw)
            size += len(raw)
        if part:
            yield from _hashed(part)


def signature(own: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as two signed numbers; (0, 0) for the empty set."""
    if not len(own):
        return 0, 0
    with np.errstate(over="ignore"):
        a = mixed(own + np.uint64(1)).sum(dtype=np.uint64)
        b = mixed(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def need(a, b):
    """The least intersection of two linked sets of sizes a and b: 100 * i >= 75 * (a + b - i)."""
    return (3 * (a + b) + 6) // 7


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exactly: 100 * intersection >= 75 * union, both sets non-empty."""
    if not len(a) or not len(b):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 4 * len(small) < 3 * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    same = int((large[at] == small).sum())
    return 100 * same >= 75 * (len(a) + len(b) - same)

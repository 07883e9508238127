"""Words and word n-grams of UTF-8 texts as 64-bit hashes, for many texts at once.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z in lower case. A word's
hash is a polynomial of random values of its bytes, so differences of one running sum
give the hashes of all words of a batch.
"""

from __future__ import annotations

import numpy as np

MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
BASE, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
PART_BYTES = 1 << 19


def mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def byte_values() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A value for each byte, that of a-z for A-Z; one of its own for each; and which bytes part words."""
    exact = mix(mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIERS[1]) ^ MULTIPLIERS[0])
    values = exact.copy()
    values[65:91] = values[97:123]
    parts = np.zeros(256, bool)
    parts[[32, *range(9, 14)]] = True
    return values, exact, parts


VALUES, EXACT_VALUES, PARTS = byte_values()
PARTS_TABLE = PARTS.tobytes()  # for bytes.translate
_POWERS: list[np.ndarray] = []


def powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and INVERSE to the powers below ``count``."""
    if not _POWERS or len(_POWERS[0]) < count:
        size = max(count, 2 * PART_BYTES)
        made = []
        for base in (BASE, INVERSE):
            out = np.full(size, np.uint64(base))
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        _POWERS[:] = made
    return _POWERS[0][:count], _POWERS[1][:count]


def text_parts(bodies: list[bytes | None], most: int = PART_BYTES):
    """Runs of texts of about ``most`` bytes, or one longer text, so that arrays over their words stay small."""
    part: list[bytes] = []
    size = 0
    for body in bodies:
        part.append(body or b"")
        size += len(part[-1]) + 1
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def word_hashes(part: list[bytes], values: np.ndarray = VALUES) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in order, and where each text's start (one more entry).

    ``values`` says which bytes count as the same: EXACT_VALUES tells A-Z from a-z.
    """
    body = b"\n".join(part) + b"\n"
    data = np.frombuffer(body, np.uint8)
    up, down = powers(len(data))
    between = np.frombuffer(b"\x01" + body.translate(PARTS_TABLE), bool)
    turns = np.flatnonzero(between[1:] != between[:-1])  # a word's start, its end, the next one's start, ...
    starts, ends = turns[::2], turns[1::2]
    parts = values.take(data, mode="clip")
    parts *= up
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(parts, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    lengths = np.array([len(p) + 1 for p in part], np.int64)
    return hashes, np.searchsorted(starts, np.concatenate(([0], np.cumsum(lengths))))


def ngrams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` words, in order."""
    count = len(hashes) - size + 1
    if count <= 0:
        return hashes[:0]
    total = hashes[:count].copy()
    for step in range(1, size):
        total = total * MULTIPLIERS[0] + (hashes[step : step + count] ^ MULTIPLIERS[1])
        total ^= total >> np.uint64(29)
    return mix(total)


def shingle_sets(bodies: list[bytes | None], size: int, common: tuple[np.ndarray, np.ndarray]):
    """Each text's sorted distinct shingles; fewer words than ``size`` make one shingle, no words none.

    ``common`` has sorted word hashes and a weight for each; the sum of a shingle's weights
    is its top byte, so shingles of rare words sort first.
    """
    keys, weights = common
    for part in text_parts(bodies):
        hashes, edges = word_hashes(part)
        grams = ngrams(hashes, size)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.where(keys[at] == hashes, weights[at], 0))))
            rank = np.minimum(sums[size:] - sums[:-size], 255) if len(grams) else np.zeros(0, np.int64)
            grams = (grams >> np.uint64(8)) | (rank.astype(np.uint64) << np.uint64(56))
        for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if start == end:
                yield hashes[:0]
            elif end - start < size:
                yield ngrams(hashes[start:end], end - start) ^ np.uint64(end - start)
            else:
                found = np.sort(grams[start : end - size + 1])
                yield found[np.concatenate(([True], found[1:] != found[:-1]))]

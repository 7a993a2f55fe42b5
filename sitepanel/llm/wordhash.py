"""Words and shingles of texts as 64-bit hashes, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
SIXTY_FOUR = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (splitmix64's finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32  # A-Z alone
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(size: int) -> np.ndarray:
    """Odd multipliers by place in a word."""
    return mix(np.arange(size, dtype=np.uint64) * GOLDEN + np.uint64(77)) | np.uint64(1)


def in_pieces(texts: Iterable[str | None], most_bytes: int = 1 << 19) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as bytes, each of about ``most_bytes`` or a single longer text, with the first one's place."""
    piece, first, size = [], 0, 0
    for place, text in enumerate(texts):
        data = text.encode("utf-8", "replace") if text else b""
        if piece and size + len(data) > most_bytes:
            yield first, piece
            piece, first, size = [], place, 0
        piece.append(data)
        size += len(data) + 1
    if piece:
        yield first, piece


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, and each text's first place.

    The second array has one entry more than there are texts.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    ends_of = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64)) if texts else np.zeros(0, dtype=np.int64)
    space = SPACE[data]
    before = np.ones(len(data), dtype=bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & before)
    bounds = np.append(0, np.searchsorted(starts, ends_of)) if texts else np.zeros(1, dtype=np.int64)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), bounds
    after = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    lengths = after - starts
    letters = LOWER[data[~space]]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters), dtype=np.int64) - np.repeat(first, lengths)
    values = BYTE_KEYS[letters] * powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * GOLDEN), bounds


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles; shorter texts have their whole sequence as one."""
    hashes, bounds = word_hashes(texts)
    rolled = np.zeros(max(len(hashes) - words + 1, 0), dtype=np.uint64)
    for k in range(words if len(rolled) else 0):
        rolled += hashes[k : k + len(rolled)] * powers(words)[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = (hashes[a:b] * powers(words)[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)
            out.append(mix(whole * GOLDEN))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out

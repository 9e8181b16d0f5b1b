"""Vectorised hashes of words and word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words of the sequences that minimisers are taken from.
PIECE = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective scrambling of 64-bit values, another one for each seed."""
    x = x + np.uint64((seed + 1) * 0xD1342543DE82EF95 % (1 << 64))
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(32)


def rolled(x: np.ndarray, length: int, step: np.uint64 = _BASE) -> np.ndarray:
    """Hashes of all runs of ``length`` neighbours of x, put together from runs of powers of two."""
    out, done, run, size, power = None, 0, x, 1, step
    with np.errstate(over="ignore"):
        while True:
            if length & size:
                if out is None:
                    out = run
                else:
                    n = len(x) - done - size + 1
                    out = out[:n] * power + run[done : done + n]
                done += size
            if done == length:
                return out
            run = run[:-size] * power + run[size:]
            power, size = power * power, size * 2


def least(x: np.ndarray, length: int) -> np.ndarray:
    """The least value of every ``length`` neighbours of x."""
    size = 1
    while size * 2 <= length:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == length else np.minimum(x[: len(x) - (length - size)], x[length - size :])


class Windows:
    """All windows of several texts: hash, minimiser, text and first word of each."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        ends = np.cumsum([len(text) + 1 for text in texts])
        space = _SPACE[data]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        start, end = edge[::2], edge[1::2]
        self.text_of_word = np.searchsorted(ends, start, "right")
        self.first_word = np.searchsorted(self.text_of_word, np.arange(len(texts) + 1))
        self.n_words = np.diff(self.first_word)
        empty = np.zeros(0, np.uint64)
        self.hash, self.minimiser, self.text, self.word = empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(start) < window:
            return
        with np.errstate(over="ignore"):
            # a word's hash: its bytes times powers of the base that count from the word's start
            inside = np.arange(len(data))
            inside[start[0] :] -= np.repeat(start, np.diff(np.append(start, len(data))))
            powers = np.cumprod(np.full(int((end - start).max()) + 1, _BASE, np.uint64))
            value = np.where(space, np.uint64(0), (data + np.uint64(1)) * powers[np.minimum(inside, len(powers) - 1)])
            word = mixed(np.add.reduceat(value, start), 0)
            self.word = np.flatnonzero(self.text_of_word[: len(word) - window + 1] == self.text_of_word[window - 1 :])
            self.text = self.text_of_word[self.word]
            self.hash = rolled(word, window)[self.word]
            piece = min(PIECE, window)
            self.minimiser = least(mixed(rolled(word, piece), 9), window - piece + 1)[self.word]
        self.word = self.word - self.first_word[self.text]


def portions(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of neighbouring texts of about ``most`` bytes together, each with its first position; null is empty."""
    start, held, size = 0, [], 0
    for i in range(0, len(column), 64):
        for text in column.slice(i, 64).to_pylist():
            held.append((text or "").encode())
            size += len(held[-1])
            if size >= most:
                yield start, held
                start, held, size = start + len(held), [], 0
    if held:
        yield start, held

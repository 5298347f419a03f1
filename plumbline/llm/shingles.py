"""Shingle sets of texts as sorted arrays of 64-bit hashes, vectorised over batches of texts."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SHINGLE = 5
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_MIX = [_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_powers = np.ones(1, _U)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, _U), np.full(2 * n - 1, _BASE)]))
    return _powers


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash and length of every word of all texts in order, number of words of each text); A-Z count as a-z."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    counts = np.diff(np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)])))
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, np.int64), counts
    lengths = ends - starts
    chars = _LOWER[data[~space]].astype(_U) + _U(1)
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(chars)) - np.repeat(first, lengths)
    sums = np.add.reduceat(chars * _powers_to(int(lengths.max()))[place], first)
    return mix64(sums + lengths.astype(_U) * _MIX[0]), lengths, counts


def _by_length(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (h >> _U(8)) | ((255 - np.minimum(length, 255)).astype(_U) << _U(56))


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingles, ascending; texts with fewer words have one for the whole sequence.

    A shingle is 56 bits of hash below 8 bits that fall with its length in bytes: in ascending
    order the longest come first, which are the rarest before anything is counted.
    """
    words, lengths, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    n = len(words)
    rolled = np.zeros(max(0, n - size + 1), _U)
    for k in range(size):
        rolled += words[k : k + len(rolled)] * _MIX[k % len(_MIX)] * _U(2 * (k // len(_MIX)) + 1)
    total = np.concatenate([[0], np.cumsum(lengths)])
    rolled = _by_length(mix64(rolled), total[size:] - total[:-size] if len(rolled) else total[:0])
    out = []
    for lo, hi in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if hi - lo >= size:
            s = np.sort(rolled[lo : hi - size + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            out.append(s)
        elif hi > lo:
            short = np.zeros(1, _U)
            for k in range(hi - lo):
                short += words[lo + k : lo + k + 1] * _MIX[k]
            out.append(_by_length(mix64(short + _U(hi - lo)), np.array([total[hi] - total[lo]])))
        else:
            out.append(np.zeros(0, _U))
    return out


def give_back() -> None:
    """Returns freed memory to the system; else it stays with a worker process that later stages use again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # no glibc
        ctypes.CDLL(None).malloc_trim(0)


#: What drops the things that an operator keeps in its worker process from task to task.
KEPT: list[Callable[[], None]] = []


def let_go() -> None:
    """Drops what other operators keep in this process, as Spark gives a worker process to one operator after the other."""
    for drop in KEPT:
        drop()


def in_chunks(batches: Iterator, column: int, limit: int = 4 << 20) -> Iterator[tuple]:
    """(batch slice, its texts as UTF-8) with about `limit` bytes of text each, or one longer text."""
    let_go()
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            batch = whole.slice(k, 500)
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(column).to_pylist()]
            lo = total = 0
            for i, t in enumerate(texts):
                if total and total + len(t) > limit:
                    yield batch.slice(lo, i - lo), texts[lo:i]
                    lo, total = i, 0
                total += len(t)
            if lo < len(texts):
                yield batch.slice(lo), texts[lo:]
    give_back()

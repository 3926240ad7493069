"""Words of texts as hashes of their bytes, many texts at a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> U64(33))) * U64(k)
    return x ^ (x >> U64(29))


def odd_numbers(seed: bytes, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(seed + str(i).encode()) | 1 for i in range(n)], U64)


FACTORS = odd_numbers(b"shingle", 64)
BYTES = np.arange(256)
#: What separates words, by byte: white space, or all of ASCII but digits and letters.
SPACE = np.isin(BYTES, [32, *range(9, 14)])
NOT_ALPHANUMERIC = (BYTES < 128) & ~np.isin(BYTES, [*range(48, 58), *range(65, 91), *range(97, 123)])
#: A-Z lower-cased, by byte.
LOWER = np.where((BYTES >= 65) & (BYTES <= 90), BYTES + 32, BYTES).astype(np.uint8)
#: Words of more bytes are hashed one by one, each at once.
LONG = 256


def word_spans(texts: pa.Array, lower: bool = False, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, first, length, counts): the bytes of all texts, where each word begins and how many bytes it has, words of each text; a null has none."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    size = int(at[-1] - at[0])
    data = np.frombuffer(data, np.uint8, size, int(at[0])) if size else np.empty(0, np.uint8)
    at -= at[0]
    if lower:
        data = LOWER[data]
    solid = ~separator[data]
    # a word begins behind a separator or at a text's start, and ends likewise
    starts, ends = solid.copy(), solid.copy()
    starts[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < size)]
    starts[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    first = np.flatnonzero(starts)
    length = np.flatnonzero(ends) + 1 - first
    return data, first, length, np.diff(np.searchsorted(first, at))


def over_bytes(data: np.ndarray, first: np.ndarray, length: np.ndarray, state: np.ndarray, step: Callable, whole: Callable) -> np.ndarray:
    """state of each word after step(state, byte) for all its bytes; words of more than LONG bytes take whole(state, bytes) instead."""
    order = np.argsort(-np.minimum(length, LONG + 1).astype(np.int16), kind="stable")
    place, left = first[order], length[order]
    h = state[order]
    long = int(np.searchsorted(-left.clip(0, LONG + 1), -LONG))
    for k in range(long):
        h[k] = whole(h[k], data[place[k] : place[k] + left[k]].tobytes())
    h, place, left, out_long = h[long:], place[long:], left[long:], h[:long]
    live = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0) - 0.5)
    for k, n in enumerate(live.tolist()):
        h[:n] = step(h[:n], data[place[:n] + k])
    out = np.empty_like(state)
    out[order] = np.concatenate([out_long, h])
    return out


def hashed_words(texts: pa.Array, lower: bool = False, separator: np.ndarray = SPACE) -> list[np.ndarray]:
    """The hashes of each text's words, from the bytes of all texts at once; a null has none. lower: with A-Z lower-cased.

    A word's hash takes in its bytes one by one; words of a length or more take the same step together.
    """
    data, first, length, counts = word_spans(texts, lower, separator)
    start = np.full(len(first), 0xCBF29CE484222325, U64)
    h = over_bytes(data, first, length, start, lambda h, b: (h ^ b) * U64(0x100000001B3), lambda _, word: U64(xxhash.xxh64_intdigest(word)))
    out = mixed(h + length.astype(U64) * FACTORS[12], 0x9FB21C651E98DF25)
    return np.split(out, np.cumsum(counts)[:-1]) if len(counts) else []

"""Splitting texts where byte-level BPE surely has a boundary.

The pre-tokenizer's pattern is matched from left to right and looks one
character ahead, never back, and none of its alternatives takes a space after
other characters. So there is a boundary before a space that follows a
non-space, and before one that precedes a non-space. Only a space between
white space and white space (or the text's end) may lie within a piece; it
stays within its part.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed value: the published pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = regex.compile(PATTERN)
UNSAFE = re.compile(r"\s (?:\s|\Z)")
SURE = re.compile(r"(?<=\S) | (?=\S)")


def parts(text: str) -> list[str]:
    """The text is the first part and then each other one behind a space, with boundaries before those spaces."""
    return SURE.split(text) if UNSAFE.search(text) else text.split(" ")


def with_special(text: str, special: Mapping[str, int]) -> list[str | int]:
    """parts() of a text, with their leading spaces, and the ids of special strings in it."""
    segments: list[str | int] = [text]
    for s, i in special.items():
        segments = [y for x in segments for y in ([x] if isinstance(x, int) else [z for part in x.split(s) for z in (i, part)][1:])]
    out: list[str | int] = []
    for x in segments:
        if isinstance(x, int):
            out.append(x)
        elif x:
            head, *rest = parts(x)
            out += [head, *(f" {y}" for y in rest)]
    return out


def coded(texts: pa.Array, special: Mapping[str, int]) -> tuple[list[str | int], np.ndarray, np.ndarray]:
    """(parts, codes, counts): counts parts of each text, one after the other, as places in parts; these are distinct but for first parts and odd texts."""
    plain = texts.to_pylist()
    odd = np.zeros(len(texts), bool)
    for s in special:
        odd |= np.asarray(pc.match_substring(texts, s))
    for i in np.flatnonzero(~odd):
        odd[i] = UNSAFE.search(plain[i]) is not None
    split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
    words = split.flatten().dictionary_encode()
    found: list[str | int] = [f" {x}" for x in words.dictionary.to_pylist()]
    codes = np.array(words.indices, np.int64)
    counts = np.zeros(len(texts), np.int64)
    counts[~odd] = np.asarray(pc.list_value_length(split))
    first = np.cumsum(counts[~odd]) - counts[~odd]
    codes[first] = len(found) + np.arange(len(first))
    found += [plain[i].split(" ", 1)[0] for i in np.flatnonzero(~odd)]
    if odd.any():
        lists = [with_special(plain[i], special) for i in np.flatnonzero(odd)]
        counts[odd] = [len(x) for x in lists]
        of_odd = np.repeat(odd, counts)
        every = np.empty(len(of_odd), np.int64)
        every[~of_odd] = codes
        every[of_odd] = len(found) + np.arange(int(of_odd.sum()))
        codes = every
        found += [x for part in lists for x in part]
    return found, codes, counts


class Generations(dict):
    """Values of late keys: when more than `most` are young, the old ones go and the young ones get old."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def missing(self, keys: list) -> list:
        """Distinct keys without a value; the others have one until the next call."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        old, out = self.old, []
        for x in dict.fromkeys([x for x in keys if x not in self]):
            if x in old:
                self[x] = old[x]
            else:
                out.append(x)
        return out

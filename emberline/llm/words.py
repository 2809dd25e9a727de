"""Words of many texts as 64-bit hashes, worked out for all characters of a block at once.

A word is a run of characters that a table marks. Its hash is a polynomial in an odd base over its
characters (modulo 2^64), taken from running sums: the sum up to the word's end less the sum up to
its start, times the inverse power of the start. So a word has the same hash wherever it stands.

Cases: null and empty texts have no words; a text or word of any length is read in blocks that end
between words, so the memory is that of one block, or of the longest word.
"""

from __future__ import annotations

from functools import cache

import numpy as np

BLOCK = 1 << 15
BASE = 0x9E3779B97F4A7C15
CODE_POINTS = 0x110000


@cache
def letters_and_digits() -> np.ndarray:
    """Marks the characters of ``[^\\W_]``."""
    return np.fromiter((chr(i).isalnum() for i in range(CODE_POINTS)), bool, CODE_POINTS)


@cache
def not_blank() -> np.ndarray:
    """Marks all but ASCII white space."""
    table = np.ones(CODE_POINTS, bool)
    table[[9, 10, 11, 12, 13, 32]] = False
    return table


@cache
def only(characters: str) -> np.ndarray:
    table = np.zeros(CODE_POINTS, bool)
    table[[ord(c) for c in characters]] = True
    return table


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n, and their inverses."""
    both = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(n + 1, base, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps))
    return both[0], both[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def hashed_words(texts: list[str | None], marks: np.ndarray, ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' words in order, and the number of words of each text.

    Letters count in lower case: all of them, or with ``ascii_only`` A to Z.
    """
    return words_and_stops(texts, marks, None, ascii_only)[:2]


def words_and_stops(texts: list[str | None], marks: np.ndarray, stops: np.ndarray | None, ascii_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`hashed_words`, and for each word how many characters that ``stops`` marks are before it (a line end stands between texts)."""
    bodies = [t or "" for t in texts] if ascii_only else [(t or "").lower() for t in texts]
    ends = np.cumsum([len(b) + 1 for b in bodies]) if bodies else np.zeros(0, np.int64)
    whole = "\n".join(bodies)  # a line end is no part of a word in either table
    found, places, before, passed = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    at, size = 0, BLOCK
    while at < len(whole):
        points = np.frombuffer(whole[at : at + size].encode("utf-32-le", "surrogatepass"), np.uint32)
        on = marks[points]
        stop = len(points)
        if at + stop < len(whole):
            stop -= int(np.argmin(on[::-1]))
            if on[stop - 1]:  # one word fills the block
                size *= 2
                continue
            points, on = points[:stop], on[:stop]
        edge = np.diff(on.view(np.int8), prepend=0, append=0)
        start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        if stops is not None:
            here = np.nonzero(stops[points])[0]
            before.append(np.searchsorted(here, start) + passed)
            passed += len(here)
        if len(start):
            if ascii_only:
                points = points + ((points - np.uint32(65)) < 26) * np.uint32(32)
            forth, back = _powers(max(BLOCK, 1 << stop.bit_length()))
            value = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            value ^= value >> np.uint64(31)
            value *= forth[:stop]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
            found.append(mixed((total[end] - total[start]) * back[start]))
            places.append(start + at)
        at, size = at + stop, BLOCK
    below = np.searchsorted(np.concatenate(places), ends)
    return np.concatenate(found), np.diff(below, prepend=0), np.concatenate(before)


def runs_of(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of ``width`` words, by its first word."""
    n = max(len(words) - width + 1, 0)
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = mixed(h ^ words[i : i + n])
    return h

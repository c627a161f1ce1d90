"""Texts of a batch as one array of code points, and their words and sentences as index arrays (numpy, no loop over characters)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

SPACE, NEWLINE, LOWER, UPPER, DIGIT, END, PAUSE, MARK, SYMBOL, HIDDEN = range(10)
CLASSES = 10
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(class, lower-case code) of each code point of the basic plane."""
    cls, low = np.full(65536, SYMBOL, np.uint8), np.arange(65536, dtype=np.uint16)
    for n in range(65536):
        ch = chr(n)
        kind = unicodedata.category(ch)
        if kind == "Cs":
            continue
        if ch == "\n":
            cls[n] = NEWLINE
        elif kind == "Zs" or ch == "\t":
            cls[n] = SPACE
        elif kind in ("Cc", "Cf") or ch == "￼":
            cls[n] = HIDDEN
        elif kind in ("Lu", "Lt"):
            cls[n] = UPPER
        elif kind[0] in "LM":
            cls[n] = LOWER
        elif kind[0] == "N":
            cls[n] = DIGIT
        elif ch in ".!?…":
            cls[n] = END
        elif ch in ",:":
            cls[n] = PAUSE
        elif ch in "'\"()’‘“”«»–-‐¬":
            cls[n] = MARK
        if len(x := ch.lower()) == 1:
            low[n] = ord(x)
    return cls, low


class Batch:
    """code, low and cls of all visible characters, and row, the index of the text of each."""

    def __init__(self, texts: list[str | None]):
        self.n = len(texts)
        texts = [t or "" for t in texts]
        lens = np.fromiter(map(len, texts), np.int64, self.n)
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.minimum(code, 0xFFFF).astype(np.uint16)
        classes, lower = tables()
        cls = classes[code]
        seen = cls != HIDDEN
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), lens)[seen]
        self.code, self.cls = code[seen], cls[seen]
        self.low = lower[self.code]
        self.lens = lens

    def starts(self) -> np.ndarray:
        """Whether a character is the first of its text."""
        first = np.ones(len(self.row), bool)
        first[1:] = self.row[1:] != self.row[:-1]
        return first

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last+1 position of each run of letters within a text."""
        letter = (self.cls == LOWER) | (self.cls == UPPER)
        first = self.starts()
        begin = letter.copy()
        begin[1:] &= ~letter[:-1] | first[1:]
        end = letter.copy()
        end[:-1] &= ~letter[1:] | first[1:]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word in lower case."""
        if not len(begin):
            return np.empty(0, np.uint64)
        with np.errstate(over="ignore"):
            at = np.arange(len(self.low)) - np.repeat(begin, np.diff(np.append(begin, len(self.low))))[: len(self.low)] if begin[0] == 0 else None
            if at is None:
                at = np.zeros(len(self.low), np.int64)
                at[begin[0] :] = np.arange(begin[0], len(self.low)) - np.repeat(begin, np.diff(np.append(begin, len(self.low))))
            power = _powers()[np.minimum(at, 255)]
            x = self.low.astype(np.uint64) * power
            letter = (self.cls == LOWER) | (self.cls == UPPER)
            x[~letter] = 0
            return np.add.reduceat(x, begin)


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    out = np.ones(256, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(1, 256):
            out[i] = out[i - 1] * BASE
    return out


def word_hashes(words: list[str]) -> np.ndarray:
    """The hashes of given words, sorted, for np.isin."""
    b = Batch(words)
    return np.unique(b.hashes(*b.words()))


def isin_sorted(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[at] == x


def sentences(b: Batch) -> np.ndarray:
    """The number of the segment of each character: segments end after . ! ? … that space or the end of the text follows, at
    a blank line, and before and after lines that open with a mark of lists, tables or code."""
    n = len(b.cls)
    if not n:
        return np.empty(0, np.int64)
    after = np.full(n, NEWLINE, np.uint8)
    after[:-1] = b.cls[1:]
    first = b.starts()
    after[:-1][first[1:]] = NEWLINE
    gap = (after == SPACE) | (after == NEWLINE) | (after == MARK)
    stop = (b.cls == END) & gap
    stop |= (b.cls == NEWLINE) & ((after == NEWLINE) | (after == SYMBOL))
    begin = first.copy()
    begin[1:] |= stop[:-1]
    return np.cumsum(begin) - 1


def pieces(texts: list[str | None], most: int = 400_000) -> list[tuple[int, int]]:
    """Ranges of texts of about `most` characters each, at least one text: a bound on the memory of a Batch, not on the texts."""
    out, begin, size = [], 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            out.append((begin, i))
            begin, size = i, 0
        size += n
    return [*out, (begin, len(texts))] if len(texts) > begin else out

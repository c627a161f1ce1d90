"""Problem 2: text of scanned pages made continuous again, with the noise named per block.

Lines are labelled as body, body that ends in a broken word, running header or page number by a hidden Markov model over the lines of a
document. Its features are layout (place of the block on the page by its box, place of the line in the block, indentation), form (end,
first character, length) and two facts of the document (pages on which the line recurs, the constant between printed and real page
number); transitions and emissions are counted on a sample of documents, labelled by recurrence. What the model labels
as header or number must stand an exact check. Paragraphs are then put together from the body lines: broken words are joined, misread words
are corrected against the words of the collection.

A document is one group, so that a word may go on at any later page. The collection's words stay a table: documents ask for
the words they hold that aren't common, and get answers by joins. Only common words, at most COMMON, and
hashed trigrams, BUCKETS counts, are sent to tasks.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchflow.llm import boilerplate
from parchflow.llm.encoding import restore
from parchflow.llm.normal import readable
from parchflow.runtime import arrow_map, cut, ship

BUCKETS = 1 << 18  # of hashed trigrams
SAMPLE_DOCS = 2_000  # documents that the line model is counted on
ROWS = 200_000
WORDS = r"[\p{L}]+(?:[-’][\p{L}]+)*"
MIN_PAGES = 3
LETTERS = 4  # of a line that can be told from others

# What scanners take characters for, as read and as printed.
CONFUSIONS = """
c e|e c|ri n|0 o|0 о|f t|t f|5 s|ii u|rn m|m rn|cl d|d cl|1 l|1 i|l i|i l|li h|h li|9 g|9 q|п н|н п|н и|и н|ьi ы|6 é|6 ó|6 б|6 o|3 з|3 e|g ç|c ç|щ ш|ш щ|8 b|8 в|vv w|l t|t l|b h|h b|u ii|n ri|c è|c é|! i|4 a|2 z|7 t|о 0|е с|с е
"""  # fmt: skip
PAIRS = tuple(tuple(x.split(" ")) for x in CONFUSIONS.strip().split("|"))
# Words before a page number.
PAGE_WORDS = "p pg pág page página pagina seite стр s с pag"

_FOLD_SEQ = tuple(x for x in (("rn", "m"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("ri", "n"), ("vv", "w"), ("ьi", "ы")))
_FOLD_ONE = str.maketrans("0159638|!oceiltfпнищшèéóç", "олsgбзвll" + "оeelлtt" + "ннншш" + "eeоg")


def fold(line: str) -> str:
    """The letters of a line in one case, with what scanners confuse made alike."""
    s = re.sub(r"[^\w|!]|_", "", line.lower())
    for a, b in _FOLD_SEQ:
        s = s.replace(a, b)
    return s.translate(_FOLD_ONE)


_PAGE_FOLDS = {fold(w) for w in PAGE_WORDS.split()}
_NUM = r"[0-9lIOo]*[0-9][0-9lIOo]*|[ivxlcdm]+|[IVXLCDM]+"
_LONE = re.compile(rf"[\s\-–—\[\]|·*.‐]*(?:([^\W\d_]{{1,7}})[.\s]*\s)?[\s\-–—\[\]|·*]*({_NUM})(?:\s*(?:/|of|de|von|di|из)\s*[0-9lIOo]+)?[\s\-–—\[\]|·*.]*")
_LEAD = re.compile(rf"\s*({_NUM})[\s|·—–-]+(\S.*)", re.S)
_TAIL = re.compile(rf"(.*\S)[\s|·—–-]+({_NUM})\s*", re.S)
_ROMAN = re.compile(r"(?=[ivxlcdm])m*(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})")


def number(s: str) -> int | None:
    s = s.lower()
    if any(c.isdigit() for c in s):
        return int(s.translate(str.maketrans("lio", "110")))
    if not _ROMAN.fullmatch(s):
        return 1 if s == "l" else None
    v = [dict(i=1, v=5, x=10, l=50, c=100, d=500, m=1000)[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(v, [*v[1:], 0]))


def lone_number(line: str) -> int | None:
    """The number of a line that holds nothing but a page number."""
    if not (m := _LONE.fullmatch(line)):
        return None
    if m[1] and fold(m[1]) not in _PAGE_FOLDS:
        return None
    return number(m[2])


def header_parts(line: str) -> tuple[str, int | None]:
    """(what recurs, number in it) of a line that may be a running header."""
    ends = line.replace("|", " ").replace("·", " ").replace("—", " ").replace("–", " ").replace("-", " ").split()
    if not ends or not (_ONE_NUM.fullmatch(ends[0]) or _ONE_NUM.fullmatch(ends[-1])):
        return line, None
    for m, n, rest in ((_LEAD.fullmatch(line), 1, 2), (_TAIL.fullmatch(line), 2, 1)):
        if m and (v := number(m[n])) is not None and (m[n][0].isdigit() or re.search(r"\s{2}|[|·—–]", line)) and _LETTERS.search(m[rest]):
            return m[rest], v
    return line, None


_LETTERS = re.compile(r"(?:[^\W\d_].*?){%d}" % LETTERS, re.S)
_ONE_NUM = re.compile(_NUM)


def may_be_header(line: str) -> bool:
    """Whether a line could recur as a header: letters enough to be told from others, and no end of a sentence."""
    return line.rstrip()[-1:] not in ".!?,;:-‐¬\xad" and bool(_LETTERS.search(line))


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def header_key(line: str) -> tuple[int, int | None] | None:
    if not may_be_header(line):
        return None
    text, n = header_parts(line)
    return _hash(fold(text)), n


def readings(w: str) -> Iterator[str]:
    """What w may have been printed as, were one of its characters taken for another."""
    for a, b in PAIRS:
        i = w.find(a)
        while i >= 0:
            yield w[:i] + b + w[i + len(a) :]
            i = w.find(a, i + 1)


class Trigrams:
    """Shares of hashed trigrams among the distinct words of the collection: an array of fixed size, whatever the alphabets."""

    RARE, COMMON = 2e-6, 6e-5

    def __init__(self, counts: np.ndarray):
        self.counts, self.total = counts, max(1, int(counts.sum()))

    def rarest(self, w: str) -> float:
        """Share of the rarest trigram of a word."""
        s = f" {w} "
        return min(int(self.counts[xxhash.xxh32_intdigest(s[i : i + 3]) % BUCKETS]) for i in range(len(s) - 2)) / self.total


def proposals(w: str, trigrams: Trigrams, lengths: frozenset[int]) -> tuple[list[str], list[str], str | None]:
    """(readings with one character taken for another, with two, a reading that needs no lexicon) of a word that isn't common.

    Readings as long as no word that may be corrected to are left out. Two characters are thought of only where a digit or a trigram that
    hardly any word has shows that something is wrong; a word that no word of the lexicon explains is read with the one change
    that makes its trigrams common ones."""
    digit = any(c.isdigit() for c in w)
    if len(w) < 2 or (len(w) < 3 and not digit):
        return [], [], None
    near = any(len(w) + k in lengths for k in range(-2, 3))
    if not near and not (digit and any(c.isalpha() for c in w)):
        return [], [], None
    first = list(dict.fromkeys(readings(w)))
    second: list[str] = []
    guess = None
    if digit or trigrams.rarest(w) < Trigrams.RARE:
        if len(w) >= 4 and near:
            second = list({y for x in first for y in readings(x) if y != w and len(y) in lengths}.difference(first))
        if len(w) >= 5 and (not digit or re.search(r"[^\W\d_]\d+[^\W\d_]", w)):
            x = max(first, key=trigrams.rarest, default=None)
            if x and not any(c.isdigit() for c in x) and trigrams.rarest(x) >= Trigrams.COMMON:
                guess = x
    return [x for x in first if len(x) > 1 and len(x) in lengths], second, guess


class Words:
    """What a document needs of the collection's words: the common ones, and answers (known, reading, whether that is a word) on others."""

    def __init__(self, common: frozenset[str], answers: dict[str, tuple[bool, str | None, bool]] | None = None):
        self.common, self.answers = common, answers or {}

    def known(self, w: str) -> bool:
        """Whether w, asked for as the whole of a broken word, is a word."""
        return w in self.common or self.answers.get(w, _NO)[0]

    def means(self, w: str) -> bool:
        """Whether w is a word, or a misreading of one."""
        if w in self.common:
            return True
        a = self.answers.get(w, _NO)
        return a[0] or a[2]

    def odd(self, w: str) -> tuple[bool, str | None, bool] | None:
        """The answer on a word of the text that isn't known."""
        a = self.answers.get(w)
        return None if a is None or a[0] else a


_NO = (False, None, False)


_TOKEN = re.compile(r"(?:(?<!\S)!(?=[^\W\d_]))?[^\W_]+(?:[-’!][^\W\d_]+)*")
_BREAK = re.compile(r"([^\W_]+(?:[-’][^\W_]+)*)([-‐­¬])[ \t]*$")
_REST = re.compile(r"[ \t]*([^\W_]+)")
_HYPHENS = frozenset("-‐\xad¬")


def _broken_word(line: str) -> re.Match | None:
    """The match of a word that a hyphen at the end of the line breaks."""
    return _BREAK.search(line) if line.rstrip(" \t")[-1:] in _HYPHENS and line else None


_HIDDEN = re.compile("[​-‏⁠﻿￼\x00-\x08\x0b-\x1f]|\xad(?![^\\S\\n]*(?:\\n|$))")


def _shown(text: str) -> str:
    """text without hidden characters, line by line."""
    return _HIDDEN.sub("", text)


def broken(words: Words, left: str, right: str) -> bool:
    """Whether left and right are one word written without a hyphen, rather than a compound broken at its own."""
    one, two = f"{left}{right}".lower(), f"{left}-{right}".lower()
    if words.known(one):
        return True
    if words.known(two):
        return False
    if words.means(one):
        return True
    if words.answers.get(two, _NO)[1]:
        return False
    return right[0].islower() or left.isupper()


# --- the line model

BODY, BREAK, HEAD, NUMBER = range(4)
#: Values of each feature of a line: place of its block from the top and from the bottom of the page, place in the block, end, first
#: character, length, pages on which it recurs, indentation, and whether it is the page's number.
SIZES = (3, 4, 5, 4, 4, 4, 4, 3, 3)


class LineModel:
    """Hidden Markov model of the lines of a document: features are independent given the state; both tables are counted from labelled lines."""

    def __init__(self, shown: list[list[list[float]]], follows: list[list[float]]):
        log = lambda row: [math.log((x + 0.5) / (sum(row) + 0.5 * len(row))) for x in row]
        self.shown = [[log(values) for values in features] for features in shown]
        self.follows = [log(row) for row in follows]
        flat = [x for row in self.follows for x in row]
        self.swing = 2 * (max(flat) - min(flat))
        self.cache: dict[tuple, tuple[list[float], int]] = {}

    def emission(self, seen: tuple) -> tuple[list[float], int]:
        """(log-probability of the features under each state, the state if no neighbour could change it, else -1)."""
        if (got := self.cache.get(seen)) is None:
            e = [sum(f[k] for f, k in zip(features, seen)) for features in self.shown]
            top = max(range(4), key=e.__getitem__)
            sure = all(e[top] - x > self.swing for t, x in enumerate(e) if t != top)
            got = self.cache[seen] = (e, top if sure else -1)
        return got

    def label(self, lines: list[tuple]) -> list[int]:
        """The most likely states of the lines of a document (Viterbi). Where a line's features outweigh whatever its neighbours may say, the path is known to pass, so that only the stretches between such lines are searched."""
        out: list[int] = []
        score: list[float] = []
        back: list[list[int]] = []

        def close(last: int | None) -> None:
            """States of the open stretch, given the state after it."""
            if not back:
                return
            at = max(range(4), key=score.__getitem__) if last is None else max(range(4), key=lambda s: score[s] + self.follows[s][last])
            path = [at]
            for row in reversed(back[1:]):
                at = row[at]
                path.append(at)
            out.extend(reversed(path))
            back.clear()

        for seen in lines:
            e, sure = self.emission(seen)
            if sure >= 0:
                close(sure)
                out.append(sure)
                continue
            if not back:
                before = self.follows[out[-1]] if out else [0.0] * 4
                score, back = [before[t] + e[t] for t in range(4)], [[0] * 4]
                continue
            step, row = [], []
            for t in range(4):
                k = max(range(4), key=lambda s: score[s] + self.follows[s][t])
                row.append(k)
                step.append(score[k] + self.follows[k][t] + e[t])
            back.append(row)
            score = step
        close(None)
        return out


class Document:
    """The lines of a document with their features and what recurs in it.

    Blocks are (block_id, page, text, x0, y0, x1, y1) in the order of the document; without boxes order stands for place.
    """

    def __init__(self, blocks: list[tuple]):
        self.blocks = blocks
        self.block: list[int] = []
        self.text: list[str] = []
        self.key: list[tuple[int, int | None] | None] = []
        self.lone: list[int | None] = []
        place: list[int] = []
        for i, b in enumerate(blocks):
            parts = _shown(b[2]).split("\n")
            last = len(parts) - 1
            for j, x in enumerate(parts):
                at = 0 if not last else 1 if j == 0 else 2 if j == last else 3 if j == 1 or j == last - 1 else 4
                self.block.append(i)
                self.text.append(x)
                place.append(at)
                n = lone_number(x) if at < 4 else None
                self.lone.append(n)
                self.key.append(header_key(x) if n is None and at < 4 and b[1] >= 2 else None)
        self._recurrence()
        self._features(place)

    def _recurrence(self) -> None:
        pages: dict[int, set[int]] = {}
        for i, k in zip(self.block, self.key):
            if k:
                pages.setdefault(k[0], set()).add(self.blocks[i][1])
        self.pages = {k: len(v) for k, v in pages.items()}
        shifts: dict[int, set[int]] = {}
        tops: dict[int, int] = {}
        for i, k, n in zip(self.block, self.key, self.lone):
            if n is None and k and self.pages[k[0]] >= MIN_PAGES:
                n = k[1]
            page = self.blocks[i][1]
            if n is not None and page:
                shifts.setdefault(n - page, set()).add(page)
                tops[n - page] = max(tops.get(n - page, 0), n)
        # a shift is believed if several pages show it; a single number must not look like a year
        ok = [s for s in shifts if len(shifts[s]) >= MIN_PAGES or tops[s] < 1000]
        self.shift = max(ok, key=lambda s: (len(shifts[s]), -abs(s), s), default=None)

    def _features(self, place: list[int]) -> None:
        by_page: dict[int, list[int]] = {}
        for i, b in enumerate(self.blocks):
            by_page.setdefault(b[1], []).append(i)
        top, bottom = [2] * len(self.blocks), [3] * len(self.blocks)
        self.edge = [False] * len(self.blocks)  # no block of several lines above, or none below, by boxes or by order
        several = ["\n" in b[2] for b in self.blocks]
        for ids in by_page.values():
            boxed = all(self.blocks[i][4] is not None and self.blocks[i][6] is not None for i in ids)
            down = sorted(ids, key=lambda i: self.blocks[i][4]) if boxed else ids
            up = sorted(ids, key=lambda i: -self.blocks[i][6]) if boxed else ids[::-1]
            for rank, most, order in ((top, 2, down), (bottom, 3, up)):
                for r, i in enumerate(order):
                    rank[i] = min(r, most)
            for order in (down, up, ids, ids[::-1]):  # boxes overlap on skewed scans, so that order counts as well
                for i in order:
                    self.edge[i] = True
                    if several[i]:
                        break
        margin = min((b[3] for b in self.blocks if b[3] is not None), default=None)
        indent = [2 if b[3] is None or margin is None else int(b[3] - margin > 15) for b in self.blocks]
        self.seen: list[tuple] = []
        for i, x, at, k, n in zip(self.block, self.text, place, self.key, self.lone):
            s = x.strip()
            first, end = s[:1], s[-1:]
            ends = 0 if _broken_word(x) else 1 if end in _STOPS and end else 2 if end else 3
            starts = 0 if first.isupper() else 1 if first.islower() else 2 if first.isdigit() else 3
            size = 0 if len(s) <= 12 else 1 if len(s) <= 40 else 2 if len(s) <= 70 else 3
            recurs = 0 if k is None else min(self.pages[k[0]], 3)
            number = 0 if n is None else 1 if self.shift is not None and n - self.blocks[i][1] == self.shift else 2
            self.seen.append((top[i], bottom[i], at, ends, starts, size, recurs, indent[i], number))

    def taught(self) -> list[int]:
        """States of the lines by recurrence alone, to count the model from."""
        return [
            HEAD if s[6] == 3 and s[2] < 3 and (s[0] == 0 or s[1] < 3) else NUMBER if s[8] == 1 and s[2] < 3 and (s[0] == 0 or s[1] < 3) else BREAK if s[3] == 0 else BODY for s in self.seen
        ]

    def marks(self, model: LineModel) -> list[tuple[int, int, int, int | None, int | None]]:
        """(block, line in it, state, key, number) of headers and page numbers: lines the model labels so, and that stand a check.

        A header stands above or below all blocks of several lines but its own and recurs, labelled so, on at least MIN_PAGES pages; a number is that of its page with the document's shift."""
        states = [BODY if s == HEAD and not self.edge[i] else s for s, i in zip(model.label(self.seen), self.block)]
        pages: dict[int, set[int]] = {}
        for s, i, k in zip(states, self.block, self.key):
            if s == HEAD and k:
                pages.setdefault(k[0], set()).add(self.blocks[i][1])
        out, line, at = [], -1, -1
        for s, i, k, n, f in zip(states, self.block, self.key, self.lone, self.seen):
            line, at = (line + 1, at) if i == at else (0, i)
            if s == HEAD and k and len(pages[k[0]]) >= MIN_PAGES:
                out.append((i, line, HEAD, k[0], k[1]))
            elif s == NUMBER and f[8] == 1:
                out.append((i, line, NUMBER, None, n))
        return out


_STOPS = frozenset(".!?…:;,")


def body_lines(blocks: list[str], marked: dict[tuple[int, int], tuple]) -> list[tuple[int, str]]:
    """(block, text) of the lines that are neither header nor page number."""
    return [(i, x) for i, t in enumerate(blocks) for j, x in enumerate(_shown(t).split("\n")) if (i, j) not in marked]


def breaks(body: list[tuple[int, str]]) -> Iterator[tuple[int, re.Match, list[tuple[int, re.Match]]]]:
    """(body line, its broken word, where it may go on) of each line that ends in a hyphen.

    A word broken within a block goes on at the next line; one broken at the end of a block at the next line, or, as nothing says how much stands between, at one of the first three lines of any later block that begins in the same case.
    """
    starts: list[tuple[int, re.Match, bool]] = []  # the first three lines of each block, with their first word, and whether that is in lower case
    at, n = -1, 0
    for q, (i, x) in enumerate(body):
        at, n = (at, n + 1) if i == at else (i, 0)
        if n < 3 and (r := _REST.match(x)):
            starts.append((q, r, r[1][0].islower()))
    order = [s[0] for s in starts]
    for q, (i, x) in enumerate(body):
        if not (m := _broken_word(x)):
            continue
        options = []
        if q + 1 < len(body) and (r := _REST.match(body[q + 1][1])):
            options.append((q + 1, r))
        if q + 1 < len(body) and body[q + 1][0] != i:
            low = not m[1].isupper()
            options += [(q2, r) for q2, r, lower in starts[bisect_right(order, q + 1) :] if lower == low]
        yield q, m, options


def questions(texts: list[str], marks: list[tuple], common: frozenset[str]) -> tuple[set[str], set[str]]:
    """(words of a document, wholes of broken words) that aren't common: what has to be asked of the lexicon."""
    marked = {(b, j): m for b, j, *m in marks}
    body = body_lines(texts, marked)
    words = {w for t in texts for w in _TOKEN.findall(_shown(t).lower())}
    wholes: set[str] = set()
    for q, m, options in breaks(body):
        a = m[1].lower()
        for k, (_, r) in enumerate(options):
            wholes.add(a + r[1].lower())
            if k == 0:
                wholes.add(f"{a}-{r[1].lower()}")
                words.add(f"{a}-{r[1].lower()}")
    words = {w for w in words if w not in common and not w.isdigit() and any(map(str.isalpha, w))}
    return words, wholes - common


def repair(words: Words, blocks: list[tuple[int, int, str]], marks: list[tuple], shift: int | None) -> list[tuple[int, set[str], str]]:
    """(block_id, noise, text) of the blocks (block_id, page, text) of a document in order, given its headers and page numbers."""
    marked = {(b, j): m for b, j, *m in marks}
    noise: list[set[str]] = [set() for _ in blocks]
    text: list[list[str]] = [[] for _ in blocks]
    for (i, j), (state, _, n) in marked.items():
        if state == HEAD:
            noise[i].add("header")
            if n is not None and shift is not None and n - blocks[i][1] == shift:
                noise[i].add("page_no")
            if _misread(words, _shown(blocks[i][2]).split("\n")[j]):
                noise[i].add("misread")
        else:
            noise[i].add("page_no")
    body = body_lines([b[2] for b in blocks], marked)
    moved: dict[int, int] = {}  # body line -> characters that a word of an earlier line took
    joins: dict[int, tuple[int, str]] = {}  # body line -> where its broken word begins, what stands for it
    for q, m, options in breaks(body):
        if not options:
            continue
        a = m[1]
        near = options[0]
        best = next((o for o in options if o[0] not in moved and words.means((a + o[1][1]).lower())), near if near[0] == q + 1 else None)
        if best is None or best[0] in moved or m.start() < moved.get(q, 0):
            continue
        r = best[1]
        if broken(words, a, r[1]):
            noise[body[q][0]].add("hyphen")
            joins[q] = (m.start(), a + r[1])
            moved[best[0]] = r.end()
        elif body[best[0]][0] == body[q][0] and words.known(f"{a}-{r[1]}".lower()):
            joins[q] = (m.start(), f"{a}{m[2]}{r[1]}")  # a compound: keep its hyphen, drop the line break
            moved[best[0]] = r.end()
    for q, (i, x) in enumerate(body):
        if q in joins:
            x = x[: joins[q][0]] + joins[q][1]
        text[i].append(x[moved.get(q, 0) :])
    out = []
    for (block, _, _), kinds, ls in zip(blocks, noise, text):
        joined = " ".join(x.strip() for x in ls if x.strip())
        if fixed := _misread(words, joined):
            kinds.add("misread")
            joined = fixed
        out.append((block, kinds, joined))
    return out


_HEADED = re.compile(r"[^\W\d_]{2,}(?:-[^\W\d_]+)*\d{1,2}")


def _misread(words: Words, text: str) -> str | None:
    """text with its misread words corrected, or None if there are none; text of few known words is no text to correct."""
    answers = words.answers
    if not any(w in answers and answers[w][1] for w in _TOKEN.findall(text.lower())):
        return None
    tokens = [m for m in _TOKEN.finditer(text) if not m.group().isdigit()]
    low = [m.group().lower() for m in tokens]
    odd = [(k, a) for k, w in enumerate(low) if w not in words.common and (a := words.odd(w))]
    if not odd or (len(low) - len(odd)) * 4 < len(low):
        return None
    fixes = [(k, a[1]) for k, a in odd if a[1]]
    if not fixes:
        return None
    if not text.isascii():
        if restore(text)[1]:
            return None
        fixes = [(k, f) for k, f in fixes if (r := readable(low[k])) == low[k] or not words.known(r)]
    # words and numbers set together, as in the head of a table, are no misreading
    if sum(bool(_HEADED.fullmatch(w)) for w in low) >= 3:
        fixes = [(k, f) for k, f in fixes if not _HEADED.fullmatch(low[k])]
    if not fixes:
        return None
    out, at = [], 0
    for k, f in fixes:
        m = tokens[k]
        w = m.group()
        f = f.upper() if len(w) > 1 and w.isupper() else f[:1].upper() + f[1:] if w[0].isupper() else f
        out += [text[at : m.start()], f]
        at = m.end()
    return "".join([*out, text[at:]])


# --- the collection's words

#: A word is common with a COMMON-th of all words (there are at most COMMON such words) and SEEN times or more; others are known if seen SEEN
#: times or more, unless a reading of them is TIMES as frequent. Words are corrected to those seen ENOUGH times, or common.
COMMON, SEEN, TIMES, ENOUGH = 50_000, 5, 20, 20


def collection_words(blocks: DataFrame) -> DataFrame:
    """(w, n): all words of all blocks and how often each is seen; materialised."""
    w = blocks.select(F.explode(F.regexp_extract_all(F.lower("raw_text"), F.lit(WORDS), 0)).alias("w"))
    return cut(w.groupBy("w").agg(F.count("*").alias("n")))


def _gram_counts(b: dict) -> dict:
    counts = Counter(xxhash.xxh32_intdigest(s[i : i + 3]) % BUCKETS for w in b["w"] for s in (f" {w} ",) for i in range(len(s) - 2))
    return {"g": list(counts), "c": list(counts.values())}


def trigram_counts(words: DataFrame) -> np.ndarray:
    """Trigrams of all words seen twice or more, each word once, in BUCKETS hashed buckets."""
    out = np.zeros(BUCKETS, np.int64)
    grams = arrow_map(words.where("n >= 2 and length(w) >= 2").select("w"), _gram_counts, "g int, c long")
    for r in grams.groupBy("g").agg(F.sum("c").alias("c")).collect():  # a row per bucket at most
        out[r.g] = r.c
    return out


def answers(asked: DataFrame, words: DataFrame, trigrams: np.ndarray, common: int) -> DataFrame:
    """(w, known, fix, sure) of distinct words w that aren't common: fix is what w was printed as, sure if that is a word of the collection.

    Words and their readings are joined with the full lexicon; nothing of it is sent to tasks.
    """
    enough = min(ENOUGH, common)
    targets = words.where(F.col("n") >= enough)
    lengths = frozenset(r[0] for r in targets.select(F.length("w")).distinct().collect())  # a row per length of a word
    grams = asked.sparkSession.sparkContext.broadcast(trigrams)

    def read(b: dict) -> dict:
        t = Trigrams(grams.value)
        out: dict[str, list] = {k: [] for k in ("w", "n", "ord", "y")}
        for w, n in zip(b["w"], b["n"]):
            first, second, guess = proposals(w, t, lengths)
            for ord_, ys in ((0, (guess,)), (1, first), (2, second)):
                for y in ys:
                    out["w"].append(w)
                    out["n"].append(n)
                    out["ord"].append(ord_)
                    out["y"].append(y)
        return out

    counted = asked.join(words, "w", "left").select("w", F.coalesce("n", F.lit(0)).alias("n"))
    rows = arrow_map(counted, read, "w string, n long, ord int, y string")
    seen = targets.select(F.col("w").alias("y"), F.col("n").alias("ny"))
    rows = rows.join(seen, "y", "left").where("ord = 0 or ny is not null")
    best = lambda k: F.max(F.when(F.col("ord") == k, F.struct("ny", "y")))
    g = rows.groupBy("w").agg(F.first("n").alias("n"), best(1).alias("one"), best(2).alias("two"), F.max(F.when(F.col("ord") == 0, F.col("y"))).alias("guess"))
    known = (F.col("n") >= SEEN) & ~F.coalesce(F.col("one.ny") >= TIMES * F.col("n"), F.lit(False))
    fix = F.coalesce("one.y", "two.y", "guess")
    return g.select("w", known.alias("known"), F.when(~known, fix).alias("fix"), (~known & F.coalesce("one.y", "two.y").isNotNull()).alias("sure"))


def scanned(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """The blocks of the documents named: doc_id, page, ord, block_id, site, t, x0, y0, x1, y1; boxes may be missing."""
    b = blocks.where("block_id is not null and doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("page_number").cast("int").alias("page"), F.col("block_ord").cast("int").alias("ord"), F.col("block_id").cast("long").alias("block_id"), "site", F.coalesce("raw_text", F.lit("")).alias("t"),
        *((F.col(c) if c in blocks.columns else F.lit(None)).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")),
    )
    return b.join(ids, "doc_id", "left_semi")


# --- the operator

def partitions(df: DataFrame, rows: int) -> int:
    """Tasks for work that is slow by row: several a core, and no more rows than ROWS in one."""
    return max(3 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS))


def by_document(df: DataFrame, tasks: int, order: list[str], fn: Callable[[int, list[tuple]], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """fn of (doc_id, its rows in order) for each document; a document is one group, documents are streamed."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        out: list[list] = [[] for _ in schema]

        def close() -> None:
            for row in fn(at, rows):
                for c, v in zip(out, row):
                    c.append(v)

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for doc, *row in zip(*(batch.column(i).to_pylist() for i in range(len(columns)))):
                if doc != at:
                    if rows:
                        close()
                        if len(out[0]) >= 5_000:
                            yield flush()
                    at, rows = doc, []
                rows.append(tuple(row))
        if rows:
            close()
        yield flush()

    return df.repartition(tasks, "doc_id").sortWithinPartitions("doc_id", *order).mapInArrow(run, ddl)


def _as_document(rows: list[tuple]) -> tuple[Document, str | None]:
    """Rows are (page, ord, block_id, site, t, x0, y0, x1, y1); a block that is repeated counts once."""
    blocks: list[tuple] = []
    for page, _, block, _, t, *box in rows:
        if not blocks or blocks[-1][0] != block:
            blocks.append((block, page if page is not None else 0, t, *box))
    return Document(blocks), rows[0][3]


def fit(ocr: DataFrame, tasks: int, documents: int) -> LineModel:
    """The line model, counted on at most about SAMPLE_DOCS documents, chosen by hash, whose lines are labelled by recurrence.

    Only counts come back: a row per state, feature and value."""
    every = max(1, -(-documents // SAMPLE_DOCS))
    sample = ocr.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)

    def count(_: int, rows: list[tuple]) -> Iterator[tuple]:
        d, _ = _as_document(rows)
        states = d.taught()
        c = Counter((s, f, v) for s, seen in zip(states, d.seen) for f, v in enumerate(seen))
        c.update((s, -1, t) for s, t in zip(states, states[1:]))
        return ((0, s, f, v, n) for (s, f, v), n in c.items())

    schema = pa.schema([("doc_id", pa.int64()), ("s", pa.int32()), ("f", pa.int32()), ("v", pa.int32()), ("n", pa.int64())])
    rows = by_document(sample, min(tasks, 64), ["page", "ord", "block_id"], count, schema, "doc_id long, s int, f int, v int, n long").groupBy("s", "f", "v").agg(F.sum("n").alias("n")).collect()
    shown = [[[0.0] * n for n in SIZES] for _ in range(4)]
    follows = [[0.0] * 4 for _ in range(4)]
    for r in rows:
        if r.f < 0:
            follows[r.s][r.v] = r.n
        else:
            shown[r.s][r.f][r.v] = r.n
    return LineModel(shown, follows)


_MARK = pa.list_(pa.struct([("line", pa.int32()), ("state", pa.int32()), ("key", pa.int64()), ("number", pa.int32())]))
_READ = pa.schema([("doc_id", pa.int64()), ("kind", pa.int32()), ("block_id", pa.int64()), ("page", pa.int32()), ("ord", pa.int32()), ("t", pa.string()), ("site", pa.string()), ("key", pa.int64()), ("shift", pa.int32()), ("marks", _MARK)])
_READ_DDL = "doc_id long, kind int, block_id long, page int, ord int, t string, site string, key long, shift int, marks array<struct<line:int,state:int,key:long,number:int>>"
TEXT, WORD, WHOLE, HEADER = range(4)  # kinds of rows


def read(ocr: DataFrame, tasks: int, model: LineModel, common: frozenset[str]) -> DataFrame:
    """Of each document its blocks with the marks of their lines, the words to ask for, and its headers. Materialised, so that texts are read once."""
    sent = ocr.sparkSession.sparkContext.broadcast((model, common))

    def one(doc: int, rows: list[tuple]) -> Iterator[tuple]:
        model, common = sent.value
        d, site = _as_document(rows)
        marks = d.marks(model)
        by: dict[int, list] = {}
        for b, *m in marks:
            by.setdefault(b, []).append(tuple(m))
        for i, b in enumerate(d.blocks):
            yield doc, TEXT, b[0], b[1], i, b[2], None, None, d.shift, by.get(i)
        heads = {m[3]: d.blocks[m[0]][2].split("\n")[m[1]] for m in marks if m[2] == HEAD}
        for key, line in heads.items():
            yield doc, HEADER, None, None, None, line, site, key, None, None
        words, wholes = questions([b[2] for b in d.blocks], marks, common)
        for kind, ws in ((WORD, words), (WHOLE, wholes)):
            for w in ws:
                yield doc, kind, None, None, None, w, None, None, None, None

    return cut(by_document(ocr, tasks, ["page", "ord", "block_id"], one, _READ, _READ_DDL))


def repaired(blocks: DataFrame, structures: DataFrame) -> DataFrame:
    """(doc_id, block_id, noise, normalized_text) of each block of ocr_fallback documents; noise is an array, empty without any.

    Null text counts as empty, repeated blocks once; blocks without a page are taken as of page 0 and have no header. Rows without a document or block id are left out.
    """
    ship(blocks.sparkSession)
    ids = structures.where("strategy = 'ocr_fallback' and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    words = collection_words(blocks)
    total = words.agg(F.sum("n")).first()[0] or 0
    share = max(SEEN, -(-total // COMMON))
    common = frozenset(r.w for r in words.where(F.col("n") >= share).select("w").collect()) if total else frozenset()  # at most COMMON words have such a share
    ocr = scanned(blocks, ids)
    documents, rows = ids.count(), blocks.count()
    tasks = partitions(blocks, rows)
    asked = read(ocr, tasks, fit(ocr, tasks, documents), common)
    # headers that are lines of the site
    heads = asked.where(F.col("kind") == HEADER).select("doc_id", "site", "key", F.xxhash64(boilerplate.line_key(F.col("t"))).alias("h"))
    nodes = boilerplate.support(blocks, among=heads.select("site", "h").distinct()).select("site", "h")
    sites = heads.join(nodes, ["site", "h"], "left_semi").groupBy("doc_id").agg(F.collect_set("key").alias("sites"))  # a row per running header of a document
    # words
    questions = asked.where(F.col("kind").isin(WORD, WHOLE)).select("doc_id", "kind", F.col("t").alias("w"))
    got = answers(questions.select("w").distinct(), words, trigram_counts(words), share)
    told = questions.join(got, "w").where((F.col("kind") == WORD) & ~F.col("known") | (F.col("kind") == WHOLE) & (F.col("known") | F.col("fix").isNotNull()))
    told = told.groupBy("doc_id").agg(F.collect_set(F.struct("w", "known", "fix", "sure")).alias("told"))  # the odd words of a document
    facts = told.join(sites, "doc_id", "full_outer")
    text = asked.where(F.col("kind") == TEXT)
    none = {"told": F.lit(None).cast("array<struct<w:string,known:boolean,fix:string,sure:boolean>>"), "sites": F.lit(None).cast("array<long>")}
    cols = ("doc_id", "kind", "ord", "block_id", "page", "t", "shift", "marks", "told", "sites")
    lead = facts.select("doc_id", F.lit(-1).alias("kind"), F.lit(-1).alias("ord"), F.lit(None).cast("long").alias("block_id"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("t"), F.lit(None).cast("int").alias("shift"), F.lit(None).cast(text.schema["marks"].dataType).alias("marks"), "told", "sites")
    every = text.withColumns(none).select(*cols).unionByName(lead.select(*cols))
    sent = blocks.sparkSession.sparkContext.broadcast(common)

    def mend(doc: int, rows: list[tuple]) -> Iterator[tuple]:
        known, sites = {}, set()
        if rows[0][0] < 0:
            known = {a["w"]: (a["known"], a["fix"], a["sure"]) for a in rows[0][7] or ()}
            sites = set(rows[0][8] or ())
            rows = rows[1:]
        marks = [(i, m["line"], m["state"], m["key"], m["number"]) for i, r in enumerate(rows) for m in r[6] or () if m["state"] != HEAD or m["key"] not in sites]
        for block, kinds, text in repair(Words(sent.value, known), [(r[2], r[3], r[4]) for r in rows], marks, rows[0][5] if rows else None):
            yield doc, block, sorted(kinds), text

    schema = pa.schema([("doc_id", pa.int64()), ("block_id", pa.int64()), ("noise", pa.list_(pa.string())), ("normalized_text", pa.string())])
    return by_document(every, tasks, ["kind", "ord"], mend, schema, "doc_id long, block_id long, noise array<string>, normalized_text string")


def noise(blocks: DataFrame, structures: DataFrame) -> DataFrame:
    """Distinct (block_id, noise), a row per kind of noise in a block."""
    return repaired(blocks, structures).select("block_id", F.explode("noise").alias("noise")).distinct()


def paragraphs(blocks: DataFrame, structures: DataFrame) -> DataFrame:
    """(doc_id, block_id, normalized_text): the repaired paragraphs; blocks of nothing but headers and page numbers are empty."""
    return repaired(blocks, structures).select("doc_id", "block_id", "normalized_text")

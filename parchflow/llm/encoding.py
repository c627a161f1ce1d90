"""Problem 6: text decoded with a wrong encoding.

Characters are mapped back to the bytes of a legacy code page, an automaton over the structure of UTF-8 finds
the maximal well-formed multibyte spans, and only those spans are decoded, again and again for text that was
garbled more than once. Text whose bytes were single-byte on both sides has no such structure; there the words
that no language of the collection could write are mapped from one code page to another, and the pair of pages
is taken whose words are all possible, for the whole text or else for each span. Bytes lost to U+FFFD are reported, not restored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchflow.llm.normal import LOOKALIKES, canonical
from parchflow.runtime import arrow_map, cut

PAGES = ("cp1252", "mac_roman", "cp850", "cp437", "cp1251", "koi8_r", "cp866")
# Letters beyond a-z of the languages of the collection, and marks of printed text.
LETTERS = "àáâãäæçèéêëìíîïñòóôõöœùúûüÿß"
RUSSIAN = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
MARKS = "–—‘’‚“”„•…‹›«»¿¡ºª°§©®™£€½¼¾²³·№ \xad"
# Frequencies of the letters of Russian, in parts of a thousand, in the order of RUSSIAN.
RUSSIAN_FREQUENCY = (80, 16, 45, 17, 30, 84, 1, 9, 16, 74, 12, 35, 44, 32, 67, 110, 28, 47, 55, 63, 26, 3, 10, 5, 14, 7, 4, 1, 19, 17, 3, 6, 20)
POSSIBLE = frozenset(LETTERS + LETTERS.upper().replace("SS", "") + RUSSIAN + RUSSIAN.upper() + MARKS)


@lru_cache(maxsize=None)
def to_byte(page: str) -> dict[str, int]:
    """Character to byte above 0x7F. Bytes without a character in cp1252 stand for themselves, as browsers read them."""
    m = {}
    for b in range(0x80, 0x100):
        try:
            m[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            m[chr(b)] = b
    if page == "cp1252":
        m |= {chr(b): b for b in range(0x80, 0xA0)}
    return m


def _cls(m: dict[str, int], lo: int, hi: int) -> str:
    return "".join(re.escape(c) for c, b in m.items() if lo <= b <= hi)


@lru_cache(maxsize=None)
def automaton(page: str) -> re.Pattern:
    """Well-formed multibyte sequences of UTF-8 in the characters of a page, as many as follow each other."""
    m = to_byte(page)
    cont = f"[{_cls(m, 0x80, 0xBF)}]"
    one = (
        f"[{_cls(m, 0xC2, 0xDF)}]{cont}|[{_cls(m, 0xE0, 0xE0)}][{_cls(m, 0xA0, 0xBF)}]{cont}|[{_cls(m, 0xE1, 0xEC)}{_cls(m, 0xEE, 0xEF)}]{cont}{{2}}"
        f"|[{_cls(m, 0xED, 0xED)}][{_cls(m, 0x80, 0x9F)}]{cont}|[{_cls(m, 0xF0, 0xF0)}][{_cls(m, 0x90, 0xBF)}]{cont}{{2}}|[{_cls(m, 0xF1, 0xF3)}]{cont}{{3}}"
    )
    return re.compile(f"(?:{one})+")


@lru_cache(maxsize=None)
def start(page: str) -> re.Pattern:
    """A first and a second character of a multibyte sequence: without one the automaton needn't run."""
    m = to_byte(page)
    return re.compile(f"[{_cls(m, 0xC2, 0xF3)}][{_cls(m, 0x80, 0xBF)}]")


CYRILLIC_PAGES = ("cp1251", "koi8_r", "cp866")


def _plausible(span: str, page: str, match: re.Match) -> bool:
    """Whether a decoded span may have been written: all of its characters may, and what it was read as is no text that may stand by itself."""
    raw = match.group()
    if page in CYRILLIC_PAGES:
        if not all(c in POSSIBLE or c in LOWER_MARKS or c in to_byte("cp1252") for c in span):
            return False
        if page != "cp1251" and raw.isalpha() and not all(c in MARKS for c in span):
            # letters alone are odd only where they touch letters of another alphabet that they don't resemble
            text, at, end = match.string, match.start(), match.end()
            beside = (text[at - 1] if at else " ") + (text[end] if end < len(text) else " ")
            return any(c.isascii() and c.isalpha() for c in beside) and not any(c in LOOKALIKES for c in raw)
        # one pair of Cyrillic letter and mark or space is common in Russian text
        return any(c.isalpha() or c in "–—“”’" for c in span) and not re.fullmatch("[А-Яа-яё][\xa0«»]", raw)
    if page != "cp1252" and len(span) < 3 and raw.isalpha() and any("Ѐ" <= c <= "ӿ" for c in span):
        return False
    return all(c in POSSIBLE or c in to_byte("cp1252") or c in to_byte("mac_roman") or c in to_byte("cp850") or c in to_byte("cp437") for c in span)


LOWER_MARKS = frozenset(" \n")
UTF16 = re.compile(r"[\x01-\xff]\x00(?:[\x01-\xff]\x00|[\x00-\xff]\x20(?=[^\x00]\x00)|[\x00-\xff]\x04){3,}|(?:\x00[\x01-\xff]){4,}|(?:[\x00-\xff]\x04| \x00){5,}")
def _decoded(text: str, page: str) -> tuple[str, int]:
    """(text with the well-formed spans of a page decoded, characters of them)."""
    m, took = to_byte(page), 0

    def decode(match: re.Match) -> str:
        nonlocal took
        raw = match.group()
        span = bytes(m[c] for c in raw).decode("utf-8")
        if not _plausible(span, page, match):
            return raw
        took += len(raw)
        return span

    return automaton(page).sub(decode, text), took


def multibyte(text: str) -> str:
    """text with its well-formed multibyte spans decoded, by the page first that explains most characters, until none is left: every
    decoding shortens the text."""
    while True:
        best, most = text, 0
        for page in PAGES:
            if start(page).search(text):
                new, took = _decoded(text, page)
                if took > most:
                    best, most = new, took
        if not most:
            return text
        text = best


def utf16(text: str) -> str:
    def decode(match: re.Match) -> str:
        raw = match.group()
        data = raw.encode("latin-1")
        return data[: len(data) // 2 * 2].decode("utf-16-be" if raw[0] == "\x00" else "utf-16-le", "replace") + ("" if len(data) % 2 == 0 else raw[-1])

    return UTF16.sub(decode, text)


#: A word with the marks inside it that wrong code pages put in the place of letters.
TOKEN = re.compile(r"[^\s.,;:!?()\[\]{}\"/|\\<>=+*#&@^~`$%\x00-\x1f-]+")
INVISIBLE = re.compile("[\xad​-‏⁠﻿￼\x00-\x08\x0b-\x1f]")
_EDGE = "«»“”‘’„‚‹›–—•…¿¡·©®£€§°ºª½¼¾²³№™\xa0-'_¬"
_IMPOSSIBLE = re.compile(rf"[^\x00-\x7f{LETTERS}{LETTERS.upper()}{RUSSIAN}{RUSSIAN.upper()}’‘º·]")
_INNER = re.compile(rf"[a-z{LETTERS}][·º](?=[a-z])|[a-z{LETTERS}][{''.join(c for c in LETTERS.upper() if c not in 'SS')}]|[À-ÿ]{{3}}|[{RUSSIAN}][{RUSSIAN.upper()}]|[A-Za-z][{RUSSIAN}{RUSSIAN.upper()}]{{2}}[a-z]")
#: What odd words hold, as patterns that begin with their rarest character.
_FAST = tuple(
    re.compile(x)
    for x in (
        rf"[\x80-\x9f]|[^\x00-\x7f{LETTERS}{LETTERS.upper()}{RUSSIAN}{RUSSIAN.upper()}{re.escape(MARKS)}]",
        rf"[½¼¾²³®©™£€„‚•…§°«‹›“”¡¿·º](?<=[a-z{LETTERS}].)(?=[a-z])",
        rf"[{''.join(c for c in LETTERS.upper() if c not in 'SS')}](?<=[a-z{LETTERS}].)",
        "[À-ÿ](?=[À-ÿ]{2})",
        rf"[{RUSSIAN.upper()}](?<=[{RUSSIAN}].)|[„‚ŽðÐþÞñÑõÕ](?<=\s.)(?=[a-z\s])",
        "[А-яЁё]{2}(?<=[A-Za-z]..)(?=[a-z])",
    )
)
_log = {c: math.log(n / 1085) for c, n in zip(RUSSIAN, RUSSIAN_FREQUENCY)}


def odd_words(text: str) -> list[str]:
    """Words that no language of the collection could write, without invisible and look-alike characters."""
    out = []
    for m in TOKEN.finditer(text):
        w = m.group()
        if w.isascii():
            continue
        core = w.strip(_EDGE)
        if _odd(core):
            out.append(w)
    return out


#: Letters that are words, or may stand alone.
ALONE = frozenset("éèàóáêòìÉÈÀÓÁÊ" + RUSSIAN + RUSSIAN.upper())


def _odd(core: str) -> bool:
    if len(core) == 1 and core.isalpha() and core not in ALONE and not core.isascii() and core in POSSIBLE:
        return True
    return bool(core) and not core.isascii() and bool(_IMPOSSIBLE.search(core) or _INNER.search(core))


@lru_cache(maxsize=None)
def repage(read: str, true: str) -> dict[int, str]:
    """What stood for what, where bytes of page `true` were read by page `read`."""
    out = {}
    for c, b in to_byte(read).items():
        try:
            out[ord(c)] = bytes([b]).decode(true)
        except UnicodeDecodeError:
            pass
    return out


#: (read as, written as)
PAIRS = tuple((r, t) for r in PAGES for t in ("cp1252", "mac_roman", "cp850", "cp1251", "koi8_r", "cp866") if r != t and not (r == "cp437" and t == "cp850"))


def _known(words: list[str], table: dict[int, str], lexicon: frozenset[str]) -> int:
    """How many of some words are words of the collection when read by a pair of pages."""
    return sum(w.translate(table).strip(_EDGE).lower() in lexicon for w in words)


def _fits(words: list[str], table: dict[int, str]) -> bool:
    for w in words:
        new = w.translate(table)
        core = new.strip(_EDGE)
        if new == w or _odd(core) or any(ord(c) > 0x7F and c not in POSSIBLE for c in new):
            return False
        if re.search("[a-zA-ZÀ-ÿ]", core) and re.search("[Ѐ-ӿ]", core):
            return False
    return True


def _russian(text: str) -> float:
    """Mean log-likelihood of the Cyrillic letters."""
    v = [_log[c] for c in text.lower() if c in _log]
    return sum(v) / len(v) if v else -9.0


SENTENCE = re.compile(r"[^.!?\n]+[.!?]*\s*|\n")
NOT_RUSSIAN = re.compile("[\u0400\u0402-\u040f\u0450\u0452-\u04ff\xa4\xa6](?:(?=[А-я])|(?<=[А-я].))")
CASE_TURN = re.compile(rf"[{RUSSIAN.upper()}](?<=[{RUSSIAN}].)")


def swapped_cyrillic(text: str) -> str:
    """Sentences of one Cyrillic page read by another: kept where letters are clearly more Russian after the change."""

    def fix(m: re.Match) -> str:
        s = m.group()
        if not CASE_TURN.search(s) and not NOT_RUSSIAN.search(s):
            return s
        best, score = s, _russian(s) + 0.25
        for read, true in (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8_r", "cp866"), ("cp866", "koi8_r")):
            new = s.translate(repage(read, true))
            if (x := _russian(new)) > score and len(re.findall(f"[{RUSSIAN}]", new)) * 2 > len(re.findall("[^\\W\\d_a-zA-Z]", new)):
                best, score = new, x
        return best

    return SENTENCE.sub(fix, text)


def by_spans(text: str, odd: list[str], lexicon: frozenset[str] = frozenset()) -> str:
    """text of odd words for which no single pair does. A sentence is read by a pair under which all of its odd words are possible, of several
    by that which fits most odd words of the text; where no pair fits them all, its odd words are read one by one. Others stay."""
    fits = {w: [k for k, (r, t) in enumerate(PAIRS) if _fits([w], repage(r, t))] for w in dict.fromkeys(odd)}
    votes = Counter(k for w in odd for k in fits[w])
    heard = {k: _known(odd, repage(*PAIRS[k]), lexicon) for k in votes}
    best = lambda ks: repage(*PAIRS[max(ks, key=lambda k: (heard[k], votes[k], -k))])

    def fix(m: re.Match) -> str:
        s = m.group()
        if not (here := [w for w in fits if w in s]):
            return s
        if all_of := set.intersection(*(set(fits[w]) for w in here)):
            return s.translate(best(all_of))
        return TOKEN.sub(lambda x: x.group().translate(best(fits[x.group()])) if fits.get(x.group()) else x.group(), s)

    return SENTENCE.sub(fix, text)


def single_byte(text: str, lexicon: frozenset[str] = frozenset()) -> str:
    """text with the spans of odd words read by the pair of pages under which all of them are possible, of several such pairs
    that which gives most words of the collection; where there is none, span by span."""
    plain = INVISIBLE.sub("", text)
    odd = odd_words(plain)
    c1 = re.search("[\x80-\x9f]", plain)
    if not odd and not c1:
        return text
    odd = [w for w in odd if _odd(canonical(w).strip(_EDGE)) and not _lookalike(w)]
    if odd:
        fit = [repage(r, t) for r, t in PAIRS if _fits(odd, repage(r, t))]
        if fit:
            table = max(fit, key=lambda t: _known(odd, t, lexicon)) if len(fit) > 1 and lexicon else fit[0]

            def fix(m: re.Match) -> str:
                s = m.group()
                return s.translate(table) if any(w in s for w in odd) else s

            return SENTENCE.sub(fix, text)
        if (new := by_spans(text, odd, lexicon)) != text:
            return new
    if c1:
        new = re.sub("[\x80-\x9f]", lambda m: repage("cp1252", "cp1252").get(ord(m.group()), m.group()), text)
        return new if not re.search("[\x80-\x9f]", new) else text
    return text


def _lookalike(w: str) -> bool:
    """Letters of two alphabets in one word, where those of one have the shape of the other's: no matter of encoding."""
    foreign = [c for c in w if "Ͱ" <= c <= "ӿ"]
    return bool(foreign) and bool(re.search("[A-Za-zÀ-ÿ]", w)) and all(c in LOOKALIKES for c in foreign)


#: How the text of a row was found to be decoded wrongly.
MULTIBYTE, UTF_16, SINGLE, LOST = "multibyte", "utf16", "single_byte", "lost"


def restore_by(text: str | None, lexicon: frozenset[str] = frozenset()) -> tuple[str | None, list[str]]:
    """(the text restored as far as can be, the ways in which it was found to be decoded wrongly)."""
    if not text or (text.isascii() and "\x00" not in text):
        return text, []
    ways = []

    def step(way: str, new: str) -> str:
        if new != text and way not in ways:
            ways.append(way)
        return new

    if "\x00" in text:
        text = step(UTF_16, utf16(text))
        if text.isascii():
            return text, ways
    if "�" in text:
        ways.append(LOST)
    text = step(MULTIBYTE, multibyte(text))
    if CASE_TURN.search(text) or NOT_RUSSIAN.search(text):
        text = step(SINGLE, swapped_cyrillic(text))
    plain = INVISIBLE.sub("", text)
    if any(x.search(plain) for x in _FAST):
        text = step(SINGLE, single_byte(text, lexicon))
    return text, ways


def restore(text: str | None) -> tuple[str | None, bool]:
    """(the text restored as far as can be, whether some of it was decoded wrongly)."""
    new, ways = restore_by(text)
    return new, bool(ways)


_WORD = re.compile(r"[^\W\d_]+")


def is_sure(before: str, after: str, ways: list[str], lexicon: frozenset[str]) -> bool:
    """Whether a text is restored for certain: no bytes are lost, no word is odd, and words that were read by another single-byte page are words of the collection."""
    if LOST in ways or "�" in after or odd_words(INVISIBLE.sub("", after)):
        return False
    if SINGLE not in ways:
        return True
    old = set(_WORD.findall(before))
    return all(w.lower() in lexicon for w in set(_WORD.findall(after)) - old if not w.isascii())


#: Words with letters beyond a-z that make at least a COMMON-th of all words: at most COMMON.
COMMON = 50_000


def common_words(blocks: DataFrame, text: str = "raw_text") -> frozenset[str]:
    """The collection's common words with letters beyond a-z, in lower case: what a right page gives."""
    w = blocks.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    w = cut(w.where("n > 1"))
    total = w.agg(F.sum("n")).first()[0] or 0
    return frozenset(r.w for r in w.where(F.col("n") * COMMON >= total).where(F.col("w").rlike(r"[^\x00-\x7f]")).select("w").collect())


def restored(blocks: DataFrame, text: str = "raw_text", key: str = "block_id", lexicon: frozenset[str] | None = None) -> DataFrame:
    """(key, restored_text, restorable, path) of the affected rows, one row per input row: path names the ways in which a row was found (the
    automaton over multibyte spans; UTF-16; another single-byte page; lost bytes), restorable is true where the original is sure. Rows with a null
    key or text are none; empty text is never affected. Rows of plain ASCII aren't sent to Python."""
    sent = blocks.sparkSession.sparkContext.broadcast(common_words(blocks, text) if lexicon is None else lexicon)

    def run(b: dict) -> dict:
        out: dict[str, list] = {key: [], "restored_text": [], "restorable": [], "path": []}
        for k, t in zip(b[key], b[text]):
            new, ways = restore_by(t, sent.value)
            if ways:
                out[key].append(k)
                out["restored_text"].append(new)
                out["restorable"].append(is_sure(t, new, ways, sent.value))
                out["path"].append("+".join(ways))
        return out

    rows = blocks.where(F.col(key).isNotNull() & F.col(text).rlike(r"[^\x01-\x7f]")).select(F.col(key).cast("long").alias(key), text)
    return arrow_map(rows, run, f"{key} long, restored_text string, restorable boolean, path string")


def garbled(blocks: DataFrame, text: str = "raw_text", key: str = "block_id") -> DataFrame:
    """Distinct keys of the affected rows. Which page restores a row doesn't matter here, so that no lexicon is counted."""
    return restored(blocks, text, key, frozenset()).select(key).distinct()

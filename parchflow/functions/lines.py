"""Line ends, broken words and paragraphs, as column expressions. Null text counts as empty."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchflow.functions import fixed
from parchflow.functions.text import solid_lines, text_of
from parchflow.runtime import where_needed

PREFIXES, VOWEL_PREFIXES, ENCLITICS, COMPOUNDS = map(frozenset, (fixed.PREFIXES, fixed.VOWEL_PREFIXES, fixed.ENCLITICS, fixed.COMPOUNDS))


def normalize_line_endings(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"\r\n?", "\n")


def is_morphological_hyphen(prefix: Column, suffix: Column, custom: Iterable[str] = ()) -> Column:
    """Whether the hyphen between two parts belongs to the word: false if a part is empty or null."""
    p, s = F.lower(prefix), F.lower(suffix)
    first, upper = F.left(s, F.lit(1)), r"^\p{Lu}"
    word = F.concat(p, F.lit("-"), s)
    rule = (
        prefix.rlike(r"(?U)\d") | suffix.rlike(r"(?U)\d")
        | (prefix.rlike(upper) & suffix.rlike(upper))
        | word.isin(*sorted(COMPOUNDS | {w.lower() for w in custom}))
        | s.isin(*sorted(ENCLITICS)) | p.isin(*sorted(PREFIXES))
        | (p.isin(*sorted(VOWEL_PREFIXES)) & ((first == "h") | (first == F.right(p, F.lit(1)))))
        | ((p == "sub") & first.isin("b", "r", "h"))
        | (p.isin("super", "hiper", "inter") & first.isin("r", "h"))
    )
    return F.coalesce((F.length(prefix) > 0) & (F.length(suffix) > 0) & rule, F.lit(False))


def keeps_hyphen(prefix: str, suffix: str, custom: frozenset[str] = frozenset()) -> bool:
    """is_morphological_hyphen of two strings."""
    if not (prefix and suffix):
        return False
    p, s = prefix.lower(), suffix.lower()
    return (
        any(map(str.isdigit, prefix + suffix))
        or (prefix[0].isupper() and suffix[0].isupper())
        or f"{p}-{s}" in COMPOUNDS | custom
        or s in ENCLITICS
        or p in PREFIXES
        or (p in VOWEL_PREFIXES and s[0] in ("h", p[-1]))
        or (p == "sub" and s[0] in "brh")
        or (p in ("super", "hiper", "inter") and s[0] in "rh")
    )


_GAP = r"[^\S\r\n]*"
_BROKEN = re.compile(rf"({fixed.WORD_CLASS}+)[{fixed.HYPHENS}]{_GAP}\r?\n{_GAP}(-?){_GAP}({fixed.WORD_CLASS}+)")


def _hyphen_beside(text: str, at: int, beyond: int) -> bool:
    """Whether a hyphen stands at a place, and a part of a word beyond it."""
    return 0 <= at < len(text) and 0 <= beyond < len(text) and text[at] in fixed.HYPHENS and text[beyond] not in "\r\n \t"


def join_broken(text: str | None, custom: frozenset[str] = frozenset()) -> str:
    """text with words joined that a hyphen breaks at the end of a line, until none is left."""
    text = (text or "").replace("\r\n", "\n").replace("\r", "\n")

    def one(m: re.Match[str]) -> str:
        left, again, right = m.groups()
        keep = again or _hyphen_beside(m.string, m.start() - 1, m.start() - 2) or _hyphen_beside(m.string, m.end(), m.end() + 1) or keeps_hyphen(left, right, custom)
        return f"{left}-{right}" if keep else left + right

    while (after := _BROKEN.sub(one, text)) != text:
        text = after
    return text


def dehyphenate_text(c: Column, custom: Iterable[str] = ()) -> Column:
    """join_broken of a column: each join may change the next one, which no built-in function can express."""
    words = frozenset(w.lower() for w in custom)
    ends = normalize_line_endings(c)
    return where_needed(ends, ends.rlike(rf"[{fixed.HYPHENS}](?U)(?:[^\S\n]|[\x1c-\x1f])*\n"), lambda t: join_broken(t, words))


def consolidate_paragraphs(c: Column, preserve_double_newlines: bool = True, strip_lines: bool = True) -> Column:
    """The lines of each paragraph joined by spaces; paragraphs that are blank are dropped."""
    parts = F.split(normalize_line_endings(c), r"(?U)\n[\s\x1c-\x1f]*\n+")

    def joined(p: Column) -> Column:
        ls = F.split(p, "\n")
        return F.array_join(solid_lines(ls) if strip_lines else F.filter(ls, lambda x: x != ""), " ")

    kept = F.filter(F.transform(parts, joined), lambda x: x != "")
    return F.array_join(kept, "\n\n" if preserve_double_newlines else " ")


def normalize_line_breaks(c: Column, dehyphenate: bool = True, unwrap_paragraphs: bool = True, preserve_double_newlines: bool = True, custom: Iterable[str] = ()) -> Column:
    out = normalize_line_endings(c)
    if dehyphenate:
        out = dehyphenate_text(out, custom)
    return consolidate_paragraphs(out, preserve_double_newlines) if unwrap_paragraphs else out

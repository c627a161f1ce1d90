"""Cleaning of text and classes of characters, as column expressions. Null text counts as empty; empty text stays empty."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchflow.runtime import where_needed


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def rx(pattern: str, ignore_case: bool = False) -> str:
    """A pattern for the JVM that matches as in Python: Unicode classes, only line feeds end lines."""
    return ("(?iUd)" if ignore_case else "(?Ud)") + pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value evaluated once however often body names it (expressions alone would repeat it)."""
    return F.transform(F.array(value), body)[0]


SPACES = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"(?U)^{SPACES}+|{SPACES}+\z", "")


def remove_null_bytes(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"\x00", "")


def remove_replacement_characters(c: Column) -> Column:
    return F.translate(text_of(c), "�￼", "")


def remove_control_characters(c: Column, keep_newlines: bool = True, keep_tabs: bool = True) -> Column:
    kept = (r"\n\r" if keep_newlines else "") + (r"\t" if keep_tabs else "")
    return F.regexp_replace(text_of(c), rf"[\p{{Cc}}&&[^{kept}]]" if kept else r"\p{Cc}", "")


def remove_invisible_characters(c: Column, remove_soft_hyphens: bool = True) -> Column:
    return F.regexp_replace(text_of(c), r"\p{Cf}" if remove_soft_hyphens else r"[\p{Cf}&&[^­]]", "")


def normalize_spaces(c: Column) -> Column:
    return F.regexp_replace(text_of(c), r"\p{Zs}", " ")


def collapse_consecutive_spaces(c: Column) -> Column:
    """Two or more spaces of a line become one; a single tab stays."""
    return F.regexp_replace(text_of(c), r"(?U)[^\S\r\n]{2,}", " ")


def normalize_unicode(c: Column, form: str = "NFC") -> Column:
    """One of the four normal forms; Spark has no such function, so this is the one Python step of cleaning."""
    return where_needed(text_of(c), text_of(c).rlike(r"[^\x00-\x7f]"), lambda t: unicodedata.normalize(form, t))


def clean_text(
    c: Column, unicode_form: str | None = "NFC", remove_nulls: bool = True, remove_replacements: bool = True, remove_controls: bool = True, remove_invisible: bool = True,
    normalize_space_chars: bool = True, collapse_spaces: bool = False, keep_newlines: bool = True, keep_tabs: bool = True, remove_soft_hyphens: bool = True,
) -> Column:
    """The steps above in one expression."""
    out = text_of(c)
    drop = []
    if remove_nulls:
        drop.append(r"\x00")
    if remove_replacements:
        drop.append(r"�￼")
    if remove_controls:
        kept = (r"\n\r" if keep_newlines else "") + (r"\t" if keep_tabs else "")
        drop.append(rf"[\p{{Cc}}&&[^{kept}]]" if kept else r"\p{Cc}")
    if remove_invisible:
        drop.append(r"\p{Cf}" if remove_soft_hyphens else r"[\p{Cf}&&[^­]]")
    if drop:
        out = F.regexp_replace(out, f"[{''.join(drop)}]", "")
    if normalize_space_chars:
        out = normalize_spaces(out)
    if collapse_spaces:
        out = collapse_consecutive_spaces(out)
    return normalize_unicode(out, unicode_form) if unicode_form else out


CORRUPT = r"[�￼[\p{Cc}&&[^\n\r\t]]]"
READABLE = r"[ \n\r\t]|[^\p{C}\p{Z}�￼]"
READABLE_SOLID = r"[^\p{C}\p{Z}�￼]"


def count_corrupted(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(CORRUPT))


def count_readable(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(READABLE))


def count_readable_solid(c: Column) -> Column:
    """Readable characters that aren't white space."""
    return F.regexp_count(text_of(c), F.lit(READABLE_SOLID))


def is_corrupted(ch: Column) -> Column:
    return ch.rlike(rf"^{CORRUPT}\z")


def is_readable(ch: Column) -> Column:
    return ch.rlike(rf"^(?:{READABLE})\z")


LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]"


def splitlines(c: Column) -> Column:
    """The lines of a text, whatever ends them; no empty line after the last end."""
    whole = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    return let(c, lambda t: F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(let(F.split(t, LINE_END), whole)))


def solid_lines(lines: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(lines, strip), lambda x: x != "")


def ends_with(c: Column, ends: str) -> Column:
    """Whether the last character is one of ends."""
    return let(F.right(c, F.lit(1)), lambda x: (x != "") & F.lit(ends).contains(x))

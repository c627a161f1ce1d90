"""What kind of block a text is, as column expressions. Null text counts as empty, which is a paragraph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchflow.functions import fixed
from parchflow.functions.text import ends_with, let, rx, solid_lines, splitlines, strip, text_of

CODE_LINE = rx("|".join(f"(?:{p})" for p in fixed.CODE_LINES), True)
_JSDOC, _JSDOC_TERM = fixed.JSDOC, rx(fixed.JSDOC_TERM)


def is_filename(stripped: Column) -> Column:
    return stripped.rlike(rx(fixed.FILENAME, True))


def starts_item(line: Column) -> Column:
    return line.rlike(rx(fixed.BULLET)) | line.rlike(rx(fixed.ORDINAL))


def is_code_block(c: Column) -> Column:
    def by_lines(lines: Column) -> Column:
        indented = F.forall(lines, lambda x: x.startswith("    ") | x.startswith("\t"))
        return F.when(indented, True).otherwise(let(F.transform(lines, strip), by_bare))

    def by_bare(bare: Column) -> Column:
        listed = F.forall(bare, lambda x: starts_item(x) & ~(x.rlike(_JSDOC) | x.rlike(_JSDOC_TERM)))
        hits = lambda n: (n > 0) & ((F.size(bare) == 1) | (n * 2 >= F.size(bare)))
        return F.when(listed, False).otherwise(let(F.size(F.filter(bare, lambda x: x.rlike(CODE_LINE))), hits))

    def of(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: strip(x) != "")
        return let(strip(text), lambda s: F.when((s == "") | is_filename(s), False).when(s.startswith("```") | s.startswith("~~~"), True).otherwise(let(lines, by_lines)))

    return let(text_of(c), of)


_HASHES, _OUTLINE, _SINGLE, _KEYCAP = map(rx, (fixed.HASHES, fixed.OUTLINE, fixed.SINGLE, fixed.KEYCAP))


def heading_level(c: Column, max_length: int = fixed.MAX_HEADING) -> Column:
    """1 to 6, or 0 for no heading; the first rule that fits decides."""

    def is_title(title: Column) -> Column:
        words = F.size(F.filter(F.split(title, r"(?U)\s+"), lambda w: w != ""))
        capital = title.rlike(r"^\p{Lu}") | (title.rlike(r"\p{Lu}") & ~title.rlike(r"[\p{Ll}\p{Lt}]"))
        return ~ends_with(title, ";,") & ~(title.endswith(".") & (words > 6)) & capital

    def short(s: Column) -> Column:
        def by_lines(lines: Column) -> Column:
            numbered = s.rlike(_SINGLE) & (lines == 1) & let(strip(F.regexp_extract(s, _SINGLE, 2)), is_title)
            shouted = let(F.regexp_replace(s, r"\P{L}+", ""), lambda x: (F.length(x) >= 4) & x.rlike(r"^\p{Lu}+\z")) & ~ends_with(s, ".;!?,") & ~s.rlike(r"^[-*+•] ")
            depth = F.size(F.split(F.regexp_extract(s, _OUTLINE, 1), r"\."))
            return (
                F.when(lines > 2, 0)
                .when(s.rlike(_HASHES), F.least(F.lit(6), F.length(F.regexp_extract(s, "^(#+)", 1))))
                .when(s.rlike(_OUTLINE), F.least(F.lit(6), depth))
                .when(numbered, 1)
                .when(s.rlike(_KEYCAP) & (lines == 1), 3)
                .when(s.rlike(rx(fixed.CHAPTER, True)) & ~ends_with(s, ".;"), 1)
                .when(s.rlike(rx(fixed.SECTION, True)) & ~ends_with(s, ".;"), 2)
                .when(shouted, 1)
                .otherwise(0)
            )

        return F.when((s == "") | (F.length(s) > max_length), 0).otherwise(let(F.size(solid_lines(splitlines(s))), by_lines))

    return let(strip(text_of(c)), short).cast("int")


def is_heading(c: Column, max_length: int = fixed.MAX_HEADING) -> Column:
    return heading_level(c, max_length) > 0


def is_list_item(c: Column) -> Column:
    most = lambda lines: (F.size(lines) > 1) & (F.size(F.filter(lines, starts_item)) * 2 >= F.size(lines))
    return let(strip(text_of(c)), lambda s: starts_item(s) | let(solid_lines(splitlines(s)), most))


def classify_text(c: Column, max_heading_length: int = fixed.MAX_HEADING) -> Column:
    """struct<block_type, heading_level>."""

    def kind(name: Column | str, level: Column | int = 0) -> Column:
        return F.struct(F.lit(name).alias("block_type"), (F.lit(level) if isinstance(level, int) else level).alias("heading_level"))

    def rest(text: Column, level: Column) -> Column:
        return F.when(level > 0, kind("heading", level)).when(is_list_item(text), kind("list_item")).otherwise(kind("paragraph"))

    def of(text: Column) -> Column:
        return F.when(strip(text) == "", kind("paragraph")).when(is_code_block(text), kind("code_block")).otherwise(let(heading_level(text, max_heading_length), lambda n: rest(text, n)))

    return let(text_of(c), of)


def chosen_text(normalized: Column | str = "normalized_text", raw: Column | str = "raw_text") -> Column:
    """The normalised text, or the raw one where that is null or empty."""
    n, r = (F.col(x) if isinstance(x, str) else x for x in (normalized, raw))
    return F.coalesce(F.nullif(n, F.lit("")), r, F.lit(""))

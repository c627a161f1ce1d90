"""Markdown of blocks, as column expressions. Null and blank text render as empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchflow.functions import fixed
from parchflow.functions.text import let, rx, solid_lines, splitlines, strip, text_of


def _unless_blank(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of the stripped text, or empty text."""
    return let(strip(text_of(c)), lambda s: F.when(s == "", F.lit("")).otherwise(body(s)))


def format_heading(c: Column, level: Column | int = 1) -> Column:
    n = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(F.lit(level) if isinstance(level, int) else level, F.lit(1))))
    title = lambda b: F.when(b == "", F.lit("")).otherwise(F.concat(F.lit(" "), F.array_join(solid_lines(splitlines(b)), " ")))
    return _unless_blank(c, lambda s: F.concat(F.repeat(F.lit("#"), n), let(strip(F.regexp_replace(s, rx(r"^#{1,6}\s*"), "")), title)))


def is_code_fenced(c: Column) -> Column:
    def of(lines: Column) -> Column:
        first, last = strip(F.try_element_at(lines, F.lit(1))), strip(F.try_element_at(lines, F.lit(-1)))
        fence = lambda f: first.startswith(f) & (last == f)
        return F.coalesce((F.size(lines) >= 2) & (fence("```") | fence("~~~")), F.lit(False))

    # only text that starts with a fence is cut into lines
    return let(strip(text_of(c)), lambda s: F.when(s.startswith("```") | s.startswith("~~~"), let(splitlines(s), of)).otherwise(False))


def dedent(c: Column) -> Column:
    """Without the longest white space that starts all lines which aren't blank; blank lines become empty."""
    margin_of = lambda x: F.regexp_extract(x, r"^([ \t]*)", 1)

    def common(a: Column, b: Column) -> Column:
        sizes = F.sequence(F.lit(0), F.least(F.length(a), F.length(b)))
        return F.when(F.startswith(b, a), a).otherwise(F.substring(a, F.lit(1), F.array_max(F.filter(sizes, lambda n: F.startswith(b, F.substring(a, F.lit(1), n))))))

    def of(lines: Column) -> Column:
        def without(margins: Column) -> Column:
            first = F.coalesce(F.try_element_at(margins, F.lit(1)), F.lit(""))
            return let(F.length(F.aggregate(margins, first, common)), lambda n: F.array_join(F.transform(lines, lambda x: F.substr(x, n + 1)), "\n"))

        return let(F.transform(F.filter(lines, lambda x: x != ""), margin_of), without)

    return let(F.transform(F.split(text_of(c), "\n"), lambda x: F.when(x.rlike(r"^[ \t]*\z"), F.lit("")).otherwise(x)), of)


def format_code_block(c: Column, default_language: str = "") -> Column:
    fenced = F.concat(F.lit(f"```{default_language.strip()}\n"), strip(dedent(text_of(c))), F.lit("\n```"))
    return _unless_blank(c, lambda s: F.when(is_code_fenced(s), s).otherwise(fenced))


_BULLET = rx(fixed.LIST_BULLET)
_ORDERED = tuple(map(rx, fixed.LIST_ORDERED))


def format_list_item(c: Column, preserve_ordered: bool = True) -> Column:
    text = text_of(c)

    def line(x: Column, i: Column) -> Column:
        bare = strip(x)
        out = F.when(x.rlike(_BULLET), F.concat(F.regexp_extract(x, _BULLET, 1), F.lit("- "), strip(F.regexp_extract(x, _BULLET, 3))))
        for p in _ORDERED:
            marker = F.concat(F.regexp_extract(x, p, 2), F.lit(". ")) if preserve_ordered else F.lit("- ")
            out = out.when(x.rlike(p), F.concat(F.regexp_extract(x, p, 1), marker, strip(F.regexp_extract(x, p, 3))))
        indent = F.regexp_extract(x, r"(?U)^([\s\x1c-\x1f]*)", 1)
        later = F.when(F.length(indent) >= 2, F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+\z", "")).otherwise(F.concat(F.lit("  "), bare))
        return F.when(bare == "", F.lit(None)).otherwise(out.when(i == 0, F.concat(indent, F.lit("- "), bare)).otherwise(later))

    lines = F.filter(F.transform(splitlines(text), line), lambda x: x.isNotNull())
    return _unless_blank(text, lambda _: F.array_join(lines, "\n"))


def format_table(c: Column) -> Column:
    """A pipe table with one separator row: cells are split at pipes, else tabs; short rows are filled up."""
    is_rule = lambda x: x.rlike(rx(r"^[\s|:-]+$")) & x.rlike("-")

    def cells(x: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(x, r"^\|", ""), r"(?<!\\)\|\z", "")
        return F.transform(F.when(x.contains("|"), F.split(inner, r"(?<!\\)\|")).when(x.contains("\t"), F.split(x, "\t")).otherwise(F.array(x)), strip)

    def draw(grid: Column, width: Column) -> Column:
        row = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
        head = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        rest = F.transform(F.slice(grid, F.lit(2), F.greatest(F.size(grid) - 1, F.lit(0))), row)
        return F.array_join(F.concat(F.array(row(grid[0]), head), rest), "\n")

    def rows(lines: Column, at: Column) -> Column:
        return F.transform(F.when(at > 0, F.filter(lines, lambda _, i: i + 1 != at)).otherwise(lines), cells)

    def of(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, is_rule), F.lit(True)).cast("int")
        drawn = lambda g: F.when(F.size(g) == 0, F.lit("")).otherwise(let(F.array_max(F.transform(g, F.size)), lambda w: draw(g, w)))
        return let(let(at, lambda k: rows(lines, k)), drawn)

    return _unless_blank(c, lambda s: let(solid_lines(splitlines(s)), of))


TAG_LIKE = rx(fixed.TAG_LIKE)


def format_paragraph(c: Column) -> Column:
    """Lines stripped, blank ones dropped, what looks like a tag escaped."""
    return F.array_join(solid_lines(splitlines(F.regexp_replace(strip(text_of(c)), TAG_LIKE, "&lt;"))), "\n")


def format_block(kind: Column, level: Column, c: Column, preserve_ordered: bool = True, default_language: str = "") -> Column:
    text = text_of(c)
    out = F.when(kind == "heading", format_heading(text, level)).when(kind == "code_block", format_code_block(text, default_language)).when(kind == "list_item", format_list_item(text, preserve_ordered))
    return out.when(kind == "table", format_table(text)).otherwise(format_paragraph(text))


def simple_block(kind: Column, level: Column, c: Column) -> Column:
    """The plain renderer: headings need a level, only one-digit ordinals count, nothing is escaped or merged."""

    def of(s: Column) -> Column:
        heading = F.when(s.startswith("#"), s).otherwise(F.concat(F.repeat(F.lit("#"), level), F.lit(" "), s))
        code = F.when(s.startswith("```") & s.endswith("```"), s).otherwise(F.concat(F.lit("```\n"), s, F.lit("\n```")))
        marked = s.rlike(r"^[-*+] ") | ((F.length(s) > 3) & s.rlike(r"(?U)^\d[.)] "))
        item = F.when(marked, s).otherwise(F.concat(F.lit("- "), s))
        return F.when((kind == "heading") & (level > 0), heading).when(kind == "code_block", code).when(kind == "list_item", item).otherwise(s)

    return let(strip(text_of(c)), of)

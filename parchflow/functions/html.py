"""HTML5 of Markdown and pages around it.

The Markdown subset: headings, fenced code, lists in any nesting, pipe tables, block quotes, rules, paragraphs; strong, emphasis,
code, links and images inside them. Text is escaped everywhere. The body is one Arrow function, the page around it expressions.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchflow.functions.text import text_of
from parchflow.runtime import string_udf

PAGE_CLASS = "parch-page"
STYLE = """    body { margin: 0; background: #fff; color: #222; font: 16px/1.6 system-ui, sans-serif; }
    .parch-page { max-width: 52rem; margin: 2rem auto; padding: 0 1rem; }
    pre, code { font-family: ui-monospace, monospace; background: #f3f3f3; }
    pre { padding: .8rem; overflow-x: auto; }
    table { border-collapse: collapse; } th, td { border: 1px solid #bbb; padding: .3rem .6rem; }
    @media (prefers-color-scheme: dark) { body { background: #161616; color: #ddd; } pre, code { background: #262626; } }"""

_CODE = re.compile(r"(`+)(.+?)\1")
_SPANS = (
    (re.compile(r"!\[([^\]]*)\]\(([^)\s]*)\)"), r'<img alt="\1" src="\2">'),
    (re.compile(r"\[([^\]]*)\]\(([^)\s]*)\)"), r'<a href="\2">\1</a>'),
    (re.compile(r"\*\*(?=\S)(.+?)(?<=\S)\*\*|__(?=\S)(.+?)(?<=\S)__"), lambda m: f"<strong>{m[1] or m[2]}</strong>"),
    (re.compile(r"(?<!\w)\*(?=\S)(.+?)(?<=\S)\*(?!\w)|(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)"), lambda m: f"<em>{m[1] or m[2]}</em>"),
)


def inline(text: str) -> str:
    """Spans of a line; code is kept out of the other rules. Entities that are already escaped stay."""
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(f"<code>{html.escape(m[2].strip(), quote=False)}</code>")
        return f"\x02{len(held) - 1}\x03"

    out = html.escape(_CODE.sub(hold, text), quote=False)
    out = re.sub(r"&amp;(#?\w+;)", r"&\1", out)
    for pattern, to in _SPANS:
        out = pattern.sub(to, out)
    return re.sub("\x02(\\d+)\x03", lambda m: held[int(m[1])], out)


_FENCE = re.compile(r"(`{3,}|~{3,})\s*([^\s`]*)[^`]*$")
_HEAD = re.compile(r"(#{1,6})(?:\s+(.*?))?\s*#*\s*$")
_ITEM = re.compile(r"(\s*)([-*+]|\d+[.)])\s+(.*)$")
_RULE = re.compile(r"\s*([-*_])(?:\s*\1){2,}\s*$")
_SEPARATOR = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*$")


def _cells(line: str) -> list[str]:
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", re.sub(r"^\||(?<!\\)\|$", "", line.strip()))]


def _table(rows: list[str]) -> str:
    head, body = _cells(rows[0]), [_cells(r) for r in rows[2:]]
    row = lambda cells, tag: "<tr>\n" + "\n".join(f"<{tag}>{inline(c)}</{tag}>" for c in (cells + [""] * len(head))[: len(head)]) + "\n</tr>"
    return "\n".join(["<table>", "<thead>", row(head, "th"), "</thead>", "<tbody>", *(row(r, "td") for r in body), "</tbody>", "</table>"])


def _list(items: list[tuple[int, str, str]]) -> str:
    """(indent, marker, text) items as nested lists."""
    kind = "ul" if items[0][1] in "-*+" else "ol"
    base, out, i = items[0][0], [f"<{kind}>"], 0
    while i < len(items):
        j = i + 1
        while j < len(items) and items[j][0] > base:
            j += 1
        inner = "\n" + _list(items[i + 1 : j]) + "\n" if j > i + 1 else ""
        out.append(f"<li>{inline(items[i][2])}{inner}</li>")
        i = j
    return "\n".join([*out, f"</{kind}>"])


def markdown_to_html(text: str | None) -> str:
    """An HTML fragment of Markdown; null and blank text give an empty one."""
    lines, out, para = (text or "").replace("\r\n", "\n").split("\n"), [], []

    def close() -> None:
        if para:
            out.append("<p>" + "\n".join(map(inline, para)) + "</p>")
            para.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        if m := _FENCE.match(line.strip()):
            close()
            j = i + 1
            while j < len(lines) and not (lines[j].strip().startswith(m[1]) and not lines[j].strip().strip(m[1][0])):
                j += 1
            lang = f' class="language-{html.escape(m[2])}"' if m[2] else ""
            code = "".join(html.escape(x, quote=False) + "\n" for x in lines[i + 1 : j])
            out.append(f"<pre><code{lang}>{code}</code></pre>")
            i = j + 1
            continue
        if not line.strip():
            close()
        elif m := _HEAD.match(line):
            close()
            out.append(f"<h{len(m[1])}>{inline(m[2] or '')}</h{len(m[1])}>")
        elif _RULE.match(line):
            close()
            out.append("<hr>")
        elif "|" in line and i + 1 < len(lines) and "-" in lines[i + 1] and "|" in lines[i + 1] and _SEPARATOR.match(lines[i + 1]):
            close()
            j = i + 2
            while j < len(lines) and "|" in lines[j]:
                j += 1
            out.append(_table(lines[i:j]))
            i = j
            continue
        elif line.lstrip().startswith(">"):
            close()
            j = i
            while j < len(lines) and lines[j].lstrip().startswith(">"):
                j += 1
            out.append("<blockquote>\n" + markdown_to_html("\n".join(re.sub(r"^\s*> ?", "", x) for x in lines[i:j])) + "\n</blockquote>")
            i = j
            continue
        elif not para and (m := _ITEM.match(line)):
            items, j = [], i
            while j < len(lines) and lines[j].strip():
                if m := _ITEM.match(lines[j]):
                    items.append((len(m[1].expandtabs(4)), m[2], m[3]))
                else:
                    items[-1] = (*items[-1][:2], items[-1][2] + "\n" + lines[j].strip())
                j += 1
            out.append(_list(items))
            i = j
            continue
        else:
            para.append(line.strip())
        i += 1
    close()
    return "\n".join(out)


def compile_markdown_to_html(c: Column) -> Column:
    return string_udf(markdown_to_html)(text_of(c))


def escape(text: str) -> str:
    """escape_html of a string."""
    return html.escape(text, quote=True)


def escape_html(c: Column) -> Column:
    out = text_of(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_frame(lang: str = "pt-BR", extra_css: str = "") -> tuple[str, str, str]:
    """What stands before the title of a page, between title and content, and after the content."""
    css = STYLE + (f"\n{extra_css.strip()}" if extra_css and extra_css.strip() else "")
    head = f'<!DOCTYPE html>\n<html lang="{html.escape(lang)}">\n<head>\n  <meta charset="utf-8">\n  <meta name="viewport" content="width=device-width, initial-scale=1.0">\n  <title>'
    return head, f'</title>\n  <style>\n{css}\n  </style>\n</head>\n<body>\n  <main class="{PAGE_CLASS}">\n', "\n  </main>\n</body>\n</html>"


def render_html_document(content: Column, title: Column | str = "Documento", lang: str = "pt-BR", extra_css: str = "") -> Column:
    """A page around a fragment; title and language are escaped. A null title is "Documento"."""
    title = F.lit(title) if isinstance(title, str) else F.coalesce(title, F.lit("Documento"))
    head, middle, end = map(F.lit, html_frame(lang, extra_css))
    return F.concat(head, escape_html(title), middle, text_of(content), end)


def stem(path: Column) -> Column:
    """The last part of a path without its last suffix; null if that is empty."""
    name = F.regexp_extract(path, r"([^/\\]*)[/\\]*\z", 1)
    return F.nullif(F.when(name.rlike(r"^\.[^.]*\z"), name).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")), F.lit(""))


def render_html(markdown: Column, title: Column | None = None, source_path: Column | None = None, lang: str = "pt-BR", extra_css: str = "") -> Column:
    """A whole page of Markdown; the title is the one given, else the stem of the source, else "Documento"."""
    parts = [x for x in (title, stem(source_path) if source_path is not None else None) if x is not None]
    return render_html_document(compile_markdown_to_html(markdown), F.coalesce(*parts, F.lit("Documento")), lang, extra_css)

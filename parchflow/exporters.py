"""Single documents written as Markdown or HTML, for use from a driver program; tables of documents go through sinks."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from parchflow.functions.html import STYLE, escape, html_frame, markdown_to_html
from parchflow.operators.blocks import build_markdown
from parchflow.options import output_stem
from parchflow.sinks import write_file


def as_markdown(content: str | DataFrame) -> str:
    """Markdown as it is, or that of a DataFrame of one document: its `markdown`, or its blocks rendered. Anything else is a TypeError."""
    if isinstance(content, str):
        return content
    if not isinstance(content, DataFrame):
        raise TypeError(f"Markdown or a DataFrame of blocks is needed, not {type(content).__name__}")
    rows = (content if "markdown" in content.columns else build_markdown(content)).select("markdown").limit(2).collect()
    if len(rows) > 1:
        raise TypeError("the DataFrame holds more than one document")
    return rows[0].markdown if rows else ""


def target(suffix: str, folder: str | Path = ".", path: str | Path | None = None, filename: str | None = None, source: str | None = None) -> Path:
    """Where a document goes: a path, relative to the folder, with the suffix added if it has none; in a folder (one that exists, or a path with a
    slash at its end) by the name asked for, else the stem of the source, else "output". Without path, name and source: ValueError."""
    if path is None and filename is None and source is None:
        raise ValueError("a path, a file name or a source is needed")
    at = Path(folder) / path if path is not None else Path(folder)
    if path is None or at.is_dir() or str(path).endswith(("/", "\\")):
        at /= output_stem(source, filename)
        return at.with_name(at.name + suffix)
    return at if at.suffix else at.with_name(at.name + suffix)


class MarkdownExporter:
    """Writes Markdown into a folder."""

    def __init__(self, folder: str | Path = ".", overwrite: bool = True, ensure_newline: bool = True):
        self.folder, self.overwrite, self.ensure_newline = Path(folder), overwrite, ensure_newline

    def export(self, content: str | DataFrame, path: str | Path | None = None, filename: str | None = None, source: str | None = None) -> Path:
        return write_file(target(".md", self.folder, path, filename, source), as_markdown(content), self.overwrite, self.ensure_newline)


class HtmlExporter:
    """Compiles Markdown to HTML and writes it into a folder; title, language and style may be given for each page."""

    def __init__(self, folder: str | Path = ".", title: str | None = None, lang: str = "pt-BR", extra_css: str = "", overwrite: bool = True, ensure_newline: bool = True):
        self.folder, self.title, self.lang, self.extra_css, self.overwrite, self.ensure_newline = Path(folder), title, lang, extra_css, overwrite, ensure_newline

    def compile_body(self, content: str | DataFrame) -> str:
        """The fragment without a page around it."""
        return markdown_to_html(as_markdown(content))

    def compile(self, content: str | DataFrame, title: str | None = None, lang: str | None = None, extra_css: str | None = None, source: str | None = None) -> str:
        head, middle, end = html_frame(lang or self.lang, self.extra_css if extra_css is None else extra_css)
        name = title or self.title or (output_stem(source) if source else "Documento")
        return head + escape(name) + middle + self.compile_body(content) + end

    def export(self, content: str | DataFrame, path: str | Path | None = None, filename: str | None = None, source: str | None = None, **page) -> Path:
        return write_file(target(".html", self.folder, path, filename, source), self.compile(content, source=source, **page), self.overwrite, self.ensure_newline)


__all__ = ["STYLE", "HtmlExporter", "MarkdownExporter", "as_markdown", "target"]

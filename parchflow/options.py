"""Options of a conversion and names of its outputs; errors and their codes."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchflow.functions import fixed
from parchflow.functions.html import stem


class ParchflowError(Exception):
    """Any failure of a conversion; code is the exit status of the command line."""

    code = 1


class InvalidOptionError(ParchflowError, ValueError):
    code = 2


class MissingInputError(ParchflowError, FileNotFoundError):
    code = 3


class CorruptInputError(ParchflowError):
    code = 4


class EncryptedInputError(ParchflowError):
    code = 5


class ReaderMissingError(ParchflowError):
    code = 6


class DestinationExistsError(ParchflowError, FileExistsError):
    code = 4


def export_formats(formats: Iterable[str]) -> tuple[str, ...]:
    """Known formats in lower case, each once, in their order."""
    out = tuple(dict.fromkeys(f.strip().lower().lstrip(".") for f in formats))
    if not out or (bad := [f for f in out if f not in fixed.FORMATS]):
        raise InvalidOptionError(f"formats must be some of {', '.join(fixed.FORMATS)}" + (f", not {', '.join(bad)}" if out else ""))
    return out


def parse_formats(given: Iterable[str] | None) -> tuple[str, ...]:
    """Formats of a repeatable, comma-separated option; md and html by default."""
    parts = [p for g in given or () for p in g.split(",") if p.strip()]
    return export_formats(parts or ("md", "html"))


def check_dpi(dpi: int) -> int:
    if dpi <= 0:
        raise InvalidOptionError("dpi must be above 0")
    return dpi


def output_stem(source: str | bytes | None, filename: str | None = None) -> str:
    """The stem of the file name asked for, else of the source, else "output"."""
    for name in (filename, source if isinstance(source, str) else None):
        stem = PurePosixPath(name.replace("\\", "/")).stem if name else ""
        if stem and stem != "<memory>":
            return stem
    return "output"


def output_targets(source: str | bytes | None, output_path: str | None, output_dir: str | None, filename: str | None = None, is_dir: bool = False) -> tuple[str, str]:
    """(Markdown file, HTML file): in output_path if it is a folder (or ends with a slash), else beside it by suffix; without one in output_dir, else the current folder."""
    if output_path is not None and not is_dir and not output_path.endswith(("/", "\\")):
        p = PurePosixPath(output_path)
        return str(p.with_suffix(".md")), str(p.with_suffix(".html"))
    base = PurePosixPath(output_path if output_path is not None else output_dir if output_dir is not None else ".")
    stem = output_stem(source, filename)
    return str(base / f"{stem}.md"), str(base / f"{stem}.html")


def normal_formats(given: Column) -> Column:
    """The formats of a comma-separated text: trimmed, in lower case, without a leading dot, each once, in their order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(given, F.lit("")), ","), lambda f: F.regexp_replace(F.lower(F.trim(f)), r"^\.+", "")), lambda f: f != ""))


def formats_known(given: Column) -> Column:
    """Whether all formats of a text are known."""
    return F.forall(normal_formats(given), lambda f: f.isin(*fixed.FORMATS))


def target_paths(source: Column, folder: str) -> tuple[Column, Column]:
    """(markdown_path, html_path) of a source in a folder: named by its stem, "output" if it has none or is no file."""
    name = F.coalesce(stem(F.nullif(source, F.lit("<memory>"))), F.lit("output"))
    path = lambda suffix: F.concat(F.lit(folder.rstrip("/") + "/"), name, F.lit(suffix))
    return path(".md").alias("markdown_path"), path(".html").alias("html_path")

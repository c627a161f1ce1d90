"""Documents written out: a table, or a file for each, replaced in one step."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchflow.functions.html import render_html
from parchflow.functions.text import text_of
from parchflow.options import DestinationExistsError, export_formats
from parchflow.runtime import ship


def with_newline(c: Column) -> Column:
    return F.when(text_of(c).endswith("\n"), text_of(c)).otherwise(F.concat(text_of(c), F.lit("\n")))


def write_file(target: str | Path, text: str, overwrite: bool = True, ensure_newline: bool = True) -> Path:
    """Write text to a file beside the target and put it in the target's place; nothing is left behind if that fails."""
    target = Path(target)
    if not overwrite and target.exists():
        raise DestinationExistsError(f"{target} exists")
    if ensure_newline and not text.endswith("\n"):
        text += "\n"
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, tmp = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, target)
    except BaseException:
        Path(tmp).unlink(missing_ok=True)
        raise
    return target


def with_html(documents: DataFrame, lang: str = "pt-BR", extra_css: str = "") -> DataFrame:
    """documents (doc_id, source_path, markdown) with html."""
    return documents.withColumn("html", render_html(F.col("markdown"), None, F.col("source_path"), lang, extra_css))


def write_documents(documents: DataFrame, folder: str, formats: tuple[str, ...] = ("md", "html"), overwrite: bool = True, lang: str = "pt-BR", extra_css: str = "") -> DataFrame:
    """A row per document: doc_id, markdown_path, html_path, error. Files are named by stem and id and written by the executors to a folder
    that all share; with overwrite off both targets are looked at before either is written. Formats not asked for aren't rendered."""
    formats = export_formats(formats)
    md, page = bool({"md", "markdown"} & set(formats)), bool({"html", "html5"} & set(formats))
    ship(documents.sparkSession)
    d = with_html(documents, lang, extra_css) if page else documents.withColumn("html", F.lit(None).cast("string"))
    name = F.concat_ws("_", F.coalesce(F.regexp_extract("source_path", r"([^/\\]+?)(?:\.[^./\\]*)?\z", 1), F.lit("output")), F.col("doc_id").cast("string"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc, stem, text, html in zip(part.doc_id, part.stem, part.markdown, part.html):
                targets = [(Path(folder, f"{stem}.md"), text) if md else None, (Path(folder, f"{stem}.html"), html) if page else None]
                error = None
                try:
                    if not overwrite and (there := [t for t in targets if t and t[0].exists()]):
                        raise DestinationExistsError(f"{there[0][0]} exists")
                    for t in targets:
                        if t:
                            write_file(*t)
                except OSError as e:
                    error, targets = f"{type(e).__name__}: {e}", [None, None]
                rows.append((doc, *(str(t[0]) if t else None for t in targets), error))
            yield pd.DataFrame(rows, columns=["doc_id", "markdown_path", "html_path", "error"])

    return d.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("stem"), text_of("markdown").alias("markdown"), "html").mapInPandas(run, "doc_id long, markdown_path string, html_path string, error string")


def write_table(documents: DataFrame, path: str, overwrite: bool = True) -> None:
    """A Parquet table of the documents; Spark's commit makes it whole or absent."""
    documents.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)

"""PDF files decoded into tables of pages, blocks, words, links and tables.

Files are read by Spark's binaryFile source; each is decoded on an executor by PyMuPDF where it is installed. What can't be opened
gives a row with an error code instead of failing the job. PyMuPDF and Tesseract are optional and weren't installed where this was
written, so that decoding itself is untested; all operators start from the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchflow import schema
from parchflow.functions import fixed
from parchflow.runtime import cut, ship

_BOX = "x0 double, y0 double, x1 double, y1 double"
DECODED = (
    "doc_id long, source_path string, error_code int, error string, n_pages int, is_encrypted boolean, needs_password boolean, is_repaired boolean, permissions int, title string, author string, format string, "
    "pages array<struct<page_number int, has_images boolean, text string>>, "
    f"blocks array<struct<page_number int, block_no int, kind int, {_BOX}, text string>>, tables array<struct<page_number int, table_no int, {_BOX}, markdown string>>, "
    f"words array<struct<page_number int, block_no int, line_no int, word_no int, {_BOX}, word string>>, links array<struct<page_number int, link_no int, {_BOX}, uri string>>, "
    "ocr_words array<struct<page_number int, idx int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf double, text string>>, "
    f"ocr_text array<struct<page_number int, {_BOX}, text string>>"
)
PRINT, COPY = 4, 16  # bits of permissions


def files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source_path, content) of the files of a path; doc_id is a hash of the path."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return f.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source_path"), "content")


def decode_one(content: bytes | None, password: str = "", ocr: bool = False, dpi: int = 300, lang: str = "por+eng", config: str = "--psm 3 --oem 3", use_data: bool = True) -> dict:
    """The tables of a file, or an error: 3 empty, 4 corrupt, 5 encrypted, 6 no reader. With ocr pages are read by the engine: as words with boxes, or, without
    use_data, as plain text with the box of the page."""
    out: dict = dict.fromkeys(("error_code", "error", "n_pages", "is_encrypted", "needs_password", "is_repaired", "permissions", "title", "author", "format")) | {k: [] for k in ("pages", "blocks", "tables", "words", "links", "ocr_words", "ocr_text")}
    if not content:
        return out | {"error_code": 3, "error": "the file is empty"}
    try:
        import pymupdf
    except ImportError:
        return out | {"error_code": 6, "error": "pymupdf is not installed"}
    try:
        doc = pymupdf.open(stream=bytes(content), filetype="pdf")
    except Exception as e:  # noqa: BLE001
        return out | {"error_code": 4, "error": str(e)}
    try:
        needs = bool(doc.needs_pass)
        if needs and not doc.authenticate(password):
            return out | {"error_code": 5, "error": "wrong password" if password else "a password is needed", "needs_password": True, "is_encrypted": True}
        meta = doc.metadata or {}
        out |= {"n_pages": doc.page_count, "is_encrypted": needs or bool(doc.is_encrypted), "needs_password": needs, "is_repaired": bool(doc.is_repaired), "permissions": int(doc.permissions), "title": meta.get("title") or "", "author": meta.get("author") or "", "format": meta.get("format") or ""}
        for page in doc:
            n = page.number + 1
            out["pages"].append((n, bool(page.get_images()), page.get_text()))
            if ocr:
                if use_data:
                    out["ocr_words"] += _ocr(page, n, dpi, lang, config)
                else:
                    out["ocr_text"].append((n, *(round(float(x), 2) for x in page.rect), page_text(page, dpi, lang, config)))
                continue
            out["blocks"] += [(n, i, int(b[6]), *map(float, b[:4]), str(b[4])) for i, b in enumerate(page.get_text("blocks"))]
            out["words"] += _tried(lambda: [(n, int(w[5]), int(w[6]), int(w[7]), *map(float, w[:4]), str(w[4])) for w in page.get_text("words")])  # noqa: B023
            out["links"] += _tried(lambda: [(n, i, *map(float, k["from"]), str(k["uri"])) for i, k in enumerate(page.get_links()) if k.get("uri") and k.get("from")])  # noqa: B023
            out["tables"] += _as_far_as_possible((n, i, *(round(float(x), 2) for x in t.bbox), t.to_markdown()) for i, t in _each_table(page))
        return out
    except Exception as e:  # noqa: BLE001
        return out | {"error_code": 4, "error": str(e)}
    finally:
        doc.close()


def _tried(rows) -> list:
    """What a page yields; a page that can't be asked yields nothing."""
    try:
        return rows()
    except Exception:  # noqa: BLE001
        return []


def _each_table(page) -> Iterator[tuple]:
    yield from enumerate(page.find_tables())


def _as_far_as_possible(rows: Iterator) -> list:
    """The rows up to the first that fails."""
    out = []
    try:
        for r in rows:
            out.append(r)
    except Exception:  # noqa: BLE001
        pass
    return out


def render_page(page, dpi: int = 300) -> bytes:
    """A page as a PNG without transparency."""
    return page.get_pixmap(dpi=max(dpi, 1), alpha=False).tobytes("png")


def page_image(page, dpi: int = 300):
    """A page as an image in memory."""
    import io

    from PIL import Image

    return Image.open(io.BytesIO(render_page(page, dpi)))


def page_text(page, dpi: int = 300, lang: str = "por+eng", config: str = "--psm 3 --oem 3") -> str:
    """The plain text that the engine reads on a page."""
    import pytesseract

    return pytesseract.image_to_string(page_image(page, dpi), lang=lang, config=config)


def _ocr(page, n: int, dpi: int, lang: str, config: str) -> list:
    """The OCR words of a page, in pixels; the image lives in memory only."""
    import pytesseract

    d = pytesseract.image_to_data(page_image(page, dpi), lang=lang, config=config, output_type=pytesseract.Output.DICT)
    cols = [d.get(c, []) for c in ("block_num", "par_num", "line_num", "left", "top", "width", "height", "conf")]
    at = lambda c, i: c[i] if i < len(c) else 0
    return [(n, i, *(int(at(c, i)) for c in cols[:7]), float(at(cols[7], i)), str(t)) for i, t in enumerate(d["text"])]


def decode(found: DataFrame, password: str = "", reader: Callable[..., dict] = decode_one, **options) -> DataFrame:
    """A row per file with its tables as arrays; one file at a time is in memory. reader gets (content, password, **options), and what it doesn't give is empty."""
    ship(found.sparkSession)
    names = [x.name for x in schema.StructType.fromDDL(DECODED)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for d, p, c in zip(part.doc_id, part.source_path, part.content):
                row = {"doc_id": d, "source_path": p} | reader(c, password, **options)
                yield pd.DataFrame([[row.get(n) for n in names]], columns=names)

    return found.mapInPandas(run, DECODED)


def decode_by_strategy(found: DataFrame, strategies: Callable[[dict[str, DataFrame]], DataFrame], force_ocr: bool = False, **options) -> DataFrame:
    """Files decoded by their text layer; those whose strategy (a function of the tables) is OCR are decoded once more, by OCR alone. Materialised."""
    if force_ocr:
        return cut(decode(found, ocr=True, **options))
    native = cut(decode(found, ocr=False, **options))
    chosen = strategies(tables(native)).where(F.col("strategy") == fixed.OCR).select("doc_id")
    read = decode(found.join(chosen, "doc_id", "left_semi"), ocr=True, **options).where("error_code is null").select("doc_id", F.col("ocr_words").alias("_w"), F.col("ocr_text").alias("_t"))
    both = native.join(read, "doc_id", "left").withColumns({"ocr_words": F.coalesce("_w", "ocr_words"), "ocr_text": F.coalesce("_t", "ocr_text")})
    return cut(both.select(native.columns))


def validate(decoded: DataFrame) -> DataFrame:
    """decoded, failing with the path and the error of the first file that can't be read."""
    bad = F.concat_ws(": ", "source_path", F.coalesce("error", F.lit("unreadable")))
    return decoded.where(F.when(F.col("error_code").isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True))


class PdfReader:
    """One file as rows: opened when asked for, closed at the end of the block."""

    def __init__(self, spark: SparkSession, source: str | bytes, password: str = "", **options):
        self.spark, self.source, self.password, self.options, self.decoded = spark, source, password, options, None

    def open(self) -> PdfReader:
        if self.decoded is None:
            f = files(self.spark, self.source) if isinstance(self.source, str) else self.spark.createDataFrame([(0, "<memory>", bytearray(self.source))], "doc_id long, source_path string, content binary")
            self.decoded = decode(f, self.password, **self.options)
        return self

    def close(self) -> None:
        self.decoded = None

    @property
    def is_closed(self) -> bool:
        return self.decoded is None

    def tables(self) -> dict[str, DataFrame]:
        return tables(self.open().decoded)

    def inspect(self) -> DataFrame:
        return inspect(self.open().decoded)

    def is_valid(self) -> bool:
        rows = self.open().decoded.select("error_code").collect()  # one file
        return bool(rows) and all(r.error_code is None for r in rows)

    def __enter__(self) -> PdfReader:
        return self.open()

    def __exit__(self, *_) -> None:
        self.close()


def tables(decoded: DataFrame) -> dict[str, DataFrame]:
    """The input tables of the pipeline, of the files without error; decoded should be materialised."""
    ok = decoded.where("error_code is null")
    flat = lambda c: ok.select("doc_id", F.inline(c))
    pages = ok.select("doc_id", "n_pages", F.inline("pages")).select("doc_id", "page_number", "n_pages", "has_images", "text")
    return {"documents": ok.select("doc_id", "source_path", "n_pages"), "pages": pages, "blocks_raw": flat("blocks"), "tables_raw": flat("tables"), "words_raw": flat("words"), "links_raw": flat("links"), "ocr_words": flat("ocr_words"), "ocr_text": flat("ocr_text")}


def inspect(decoded: DataFrame) -> DataFrame:
    """The metadata of each file, with whether it may be printed and copied, and whether it is valid."""
    bit = lambda n: F.col("permissions").bitwiseAND(n) != 0
    return decoded.select("doc_id", "source_path", "n_pages", "is_encrypted", "needs_password", "is_repaired", "permissions", bit(PRINT).alias("can_print"), bit(COPY).alias("can_copy"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("author", F.lit("")).alias("author"), "format", F.col("error_code").isNull().alias("is_valid"), "error_code", "error")

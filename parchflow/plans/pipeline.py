"""From decoded tables to Markdown and HTML of each document.

    quality of sampled pages -> strategy -> native or OCR blocks -> reading order -> classification -> Markdown -> HTML

Everything after sampling is keyed by document; the page is the unit of layout. Place in a document is a number made of page and
place on the page, so that no window over a whole document is needed for it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchflow import schema
from parchflow.functions import fixed
from parchflow.functions.lines import normalize_line_breaks
from parchflow.functions.text import clean_text, strip, text_of
from parchflow.operators import layout, links, ocr, quality
from parchflow.operators.blocks import build_markdown, classify_documents
from parchflow.options import check_dpi, export_formats
from parchflow.runtime import cut
from parchflow.sinks import with_html, write_documents
from parchflow.sources import pdf

PAGE_ROWS = 1 << 20  # places of a page in block_ord
_BOX = ("x0", "y0", "x1", "y1")


@dataclass
class Pipeline:
    """force_ocr skips detection; dpi sets the scale of OCR boxes (72 a point); formats prune what is rendered."""

    force_ocr: bool = False
    dpi: int = 300
    formats: tuple[str, ...] = ("md", "html")
    extract_tables: bool = True
    lang: str = "pt-BR"
    listener: Callable[[str, float], None] | None = None  # told of each stage and the share done; what it raises is ignored

    def __post_init__(self) -> None:
        check_dpi(self.dpi)
        self.formats = export_formats(self.formats)

    def _tell(self, stage: str) -> None:
        if self.listener is not None:
            try:
                self.listener(stage, STAGES[stage])
            except Exception:  # noqa: BLE001
                pass

    def convert(self, source: str | bytes, output: str, password: str = "", overwrite: bool = True, spark: SparkSession | None = None, **options) -> DataFrame:
        """From a file, a folder or the bytes of a file to files in a folder: (doc_id, source_path, strategy, pages_processed, markdown_path, html_path, error,
        execution_time_seconds, the same for all of a run), a row per source; what can't be read has an error and no paths."""
        began = time.perf_counter()
        spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        self._tell("opening")
        found = pdf.files(spark, source) if isinstance(source, str) else spark.createDataFrame([(0, "<memory>", bytearray(source))], "doc_id long, source_path string, content binary")
        decoded = pdf.decode_by_strategy(found, self.strategies, self.force_ocr, password=password, dpi=self.dpi, **options)
        done = cut(self.run(pdf.tables(decoded)))
        written = cut(write_documents(done, output, self.formats, overwrite, self.lang))
        self._tell("finished")
        out = decoded.select("doc_id", "source_path", F.col("error").alias("_e")).join(done.select("doc_id", "strategy", F.col("total_pages").alias("pages_processed")), "doc_id", "left").join(written, "doc_id", "left")
        return out.select("doc_id", "source_path", "strategy", "pages_processed", "markdown_path", "html_path", F.coalesce("_e", "error").alias("error"), F.lit(round(time.perf_counter() - began, 4)).alias("execution_time_seconds"))

    def strategies(self, t: dict[str, DataFrame]) -> DataFrame:
        found = quality.detect_strategy(t["pages"], self.force_ocr)
        return t["documents"].select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("strategy", F.lit(fixed.OCR)).alias("strategy"))

    def native_blocks(self, t: dict[str, DataFrame]) -> DataFrame:
        """Text blocks outside tables, cleaned, with links, and the tables of a page."""
        spark = t["blocks_raw"].sparkSession
        tables = t.get("tables_raw") if self.extract_tables else None
        tables = (tables if tables is not None else schema.empty(spark, schema.TABLES_RAW)).where(strip(text_of("markdown")) != "")
        tables = tables.withColumns({c: F.bround(c, 2) for c in _BOX})
        b = t["blocks_raw"].where((F.col("kind") == 0) & (strip(text_of("text")) != ""))
        b = layout.outside_tables(b, tables)
        b = b.withColumns({"raw_text": F.col("text"), "normalized_text": strip(normalize_line_breaks(clean_text(F.col("text"))))})
        if "words_raw" in t and "links_raw" in t:
            b = links.apply_links(b, cut(links.word_links(t["words_raw"], t["links_raw"])))
        cols = ("doc_id", "page_number", "block_no", "is_table", "raw_text", "normalized_text", *_BOX)
        b = b.withColumns({c: F.bround(c, 2) for c in _BOX} | {"is_table": F.lit(False)}).select(*cols)
        md = strip(F.col("markdown"))
        own = tables.select("doc_id", "page_number", (F.col("table_no") + F.lit(1 << 19)).alias("block_no"), F.lit(True).alias("is_table"), md.alias("raw_text"), md.alias("normalized_text"), *_BOX)
        return b.unionByName(own)

    def ocr_blocks(self, t: dict[str, DataFrame]) -> DataFrame:
        w = t.get("ocr_words")
        w = w if w is not None else schema.empty(t["documents"].sparkSession, schema.OCR_WORDS)
        cols = ("doc_id", "page_number", "block_no", F.lit(False).alias("is_table"), "raw_text", "normalized_text", *_BOX)
        b = ocr.word_blocks(w, scale=self.dpi / 72).withColumn("block_no", F.col("first_idx").cast("long")).select(*cols)
        if "ocr_text" not in t:
            return b
        pages = t["ocr_text"]  # pages read as plain text: every block has the box of its page
        text = ocr.text_blocks(pages).join(pages.select("doc_id", "page_number", *_BOX), ["doc_id", "page_number"]).withColumn("block_no", F.col("block_no").cast("long")).select(*cols)
        return b.unionByName(text)

    def blocks(self, t: dict[str, DataFrame], strategies: DataFrame | None = None) -> DataFrame:
        """Blocks of all documents by the strategy of each, in reading order, classified."""
        s = strategies if strategies is not None else cut(self.strategies(t))
        # the rows of a document are picked before anything is done to them, so that no text is cleaned for nothing
        only = lambda names, strategy: {k: v.join(s.where(F.col("strategy") == strategy).select("doc_id"), "doc_id", "left_semi") if k in names else v for k, v in t.items()}
        native = self.native_blocks(only(("blocks_raw", "tables_raw", "words_raw", "links_raw"), fixed.NATIVE))
        scanned = self.ocr_blocks(only(("ocr_words", "ocr_text"), fixed.OCR))
        both = cut(native.unionByName(scanned))  # read again for the order and by the steps after it
        order = layout.sort_blocks(both)
        both = both.join(order, ["doc_id", "page_number", "block_no"])
        both = both.withColumns({"block_ord": F.col("page_number").cast("long") * PAGE_ROWS + F.col("page_ord"), "block_type": F.when(F.col("is_table"), "table").otherwise("paragraph"), "heading_level": F.lit(0)})
        return classify_documents(both.drop("is_table", "page_ord"))

    def run(self, t: dict[str, DataFrame]) -> DataFrame:
        """(doc_id, source_path, strategy, total_pages, markdown[, html]) of every row of documents; one without text is empty."""
        self._tell("detecting")
        s = cut(self.strategies(t))
        self._tell("extracting")
        blocks = cut(self.blocks(t, s))
        self._tell("exporting")
        md = build_markdown(blocks)
        out = t["documents"].join(s, "doc_id").join(md, "doc_id", "left")
        out = out.select("doc_id", "source_path", "strategy", F.coalesce("n_pages", F.lit(0)).alias("total_pages"), F.coalesce("markdown", F.lit("")).alias("markdown"))
        return with_html(out, self.lang) if {"html", "html5"} & set(self.formats) else out


#: Shares of a conversion done when a stage begins.
STAGES = {"opening": 0.0, "start": 0.05, "detecting": 0.15, "extracting": 0.15, "classifying": 0.70, "exporting": 0.85, "finished": 1.0}


def progress(page: Column, total: Column) -> Column:
    """Share of a conversion done after a page has been read."""
    return F.bround(F.lit(0.15) + F.lit(0.5) * page / F.greatest(total, F.lit(1)), 4)

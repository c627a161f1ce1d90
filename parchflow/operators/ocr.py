"""Paragraph blocks of OCR words and of OCR text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchflow.functions.lines import normalize_line_breaks
from parchflow.functions.text import clean_text, strip, text_of


def tesseract_config(psm: Column | int | None = 3, oem: Column | int | None = 3, extra: Column | str = "") -> Column:
    """The options as one string; a null option is left out."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    opt = lambda name, x: F.concat(F.lit(f"--{name} "), as_col(x).cast("string"))
    return F.concat_ws(" ", opt("psm", psm), opt("oem", oem), F.nullif(F.trim(as_col(extra)), F.lit("")))


def valid_words(words: DataFrame) -> DataFrame:
    """Words that aren't blank, with a confidence other than -1; low ones stay. text is stripped."""
    return words.withColumn("text", strip(text_of("text"))).where((F.col("text") != "") & (F.coalesce("conf", F.lit(0.0)) != -1))


def normalized(raw: Column) -> Column:
    return strip(normalize_line_breaks(clean_text(raw)))


def word_blocks(words: DataFrame, scale: float = 1.0, normalize: bool = True) -> DataFrame:
    """(doc_id, page_number, block_num, par_num, first_idx, raw_text, normalized_text, x0, y0, x1, y1) of words
    (doc_id, page_number, idx, block_num, par_num, line_num, left, top, width, height, conf, text).

    Words of a line in input order joined by spaces, lines by number joined by line feeds; two aggregations on nested keys,
    so a page's paragraphs are shuffled once. Null numbers and boxes count as 0.
    """
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("block_num", "par_num", "line_num", "left", "top", "width", "height")}
    w = valid_words(words).withColumns(zero)
    para = ["doc_id", "page_number", "block_num", "par_num"]
    line = w.groupBy(*para, "line_num").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x.text), " ").alias("t"),
        F.min("idx").alias("idx"), F.min("left").alias("x0"), F.min("top").alias("y0"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
    )
    s = scale if scale > 0 else 1.0
    box = lambda f, c: F.bround(f(c) / F.lit(float(s)), 2).alias(c)
    out = line.groupBy(*para).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_num", "t"))), lambda x: x.t), "\n").alias("raw_text"), F.min("idx").alias("first_idx"),
        box(F.min, "x0"), box(F.min, "y0"), box(F.max, "x1"), box(F.max, "y1"),
    )
    return out.withColumn("normalized_text", normalized(F.col("raw_text")) if normalize else F.col("raw_text"))


def text_blocks(pages: DataFrame, normalize: bool = True, ignore_empty: bool = True) -> DataFrame:
    """(doc_id, page_number, block_no, raw_text, normalized_text) of page texts: parts between empty lines, stripped."""
    p = pages.select("doc_id", "page_number", F.posexplode(F.split(text_of("text"), "\n\n")).alias("block_no", "part")).select("doc_id", "page_number", "block_no", strip(F.col("part")).alias("raw_text"))
    if ignore_empty:
        p = p.where("raw_text <> ''")
    return p.withColumn("normalized_text", normalized(F.col("raw_text")) if normalize else F.col("raw_text"))

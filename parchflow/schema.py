"""Schemas of the tables between the stages, and checks of their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parchflow.functions import fixed

PAGES = "doc_id long, page_number int, n_pages int, has_images boolean, text string"
BLOCKS_RAW = "doc_id long, page_number int, block_no int, kind int, x0 double, y0 double, x1 double, y1 double, text string"
TABLES_RAW = "doc_id long, page_number int, table_no int, x0 double, y0 double, x1 double, y1 double, markdown string"
WORDS_RAW = "doc_id long, page_number int, block_no int, line_no int, word_no int, x0 double, y0 double, x1 double, y1 double, word string"
LINKS_RAW = "doc_id long, page_number int, link_no int, x0 double, y0 double, x1 double, y1 double, uri string"
OCR_WORDS = "doc_id long, page_number int, idx int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf double, text string"
OCR_TEXT = "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double, text string"
DOCUMENTS = "doc_id long, source_path string, n_pages int"


def empty(spark, ddl: str) -> DataFrame:
    return spark.createDataFrame([], StructType.fromDDL(ddl))


def block_faults() -> Column:
    """Array of what is wrong with a block row; empty if nothing is."""
    checks = {
        "page_number": F.col("page_number") >= 1,
        "heading_level": F.col("heading_level").between(0, 6),
        "block_type": F.col("block_type").isin(*fixed.BLOCK_TYPES),
        "bbox": F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull(),
    }
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())


def report_faults() -> Column:
    """Array of the counts and ratios of a report that can't be."""
    checks = {c: F.coalesce(F.col(c), F.lit(0)) >= 0 for c in ("total_chars", "printable_chars", "corrupted_chars")} | {c: F.coalesce(F.col(c).between(0, 1), F.lit(True)) for c in ("readable_ratio", "corruption_ratio")}
    return F.filter(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())


def result_faults() -> Column:
    """Array of what is wrong with a result row."""
    checks = {"pages_processed": F.col("pages_processed") >= 0, "execution_time_seconds": F.col("execution_time_seconds") >= 0, "strategy_used": F.col("strategy_used").isin(fixed.NATIVE, fixed.OCR)}
    return F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda x: x.isNotNull())


def valid(df: DataFrame, faults: Column) -> DataFrame:
    return df.where(F.size(faults) == 0)


def require(df: DataFrame, faults: Column) -> DataFrame:
    """df, failing when a row with faults is read."""
    return df.withColumn("_ok", F.assert_true(F.size(faults) == 0, F.concat(F.lit("invalid row: "), F.array_join(faults, ", ")))).where("_ok is null").drop("_ok")

"""Text quality of documents and the extraction strategy that follows from it.

Input: pages (doc_id, page_number from 1, n_pages, has_images, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchflow.functions import fixed
from parchflow.functions.text import count_corrupted, count_readable, count_readable_solid, text_of


def sample_pages(total: Column, most: int = fixed.MAX_SAMPLE) -> Column:
    """0-based pages to look at, ascending: all up to `most`, else first and last, then the middle and those next to the ends; never more than five."""
    last, mid = total - 1, F.floor(total / 2).cast("int")
    pick = {0: [], 1: [F.lit(0)], 2: [F.lit(0), last], 3: [F.lit(0), mid, last], 4: [F.lit(0), F.lit(1), mid, last]}.get(min(most, 5), [F.lit(0), F.lit(1), mid, total - 2, last])
    some = F.array_sort(F.array_distinct(F.array(*(p.cast("int") for p in pick)))) if pick else F.array().cast("array<int>")
    every = F.when(total > 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.when(F.coalesce(total, F.lit(0)) <= most, F.coalesce(every, F.array().cast("array<int>"))).otherwise(some)


def page_counts(pages: DataFrame, most: int = fixed.MAX_SAMPLE) -> DataFrame:
    """The sampled pages with their counts; a null text counts as empty."""
    p = pages.where(F.array_contains(sample_pages(F.col("n_pages").cast("int"), most), F.col("page_number").cast("int") - 1))
    t = text_of("text")
    return p.select("doc_id", "page_number", F.coalesce("has_images", F.lit(False)).alias("has_images"), F.length(t).alias("total"), count_readable(t).alias("printable"), count_corrupted(t).alias("corrupted"), count_readable_solid(t).alias("solid"))


def quality_report(pages: DataFrame, force_ocr: bool = False, most: int = fixed.MAX_SAMPLE) -> DataFrame:
    """A row per document: total_chars, printable_chars, corrupted_chars, readable_ratio, corruption_ratio, has_images, pages_sampled, recommended_strategy, reason.

    One aggregation by document, combined before the shuffle; the ratios are rounded to four digits before they are compared.
    """
    a = page_counts(pages, most).groupBy("doc_id").agg(
        F.sum("total").alias("total_chars"), F.sum("printable").alias("printable_chars"), F.sum("corrupted").alias("corrupted_chars"), F.sum("solid").alias("solid_chars"),
        F.bool_or("has_images").alias("has_images"), F.array_sort(F.collect_set((F.col("page_number") - 1).cast("int"))).alias("pages_sampled"),
    )
    ratio = lambda x: F.when(F.col("total_chars") > 0, F.bround(F.col(x) / F.col("total_chars"), 4)).otherwise(0.0)
    a = a.withColumns({"readable_ratio": ratio("printable_chars"), "corruption_ratio": ratio("corrupted_chars")})
    return a.withColumns({"recommended_strategy": strategy_of(force_ocr), "reason": reason_of(force_ocr)})


def _rules() -> tuple[Column, Column, Column]:
    return F.col("corruption_ratio") > fixed.MAX_CORRUPTION, F.col("solid_chars") < fixed.MIN_READABLE_CHARS, F.col("readable_ratio") < fixed.MIN_READABLE


def strategy_of(force_ocr: bool = False) -> Column:
    corrupt, sparse, unreadable = _rules()
    return F.lit(fixed.OCR) if force_ocr else F.when(corrupt | sparse | unreadable, fixed.OCR).otherwise(fixed.NATIVE)


def percent(ratio: Column) -> Column:
    """A ratio of four digits as a percentage of one, rounded as its binary value is: the error of the product decides where it looks like a tie."""
    x = ratio * 100.0
    p = x * 20.0
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * 20.0 - p) + (x - high) * 20.0
    tie = (p == F.floor(p)) & (p % 2 == 1)
    down, up = (p - 1) / 2, (p + 1) / 2
    tenths = F.when(tie, F.when(error < 0, down).when(error > 0, up).otherwise(F.when(down % 2 == 0, down).otherwise(up))).otherwise(F.round(x * 10))
    return tenths / 10


def reason_of(force_ocr: bool = False) -> Column:
    corrupt, sparse, unreadable = _rules()
    if force_ocr:
        return F.lit(fixed.REASON_FORCED)
    return (
        F.when(corrupt, F.format_string(fixed.REASON_CORRUPT, percent(F.col("corruption_ratio"))))
        .when(sparse & (F.col("total_chars") == 0), fixed.REASON_EMPTY)
        .when(sparse, F.format_string(fixed.REASON_SPARSE, F.col("solid_chars")))
        .when(unreadable, F.format_string(fixed.REASON_UNREADABLE, percent(F.col("readable_ratio"))))
        .otherwise(F.format_string(fixed.REASON_NATIVE, F.col("printable_chars"), percent(F.col("readable_ratio"))))
    )


def detect_strategy(pages: DataFrame, force_ocr: bool = False) -> DataFrame:
    """(doc_id, strategy); a forced strategy doesn't read the texts."""
    if force_ocr:
        return pages.select("doc_id").distinct().withColumn("strategy", F.lit(fixed.OCR))
    return quality_report(pages).select("doc_id", F.col("recommended_strategy").alias("strategy"))

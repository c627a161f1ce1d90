"""Reader engines: their languages, what they lack, and what their probes print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchflow.functions.text import splitlines, strip, text_of


#: Characters of a language's name; a line with any other, such as the title of a listing, names none.
PLAIN = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"


def missing_languages(available: Column, required: Column) -> Column:
    """Required languages that aren't available, compared without case and outer spaces; as they are required, in their order, each once."""
    low = F.transform(F.coalesce(available, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return F.filter(F.array_distinct(F.coalesce(required, F.array().cast("array<string>"))), lambda x: ~F.array_contains(low, F.lower(F.trim(x))))


def language_list(output: Column) -> Column:
    """Sorted distinct languages of what a language probe prints: lines of one word, without the title."""
    lines = F.transform(splitlines(text_of(output)), strip)
    return F.array_sort(F.array_distinct(F.filter(lines, lambda x: (x != "") & (F.translate(x, PLAIN, "") == ""))))


def version_of(output: Column) -> Column:
    """The version in what a version probe prints: the word after the engine's name on its first line, else that line, null if there is none."""
    line = strip(F.try_element_at(splitlines(strip(text_of(output))), F.lit(1)))
    words = F.split(line, r"\s+")
    named = (F.size(words) > 1) & (F.lower(words[0]) == "tesseract")
    return F.nullif(F.when(named, F.regexp_replace(words[1], "^v", "")).otherwise(line), F.lit(""))


def check_engines(engines: DataFrame, required: list[str]) -> DataFrame:
    """(engine_id, usable, missing): an engine is usable if it is available and lacks no required language."""
    need = F.array(*(F.lit(x) for x in required)) if required else F.array().cast("array<string>")
    e = engines.select("engine_id", F.coalesce("is_available", F.lit(False)).alias("ok"), missing_languages(F.col("available_languages"), need).alias("missing"))
    return e.select("engine_id", (F.col("ok") & (F.size("missing") == 0)).alias("usable"), "missing")

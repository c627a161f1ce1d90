"""Links of a page laid over its words, and set into the text of blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from parchflow.runtime import ship

PAGE = ["doc_id", "page_number"]


def usable_links(links: DataFrame) -> DataFrame:
    """Links with an address and a box."""
    return links.where("uri is not null and uri <> '' and x0 is not null and y0 is not null and x1 is not null and y1 is not null")


def word_links(words: DataFrame, links: DataFrame) -> DataFrame:
    """words with uri: the trimmed address of the first link of the page, by link_no, that holds the word's centre or meets its box; null if none does.

    words have (doc_id, page_number, block_no, line_no, word_no, x0, y0, x1, y1, word). Left and upper edges belong to a box, right and
    lower ones don't; boxes meet if their insides do. A left join on the page with the box condition, then the first link by word.
    """
    k = usable_links(links).select(*(F.col(c).alias(f"_{c}") for c in PAGE), "link_no", F.trim("uri").alias("uri"), *(F.col(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    holds = (cx >= F.col("lx0")) & (cx < F.col("lx1")) & (cy >= F.col("ly0")) & (cy < F.col("ly1"))
    meets = (F.greatest("x0", "lx0") < F.least("x1", "lx1")) & (F.greatest("y0", "ly0") < F.least("y1", "ly1"))
    on = (F.col("doc_id") == F.col("_doc_id")) & (F.col("page_number") == F.col("_page_number")) & (holds | meets)
    key = [*PAGE, "block_no", "line_no", "word_no"]
    return words.join(k, on, "left").groupBy(*key).agg(F.first("word").alias("word"), F.min_by("uri", "link_no").alias("uri"))


def link_runs(words: DataFrame) -> DataFrame:
    """(doc_id, page_number, block_no, run, uri, phrase): maximal runs of words of a block with one address, in order."""
    w = Window.partitionBy(*PAGE, "block_no").orderBy("line_no", "word_no")
    x = words.withColumn("_new", F.coalesce((~F.col("uri").eqNullSafe(F.lag("uri").over(w))).cast("int"), F.lit(1)))
    x = x.withColumn("run", F.sum("_new").over(w))
    g = x.where("uri is not null").groupBy(*PAGE, "block_no", "run").agg(F.first("uri").alias("uri"), F.sort_array(F.collect_list(F.struct("line_no", "word_no", "word"))).alias("ws"))
    return g.select(*PAGE, "block_no", "run", "uri", F.array_join(F.transform("ws", lambda a: a.word), " ").alias("phrase"))


def link_majority(words: DataFrame) -> DataFrame:
    """(doc_id, page_number, block_no, words, linked, uri): blocks with a single address on at least seven tenths of their words."""
    g = words.groupBy(*PAGE, "block_no").agg(F.count("*").alias("words"), F.count("uri").alias("linked"), F.countDistinct("uri").alias("n"), F.min("uri").alias("uri"))
    return g.where((F.col("n") == 1) & (F.col("linked") >= F.greatest(F.lit(1), F.floor(F.col("words") * 7 / 10)))).drop("n")


def _is_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def set_link(text: str, phrase: str, uri: str) -> str:
    """text with the first occurrence of phrase made a link that isn't in brackets and begins and ends where words do; address and phrase are taken as they are."""
    if not (phrase and uri):
        return text
    at = text.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        before, after = text[at - 1] if at else " ", text[end] if end < len(text) else " "
        if before != "[" and after != "]" and _is_word(before) != _is_word(phrase[0]) and _is_word(after) != _is_word(phrase[-1]):
            return f"{text[:at]}[{phrase}]({uri}){text[end:]}"
        at = text.find(phrase, at + 1)
    return text


def _set_all(text: pd.Series, runs: pd.Series) -> pd.Series:
    def one(t: str | None, rs) -> str | None:
        for r in rs if t is not None and rs is not None else ():
            t = set_link(t, r["phrase"], r["uri"])
        return t

    return pd.Series([one(t, r) for t, r in zip(text, runs)], dtype=object)


def apply_links(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """blocks with links set into raw_text and normalized_text: the whole text where one address has the majority, else run by run.

    Blocks without linked words, or with blank normalized_text, stay as they are. Setting a link looks for the first occurrence only
    and changes the text for the next one, which no built-in function does.
    """
    ship(blocks.sparkSession)
    set_all = pandas_udf(_set_all, StringType())
    major = link_majority(words).select(*PAGE, "block_no", F.col("uri").alias("_all"))
    runs = link_runs(words).groupBy(*PAGE, "block_no").agg(F.sort_array(F.collect_list(F.struct("run", "phrase", "uri"))).alias("_runs"))
    x = blocks.join(major, [*PAGE, "block_no"], "left").join(runs, [*PAGE, "block_no"], "left")
    some = F.coalesce(F.length(F.regexp_replace("normalized_text", r"(?U)\s+", "")) > 0, F.lit(False))

    def linked(c: str) -> Column:
        t, end = F.col(c), F.concat(F.lit("]("), F.col("_all"), F.lit(")"))
        whole = F.when(t.startswith("[") & F.endswith(t, end), t).otherwise(F.concat(F.lit("["), t, end))
        return F.when(~some | F.col("_runs").isNull(), t).when(F.col("_all").isNotNull(), whole).otherwise(set_all(t, F.col("_runs")))

    return x.withColumns({c: linked(c) for c in ("raw_text", "normalized_text")}).drop("_all", "_runs")

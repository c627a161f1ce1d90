"""Classification of the blocks of documents in context, and their Markdown.

Blocks are (doc_id, block_ord, raw_text, normalized_text, ...); block_ord is the order within a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchflow.functions import fixed
from parchflow.functions.classify import chosen_text, classify_text, is_filename
from parchflow.functions.render import format_block, format_code_block, is_code_fenced, simple_block
from parchflow.functions.text import ends_with, rx, splitlines, strip
from parchflow.operators.sequences import neighbours, running_sum
from parchflow.runtime import cut


def classify(blocks: DataFrame, max_heading_length: int = fixed.MAX_HEADING) -> DataFrame:
    """blocks with block_type and heading_level by their own text."""
    c = classify_text(chosen_text(), max_heading_length)
    return blocks.withColumn("_c", c).withColumns({"block_type": F.col("_c.block_type"), "heading_level": F.col("_c.heading_level")}).drop("_c")


def smooth(blocks: DataFrame) -> DataFrame:
    """blocks with those between two code blocks made code where the text around them says so.

    One simultaneous pass: a block changes only if both neighbours are code already, and such a neighbour is no candidate itself.
    What a text says as a neighbour is reduced to flags first; only these are ordered, and texts are neither moved nor read twice.
    (doc_id, block_ord) names a block; where rows repeat it, or have none, they keep their own class.
    """
    t = strip(chosen_text())
    flags = {
        "opens": t.rlike(rx(fixed.TAG_OPEN)) | t.endswith(">"), "closes": t.rlike(rx(fixed.TAG_CLOSE)) | t.startswith("</"), "exports": t.startswith("export default"),
        "leads": t.endswith("`") | t.contains("${"), "ends": t.startswith("`") | t.contains("}"), "named": is_filename(t), "short": (F.size(splitlines(t)) <= 3) & ~ends_with(t, ".?!"),
    }
    n = cut(blocks.where("doc_id is not null and block_ord is not null").select("doc_id", "block_ord", "block_type", "heading_level", *(f.alias(k) for k, f in flags.items())))
    n = n.join(n.groupBy("doc_id", "block_ord").count().where("count > 1"), ["doc_id", "block_ord"], "left_anti")
    x = neighbours(n, "doc_id", "block_ord", {k: F.col(k) for k in ("block_type", "opens", "closes", "exports", "leads", "ends")})
    said = F.col("prev_opens") | F.col("next_closes") | (F.col("prev_leads") & F.col("next_ends")) | F.col("short")
    hit = ~F.col("block_type").isin("code_block", "heading") & ~F.col("named") & (F.col("prev_block_type") == "code_block") & (F.col("next_block_type") == "code_block") & ~F.col("prev_exports") & said
    own = n.select("doc_id", "block_ord", F.col("block_type").alias("_own_type"), F.col("heading_level").alias("_own_level"))
    x = own.join(x.where(hit).select("doc_id", "block_ord", F.lit(True).alias("_code")), ["doc_id", "block_ord"], "left")
    repeats = blocks.drop("block_type", "heading_level").join(x, ["doc_id", "block_ord"], "left")
    mine = classify_text(chosen_text())  # read only for rows that repeat or lack their place
    return repeats.withColumns({
        "block_type": F.when(F.col("_code"), "code_block").otherwise(F.coalesce("_own_type", mine["block_type"])), "heading_level": F.when(F.col("_code"), 0).otherwise(F.coalesce("_own_level", mine["heading_level"])),
    }).drop("_code", "_own_type", "_own_level")


def classify_documents(blocks: DataFrame, max_heading_length: int = fixed.MAX_HEADING) -> DataFrame:
    """Classification with smoothing; blocks that came as tables stay as they were, but count as what their text looks like for their neighbours."""
    has = "block_type" in blocks.columns
    b = blocks.withColumn("_table", F.coalesce(F.col("block_type") == "table", F.lit(False)) if has else F.lit(False))
    b = b.withColumn("_level", F.coalesce("heading_level", F.lit(0)) if "heading_level" in blocks.columns else F.lit(0))
    out = smooth(classify(b, max_heading_length))
    return out.withColumns({"block_type": F.when(F.col("_table"), "table").otherwise(F.col("block_type")), "heading_level": F.when(F.col("_table"), F.col("_level")).otherwise(F.col("heading_level"))}).drop("_table", "_level")


def code_islands(blocks: DataFrame) -> DataFrame:
    """blocks with text, loose (code without a fence) and island: loose code blocks that follow each other share an island; any other
    block is one of its own. Blank code blocks are dropped and don't end an island."""
    b = blocks.withColumn("text", chosen_text())
    b = b.where((F.col("block_type") != "code_block") | (strip(F.col("text")) != ""))
    b = b.withColumn("loose", F.when(F.col("block_type") == "code_block", ~is_code_fenced(F.col("text"))).otherwise(False))
    n = cut(b.select("doc_id", "block_ord", "loose").dropDuplicates(["doc_id", "block_ord"]))
    x = neighbours(n, "doc_id", "block_ord", {"loose": F.col("loose")})
    # an island begins at each block that is no loose code, and at loose code after such a block
    begins = cut(x.select("doc_id", "block_ord", (~F.col("loose") | ~F.coalesce("prev_loose", F.lit(False))).alias("begins")))
    return b.join(running_sum(begins, "doc_id", "block_ord", F.col("begins").cast("int"), "island").drop("begins"), ["doc_id", "block_ord"])


def rendered(blocks: DataFrame, preserve_ordered_lists: bool = True, default_code_language: str = "") -> DataFrame:
    """(doc_id, island, block_ord, markdown): rendered blocks and islands, without those that are empty."""
    x = code_islands(blocks)
    one = F.when(F.col("block_type") == "code_block", strip(F.col("text"))).otherwise(format_block(F.col("block_type"), F.coalesce("heading_level", F.lit(0)), F.col("text"), preserve_ordered_lists, default_code_language))
    g = x.select("doc_id", "island", "block_ord", "loose", one.alias("m")).groupBy("doc_id", "island", "loose").agg(F.min("block_ord").alias("block_ord"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "m"))), lambda s: s.m), "\n").alias("m"))
    out = F.when(F.col("loose"), format_code_block(F.col("m"), default_code_language)).otherwise(F.col("m"))
    return g.select("doc_id", "island", "block_ord", out.alias("markdown")).where("markdown <> ''")


def build_markdown(blocks: DataFrame, separator: str = "\n\n", preserve_ordered_lists: bool = True, default_code_language: str = "") -> DataFrame:
    """(doc_id, markdown): the Markdown of each document; one of nothing but blank blocks is empty. A document is one value, and so one group."""
    r = rendered(blocks, preserve_ordered_lists, default_code_language)
    docs = r.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "markdown"))), lambda s: s.markdown), separator).alias("markdown"))
    return blocks.select("doc_id").distinct().join(docs, "doc_id", "left").select("doc_id", F.coalesce("markdown", F.lit("")).alias("markdown"))


def simple_markdown(blocks: DataFrame) -> DataFrame:
    """(doc_id, markdown) by the plain renderer, which merges nothing."""
    b = blocks.select("doc_id", "block_ord", simple_block(F.col("block_type"), F.coalesce("heading_level", F.lit(0)), chosen_text()).alias("m"), strip(chosen_text()).alias("s")).where("s <> ''")
    docs = b.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_ord", "m"))), lambda x: x.m), "\n\n").alias("markdown"))
    return blocks.select("doc_id").distinct().join(docs, "doc_id", "left").select("doc_id", F.coalesce("markdown", F.lit("")).alias("markdown"))

"""Problem 4: lines repeated across the documents of one site.

Lines are nodes, keyed by site and letters; lines that follow each other in a document are edges. Nodes and edges are weighted by the
number of distinct documents; what has high support is kept, connected components of it are the boilerplate
blocks, and matching occurrences are deleted from each text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchflow.operators.sequences import neighbours
from parchflow.runtime import cut, small

MIN_LETTERS, MIN_DOCS, MIN_SHARE = 12, 3, 0.25


def line_key(line: Column) -> Column:
    """The letters of a line in lower case; all else is dropped."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def lines(blocks: DataFrame) -> DataFrame:
    """(site, doc_id, block_id, line_no, h): the lines of at least MIN_LETTERS letters, h a 64-bit hash of their letters.

    Letters are taken from the whole text at once, line feeds kept. Rows with a null site, document, block or text have no lines here.
    """
    b = blocks.where("site is not null and doc_id is not null and block_id is not null and length(raw_text) >= %d" % MIN_LETTERS)
    b = b.select("site", "doc_id", "block_id", F.posexplode(F.split(F.regexp_replace(F.lower("raw_text"), r"[^\p{L}\n]+", ""), "\n")).alias("i", "k"))
    return b.where(F.length("k") >= MIN_LETTERS).select("site", "doc_id", "block_id", (F.col("i") + 1).alias("line_no"), F.xxhash64("k").alias("h"))


def support(blocks: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, among: DataFrame | None = None) -> DataFrame:
    """(site, h, docs): the kept nodes, of all lines or of those in `among` (site, h). Documents are made distinct per line before they are
    counted, so a hot site is spread over its lines; the counts of sites, a row each, are broadcast if few."""
    sites = blocks.where("site is not null and doc_id is not null").select("site", "doc_id").distinct().groupBy("site").agg(F.count("*").alias("site_docs"))
    rows = lines(blocks).select("site", "h", "doc_id")
    if among is not None:
        rows = rows.join(small(cut(among)), ["site", "h"], "left_semi")
    nodes = rows.distinct().groupBy("site", "h").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    return nodes.join(small(cut(sites)), "site").where(F.col("docs") >= F.col("site_docs") * F.lit(min_share)).select("site", "h", "docs")


def occurrences(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """The lines whose node is kept; nodes must be materialised."""
    return lines(blocks).join(small(nodes), ["site", "h"])


def edges(blocks: DataFrame, nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """(site, h, h2): kept edges between kept nodes that follow each other in a document. Its lines run on over blocks and pages in
    block_ord; lines too short to be nodes are skipped. An edge is kept if half of the documents of its rarer node have it.

    Of each block only the numbers of its first and last line are put in order, so that texts aren't moved.
    """
    ends = lines(blocks).groupBy("site", "doc_id", "block_id").agg(F.min("line_no").alias("first"), F.max("line_no").alias("last"))
    place = blocks.where("block_ord is not null and site is not null").select("site", "doc_id", "block_id", F.col("block_ord").cast("long").alias("block_ord")).dropDuplicates(["site", "doc_id", "block_id"])
    ends = cut(ends.join(place, ["site", "doc_id", "block_id"]).dropDuplicates(["doc_id", "block_ord"]))
    over = neighbours(ends, "doc_id", "block_ord", {"site": F.col("site"), "block": F.col("block_id"), "line": F.col("first")}).where("site = next_site")
    over = over.select("site", "doc_id", "block_id", F.col("last").alias("line_no"), F.col("next_block").alias("block2"), F.col("next_line").alias("line2"))
    # within a block the next line with letters enough, kept or not
    near = lines(blocks.join(seen.select("block_id").distinct(), "block_id", "left_semi")).select("site", "doc_id", "block_id", "line_no").distinct()
    near = near.withColumn("line2", F.lead("line_no").over(Window.partitionBy("site", "doc_id", "block_id").orderBy("line_no"))).where("line2 is not null")
    steps = near.select("site", "doc_id", "block_id", "line_no", F.col("block_id").alias("block2"), "line2").unionByName(over)
    after = seen.select("site", "doc_id", F.col("block_id").alias("block2"), F.col("line_no").alias("line2"), F.col("h").alias("h2"))
    found = seen.join(steps, ["site", "doc_id", "block_id", "line_no"]).join(after, ["site", "doc_id", "block2", "line2"]).where("h <> h2")
    found = found.select("site", "h", "h2", "doc_id").distinct().groupBy("site", "h", "h2").agg(F.count("*").alias("w"))
    weight = nodes.select("site", F.col("h"), F.col("docs").alias("d1"))
    found = found.join(weight, ["site", "h"]).join(weight.select("site", F.col("h").alias("h2"), F.col("d1").alias("d2")), ["site", "h2"])
    return found.where(F.col("w") * 2 >= F.least("d1", "d2")).select("site", "h", "h2")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(site, h, component) of nodes (site, h) by edges (site, h, h2) in both directions: the least node of each connected component.

    Each round takes the least label among a node and its neighbours, then jumps to the label of that label, so that a chain of n lines
    takes some log n rounds.
    """
    label = cut(nodes.select("site", "h", F.col("h").alias("component")))
    while True:
        near = edges.join(label.select("site", F.col("h").alias("h2"), F.col("component").alias("c2")), ["site", "h2"]).groupBy("site", "h").agg(F.min("c2").alias("c2"))
        least = label.join(near, ["site", "h"], "left").select("site", "h", F.col("component").alias("old"), F.least("component", F.coalesce("c2", "component")).alias("component"))
        # a label also hears of what the nodes that bear it have seen
        heard = least.groupBy("site", F.col("old").alias("h")).agg(F.min("component").alias("c3"))
        hooked = least.join(heard, ["site", "h"], "left").select("site", "h", "old", F.least("component", F.coalesce("c3", "component")).alias("component"))
        up = hooked.select("site", F.col("h").alias("component"), F.col("component").alias("above"))
        step = cut(hooked.join(up, ["site", "component"]).select("site", "h", F.col("above").alias("component"), (F.col("above") < F.col("old")).alias("moved")))
        label = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return label


def graph(blocks: DataFrame, **limits) -> tuple[DataFrame, DataFrame]:
    """(nodes, seen): kept nodes (site, h, docs, component) and their occurrences, both materialised. A lone node is a component of its own."""
    nodes = cut(support(blocks, **limits))
    seen = cut(occurrences(blocks, nodes).select("site", "doc_id", "block_id", "line_no", "h").distinct())
    one = edges(blocks, nodes, seen)
    both = cut(one.unionByName(one.select("site", F.col("h2").alias("h"), F.col("h").alias("h2"))).distinct())
    label = components(nodes, both)
    return cut(label.join(nodes, ["site", "h"])), seen


def repeated_lines(blocks: DataFrame, **limits) -> DataFrame:
    """Distinct (block_id, line_no) of the lines that repeat within their site: the occurrences of all components."""
    nodes, seen = graph(blocks, **limits)
    return seen.join(small(nodes), ["site", "h"]).select("block_id", "line_no").distinct()


def boilerplate_blocks(blocks: DataFrame, **limits) -> DataFrame:
    """(site, component, h, docs, lines): kept nodes by connected component of the graph of kept edges."""
    nodes, _ = graph(blocks, **limits)
    size = nodes.groupBy("site", "component").agg(F.count("*").alias("lines"))
    return nodes.join(size, ["site", "component"]).select("site", "component", "h", "docs", "lines")


def without_repeated(blocks: DataFrame, **limits) -> DataFrame:
    """(block_id, clean_text): each block's raw_text without the repeated lines; a block of nothing else becomes empty, null stays null."""
    drop = repeated_lines(blocks, **limits).groupBy("block_id").agg(F.collect_set("line_no").alias("gone"))
    rows = blocks.select("block_id", "raw_text").join(drop, "block_id", "left")
    kept = F.filter(F.split("raw_text", "\n"), lambda _, i: ~F.coalesce(F.array_contains(F.col("gone"), i + 1), F.lit(False)))
    return rows.select("block_id", F.when(F.col("gone").isNull(), F.col("raw_text")).otherwise(F.array_join(kept, "\n")).alias("clean_text")).dropDuplicates(["block_id"])

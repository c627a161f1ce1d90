"""Problem 8: mixing sources towards target weights by systematic sampling.

Each document of a source has an expected number of copies; their prefix sums within the source, shifted by one
random offset, are cut at the integers: a document is emitted once for each integer its interval crosses. The
prefix sums are made in two levels, over hash buckets and within them, so that no source is one task.
"""

from __future__ import annotations

import base64
import os

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchflow.runtime import arrow_map, cut, small

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how that vocabulary cuts texts into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a bucket of the prefix sums; a bucket is one group of one task.
BUCKET_ROWS = 50_000


#: Tokenizers of this process by broadcast; one is kept.
_tokenizers: dict[int, object] = {}


def vocabulary_ranks(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> dict[bytes, int]:
    """The ranks of a vocabulary file, read on the driver; a file of fixed size."""
    with open(os.path.join(folder, vocabulary), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _tokenizer(sent, pattern: str):
    import tiktoken

    at = id(sent.value)
    if at not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[at] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
    return _tokenizers[at]


def token_counts(documents: DataFrame, text: str = "text", folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, source, tokens): source trimmed and in lower case; null or empty text has no tokens. The vocabulary is sent to the executors, which need no such folder."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary_ranks(folder, vocabulary))

    def run(b: dict) -> dict:
        t = _tokenizer(sent, pattern)
        return {"doc_id": b["doc_id"], "source": b["source"], "tokens": [len(t.encode_ordinary(x)) if x else 0 for x in b["t"]]}

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("source")).alias("source"), F.col(text).alias("t")).where("doc_id is not null")
    return arrow_map(rows, run, "doc_id long, source string, tokens long")


def rates(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, rate): expected copies of each document of a source.

    Shares are normalised over all targets. The size of the mix is total_tokens, by default all tokens of the sources
    with targets; a source gets its share of it, at most max_repeats copies of each of its documents. Targets are
    made distinct by normalised name, the largest share winning; null, negative or zero shares ask for nothing.
    """
    t = targets.select(F.lower(F.trim("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats")).where("source is not null")
    t = t.groupBy("source").agg(F.max_by(F.struct("target_share", "max_repeats"), F.struct("target_share", "max_repeats")).alias("x")).select("source", F.greatest(F.col("x.target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.col("x.max_repeats"), F.lit(0)).alias("max_repeats"))
    have = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    both = t.join(have, "source", "left").fillna(0, ["docs", "tokens"])
    both = cut(both)  # a row per target
    shares, all_tokens = both.agg(F.sum("target_share"), F.sum("tokens")).first()
    size = float(total_tokens if total_tokens is not None else all_tokens or 0)
    both = both.withColumn("target_share", F.col("target_share") / F.lit(shares) if shares else F.lit(0.0))
    rate = F.when(F.col("tokens") > 0, F.least(F.col("target_share") * size / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return both.select("source", "target_share", "max_repeats", "docs", "tokens", rate.alias("rate"))


def copies(sized: DataFrame, rate: DataFrame, seed: int = 17, rows: int | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, source, tokens, copies) of the documents whose source has a rate above 0; order is that of a hash of the id.

    sized is one row per document. Whole rates are exact: each document gets as many copies.
    """
    n = max(1, -(-(rows if rows is not None else sized.count()) // bucket_rows))
    docs = sized.join(small(rate.where("rate > 0").select("source", "rate")), "source")
    docs = docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(n)))
    sizes = docs.groupBy("source", "bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # n rows a source
    start = sizes.select("source", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("source", "bucket").orderBy("doc_id")) + F.col("start")
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    edge = lambda r: F.floor(r * F.col("rate") + offset)
    docs = docs.join(start, ["source", "bucket"]).withColumn("r", rank.cast("double"))
    return docs.select("doc_id", "source", "tokens", (edge(F.col("r")) - edge(F.col("r") - 1)).cast("long").alias("copies"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, folder: str = TOKENIZER_DIR) -> tuple[DataFrame, DataFrame]:
    """(copies, report). The report has a row per target and per source without one (target_share 0, nothing taken).

    Documents repeated under one id count once.
    """
    sized = cut(token_counts(documents, folder=folder).dropDuplicates(["doc_id"]))
    rate = cut(rates(sized, targets, total_tokens))
    got = copies(sized, rate, seed)
    taken = got.groupBy("source").agg(F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("tokens")).alias("mixed_tokens"), F.sum((F.col("copies") > 0).cast("long")).alias("docs_used"))
    other = sized.join(small(rate.select("source")), "source", "left_anti").groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    rows = rate.unionByName(other.select("source", F.lit(0.0).alias("target_share"), F.lit(0).alias("max_repeats"), "docs", "tokens", F.lit(0.0).alias("rate")))
    taken = taken.withColumnRenamed("source", "taken_source")
    report = rows.join(taken, F.col("source").eqNullSafe(F.col("taken_source")), "left").drop("taken_source").fillna(0, ["copies", "most_repeats", "mixed_tokens", "docs_used"])
    report = cut(report)  # a row per source
    whole = F.lit(report.agg(F.sum("mixed_tokens")).first()[0] or 0)
    report = report.withColumn("share", F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0))
    return got, report.select("source", "docs", "tokens", "target_share", "max_repeats", F.col("rate").alias("repeats"), "docs_used", "copies", "most_repeats", "mixed_tokens", "share")

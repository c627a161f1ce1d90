"""The row-wise and per-document steps over a stream of blocks; an addition for sources that grow.

Cleaning and classification by a block's own text need no state. Smoothing and Markdown need whole documents: the blocks of each micro-batch are
kept, and the documents it touches are given anew from all their blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchflow.functions.classify import chosen_text
from parchflow.functions.text import clean_text
from parchflow.operators.blocks import build_markdown, classify, classify_documents


def cleaned(stream: DataFrame) -> DataFrame:
    """Blocks with cleaned text and the class of it, block by block."""
    return classify(stream.withColumn("normalized_text", clean_text(chosen_text())))


def arrivals(stream: DataFrame, delay: str | None = None, width: str = "1 day") -> DataFrame:
    """Blocks, distinct documents and characters by day of arrival. Rows weeks late count: there is a state row per window, and no watermark unless
    `delay` is given, which leaves out rows later than that."""
    s = stream.withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))
    s = s.withWatermark("arrived_at", delay) if delay else s
    return s.groupBy(F.window("arrived_at", width)).agg(F.count("*").alias("blocks"), F.approx_count_distinct("doc_id").alias("documents"), F.sum(F.length("raw_text")).alias("chars"))


def write_markdown(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Markdown of the documents of each micro-batch, of all their blocks so far: late blocks give a document anew, whole. Blocks and documents
    go to folders by batch, so that a batch that is run again replaces its own."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/blocks/batch={number}")
        every = spark.read.schema(batch.schema).parquet(f"{path}/blocks/batch=*").where(F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("long") <= number)
        touched = spark.read.schema(batch.schema).parquet(f"{path}/blocks/batch={number}").select("doc_id").distinct()
        blocks = every.join(touched, "doc_id", "left_semi").dropDuplicates(["block_id"])
        build_markdown(classify_documents(blocks)).write.mode("overwrite").parquet(f"{path}/documents/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, markdown): the latest Markdown of each document."""
    d = spark.read.option("basePath", f"{path}/documents").parquet(f"{path}/documents")
    return d.groupBy("doc_id").agg(F.max_by("markdown", "batch").alias("markdown"))

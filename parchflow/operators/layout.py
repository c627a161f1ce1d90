"""Reading order of the blocks of a page, and blocks that lie in tables."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchflow.runtime import ship

PAGE = ["doc_id", "page_number"]


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks whose centre lies in no table box of their page, edges included: an anti join on the page with a range condition."""
    t = tables.select(F.col("doc_id").alias("_d"), F.col("page_number").alias("_p"), *(F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    inside = cx.between(F.col("_x0"), F.col("_x1")) & cy.between(F.col("_y0"), F.col("_y1"))
    return blocks.join(t, (F.col("doc_id") == F.col("_d")) & (F.col("page_number") == F.col("_p")) & inside, "left_anti")


def stacked_pairs(blocks: DataFrame, y_tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page_number, top_no, bottom_no): blocks of a page that continue each other downwards, as a join of pairs of a page
    with an anti join of what lies between. Blocks are (doc_id, page_number, block_no, is_table, x0, y0, x1, y1)."""
    tol = max(y_tolerance, 0.0)
    cols = ("block_no", "x0", "y0", "x1", "y1")
    side = lambda s: blocks.where("not is_table").select(*PAGE, *(F.col(c).alias(f"{s}_{c}") for c in cols))
    w = lambda s: F.col(f"{s}_x1") - F.col(f"{s}_x0")
    p = side("t").join(side("b"), PAGE).where("t_block_no <> b_block_no and (t_y0 < b_y0 or (t_y0 = b_y0 and t_block_no < b_block_no))")
    p = p.where(F.col("t_y1") <= F.col("b_y0") + tol)
    narrow, wide = F.least(w("t"), w("b")), F.greatest(w("t"), w("b"))
    overlap = F.least("t_x1", "b_x1") - F.greatest("t_x0", "b_x0")
    p = p.where((wide > 0) & (narrow / wide >= 0.6) & F.when(narrow != 0, overlap / narrow >= 0.6).otherwise(False))
    o = blocks.select(*(F.col(c).alias(f"_{c}") for c in PAGE), *(F.col(c).alias(f"o_{c}") for c in cols))
    between = (F.col("o_y0") >= F.col("t_y1") - tol) & (F.col("o_y1") <= F.col("b_y0") + tol) & (F.least(F.greatest("t_x1", "b_x1"), F.col("o_x1")) > F.greatest(F.least("t_x0", "b_x0"), F.col("o_x0")))
    other = (F.col("o_block_no") != F.col("t_block_no")) & (F.col("o_block_no") != F.col("b_block_no"))
    p = p.join(o, (F.col("doc_id") == F.col("_doc_id")) & (F.col("page_number") == F.col("_page_number")) & between & other, "left_anti")
    return p.select(*PAGE, F.col("t_block_no").alias("top_no"), F.col("b_block_no").alias("bottom_no"))


def reading_order(boxes: np.ndarray, is_table: np.ndarray, y_tolerance: float = 3.0) -> list[int]:
    """Indexes of the boxes (x0, y0, x1, y1) of a page in reading order: stacks of blocks that continue each other, from the top, then the left.

    The comparison of stacks isn't transitive, so the order of input can matter where stacks overlap in a circle.
    """
    n, tol = len(boxes), max(y_tolerance, 0.0)
    if n < 2:
        return list(range(n))
    x0, y0, x1, y1 = boxes.T
    width = x1 - x0
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(n):
        if is_table[i]:
            continue
        # candidates below i, all at once
        below = ~is_table & ((y0 > y0[i]) | ((y0 == y0[i]) & (np.arange(n) > i))) & (y1[i] <= y0 + tol)
        narrow, wide = np.minimum(width, width[i]), np.maximum(width, width[i])
        with np.errstate(divide="ignore", invalid="ignore"):
            fit = (wide > 0) & (narrow / wide >= 0.6) & ((np.minimum(x1, x1[i]) - np.maximum(x0, x0[i])) / narrow >= 0.6)
        for j in np.flatnonzero(below & fit).tolist():
            left, right = min(x0[i], x0[j]), max(x1[i], x1[j])
            blocked = (y0 >= y1[i] - tol) & (y1 <= y0[j] + tol) & (np.minimum(right, x1) > np.maximum(left, x0))
            blocked[[i, j]] = False
            if not blocked.any():
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    stacks: dict[int, list[int]] = {}
    for i in range(n):
        stacks.setdefault(root(i), []).append(i)
    groups = [(min(x0[k]), min(y0[k]), max(y1[k]), sorted(k, key=lambda i: (y0[i], x0[i]))) for k in stacks.values()]

    def before(a: tuple, b: tuple) -> int:
        if a[2] <= b[1] + tol:
            return -1
        if b[2] <= a[1] + tol:
            return 1
        return -1 if a[:2] < b[:2] else 1

    return [i for g in sorted(groups, key=cmp_to_key(before)) for i in g[3]]


def sort_blocks(blocks: DataFrame, y_tolerance: float = 3.0, x_tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page_number, block_no, page_ord): the place of each block of (doc_id, page_number, block_no, is_table, x0, y0, x1, y1) on its page, from 0.

    A page is a group; x_tolerance is accepted and has no effect. Partitions hold whole pages in order and are streamed,
    so that small pages cost no call each. Blocks with a null coordinate keep their input order after the others.
    """
    ship(blocks.sparkSession)
    cols = ["doc_id", "page_number", "block_no", "is_table", "x0", "y0", "x1", "y1"]
    b = blocks.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page_number").cast("int").alias("page_number"), F.col("block_no").cast("long").alias("block_no"), F.coalesce("is_table", F.lit(False)).alias("is_table"), *(F.col(c).cast("double").alias(c) for c in cols[4:]))
    b = b.repartition(*PAGE).sortWithinPartitions(*PAGE, "block_no")
    schema = pa.schema([("doc_id", pa.int64()), ("page_number", pa.int32()), ("block_no", pa.int64()), ("page_ord", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, rows, out = None, [], [[], [], [], []]

        def close() -> None:
            whole = [r for r in rows if None not in r[2:]]
            order = reading_order(np.array([r[4 - 2 :] for r in whole], float).reshape(-1, 4), np.array([r[1] for r in whole], bool), y_tolerance)
            ids = [whole[i][0] for i in order] + [r[0] for r in rows if None in r[2:]]
            for k, no in enumerate(ids):
                for c, v in zip(out, (*page, no, k)):
                    c.append(v)

        for batch in batches:
            for d, p, *rest in zip(*(batch.column(i).to_pylist() for i in range(len(cols)))):
                if (d, p) != page:
                    if rows:
                        close()
                    page, rows = (d, p), []
                rows.append(tuple(rest))
            if len(out[0]) > 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)
                out = [[], [], [], []]
        if rows:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)

    return b.mapInArrow(run, "doc_id long, page_number int, block_no long, page_ord int")

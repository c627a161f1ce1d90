"""Every query with an SQL equal gives the rows of it at the smallest scale."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_whole_texts(spark, sf):
    """The flagship keeps the text of every block, and the pipeline sets links."""
    squeeze = lambda x: "".join(c for c in x if c.isalnum())
    docs = {r.doc_id: squeeze(r.markdown) for r in entry.core.flagship(spark, sf).collect()}
    kept = [squeeze(r.normalized_text or r.raw_text) in docs[r.doc_id] for r in entry.core.distinct_blocks(spark, sf).where("block_type = 'paragraph' and block_id % 9 not in (2, 8)").collect()]
    assert len(kept) > 100 and sum(kept) > 0.9 * len(kept)
    t = entry.core.decoded_tables(spark, sf)
    assert {"words_raw", "links_raw"} <= set(t)
    assert any("](u/" in r.markdown for r in entry.queries()["pipeline"](spark, sf).collect())

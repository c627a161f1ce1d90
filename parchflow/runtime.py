"""Session helpers shared by all operators: tables, checkpoints, size-checked broadcasts, Arrow maps."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

#: Rows up to which a counted table may be broadcast.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a folder of our own only where none is named."""
    sc = spark.sparkContext
    if not (at := sc.getCheckpointDir()):
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not at:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            at = tempfile.mkdtemp(prefix="parchflow-")
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Write df to the checkpoint folder and read it from there: computed once, survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised df, marked for broadcast only if a count shows at most `rows` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that functions sent to them can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).parent
    to = Path(tempfile.mkdtemp(prefix="parchflow-")) / "parchflow.zip"  # on the driver; Spark serves it from there
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))


def arrow_map(df: DataFrame, fn: Callable[[dict[str, list]], Iterable[dict[str, list]] | dict[str, list]], schema: str) -> DataFrame:
    """mapInArrow with plain Python lists: fn gets the columns of a batch and returns columns of any length."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship(df.sparkSession)
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, schema)


def where_needed(c: Column, needed: Column, fn: Callable[[str], str]) -> Column:
    """fn of the texts that need it; of the others only nulls go to Python."""
    return F.coalesce(string_udf(fn)(F.when(needed, c)), c)


def string_udf(fn: Callable[[str | None], str | None]) -> Callable[[Column], Column]:
    """An Arrow function of one string column, null for null; the package is sent to the executors of the active session."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)

    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else fn(t) for t in s], dtype=object)

    return pandas_udf(run, StringType())

"""Pieces that several operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a Python worker gets at a time; long texts make larger batches costly.
BATCH_ROWS = 512
#: Bytes that a batch may hold, so that very long texts do not meet in one.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A local session without one gets a folder of its own; on a cluster a machine's own folder would
    lose rows silently, so there an unset folder is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "/tmp/folioflow-checkpoints"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables that an operator writes between its steps.

    Writing cuts lineage, so that a lost executor costs one stage, gives the optimiser real sizes, and
    lets adaptive execution split skewed joins on what was an aggregate.  ``discard`` deletes what
    was written, but for the frames that a lazy result still reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/folioflow/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.folio_path = path  # frames know their place, so that none is held here
        self.paths.append(path)
        return out

    def discard(self, *keep: DataFrame) -> None:
        held = {df.folio_path for df in keep}
        for path in [p for p in self.paths if p not in held]:
            remove(self.spark, path)
        self.paths = [p for p in self.paths if p in held]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that Spark writes with."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def word_count(text: Column) -> Column:
    """Words of ``text``; 0 for null.  Counts word starts, so no array of words is built."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of at most BATCH_ROWS rows and, but for single rows, about BATCH_BYTES; Spark itself bounds
    the batches that workers get by bytes."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rows = BATCH_ROWS
            while rows > 1 and batch.slice(at, rows).nbytes > BATCH_BYTES:
                rows //= 2
            yield batch.slice(at, rows)
            at += rows


def by_batch(
    df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]]
) -> DataFrame:
    """Maps record batches to dicts of columns; ``make`` runs once in each Python worker task."""
    out = spark_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, names = None, [f.name for f in out.fields]
        arrow = to_arrow(out)
        for batch in pieces(batches):
            work = work or make()
            columns = work(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.mapInArrow(run, out)


def spark_schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)

"""Helpers shared by the operators: the shared folder, written tables, Arrow batches and packed blocks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_fallback_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or a temporary one if a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
    if not _fallback_dir:
        _fallback_dir.append("file://" + tempfile.mkdtemp(prefix="sextant-"))
    return _fallback_dir[0]


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder's name under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: lineage ends here, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables between an operator's steps, in a folder of their own; drop() removes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.paths = spark, work_dir(spark, name), []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{len(self.paths):03d}-{name}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *but: str) -> None:
        """Remove all tables but those of these names."""
        for path in self.paths:
            if path.rpartition("-")[2] not in but:
                p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def crc_mod(col: Column, m: int) -> Column:
    """crc32 of the value as text, modulo m."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(m))


def give_back() -> None:
    """Return what a worker process has freed but still holds to the system: workers wait for later tasks, beside others that need memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not the GNU library
        pass


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """mapInArrow with per-task state: make() runs once a task and gives the function from batch to columns. A task gives
    back the memory it has freed."""
    out = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or make()
            columns = step(batch)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in out], schema=out)
        step = batch = columns = None
        give_back()

    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))

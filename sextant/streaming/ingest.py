"""Extension: ingestion as a stream. New rows are chunked as they come, and the newest version of each identity wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sextant.operators.ingest import windowed


def source(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def latest(stream: DataFrame, identity: str, time_col: str) -> DataFrame:
    """Per identity the row of the greatest time, as a running aggregate: partial per task, one state row a key."""
    rest = F.struct(time_col, *(c for c in stream.columns if c not in (identity, time_col)))
    return stream.groupBy(identity).agg(F.max(rest).alias("row")).select(identity, "row.*")


def counts_by_window(stream: DataFrame, time_col: str, width: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, width), *keys).agg(F.count("*").alias("n"))


def chunks_to(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, size: int = 1800, overlap: int = 200) -> StreamingQuery:
    """Chunk each batch of documents (id, text) and hand it, with its number, to a sink that may see a number twice."""
    def batch(docs: DataFrame, number: int) -> None:
        sink(windowed(docs, size, overlap), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_of(state: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a running aggregate's whole state after each batch, under the batch's number: a batch that runs again
    replaces its own folder."""
    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return state.writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The state after the last batch that table_of() has written."""
    rows = spark.read.option("basePath", path).parquet(path)
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).drop("batch")

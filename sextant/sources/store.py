"""A chunk store over Parquet: each change writes the next state and moves the pointer file to it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import ingest, retrieval


class ParquetStore:
    """Chunks (id, collection, document_id, text, embedding). One writer at a time; readers see whole states."""

    SCHEMA = "id long, collection string, document_id long, text string, embedding array<float>"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _version(self) -> str | None:
        fs, path = self._path(f"{self.root}/CURRENT")
        return self.spark.read.text(f"{self.root}/CURRENT").first()[0] if fs.exists(path) else None

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def chunks(self) -> DataFrame:
        version = self._version()
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.root}/{version}") if version else self.spark.createDataFrame([], self.SCHEMA)

    def _commit(self, state: DataFrame) -> None:
        version = uuid.uuid4().hex
        state.select(*(c.split()[0] for c in self.SCHEMA.split(", "))).write.parquet(f"{self.root}/{version}")
        self.spark.createDataFrame([(version,)], "v string").coalesce(1).write.mode("overwrite").text(f"{self.root}/CURRENT")

    def store(self, chunks: DataFrame) -> None:
        self._commit(ingest.upserted(self.chunks(), chunks, ["id"]))

    def delete(self, ids: DataFrame, collection: str) -> None:
        gone = ids.select("id").distinct().withColumn("collection", F.lit(collection))
        self._commit(self.chunks().join(gone, ["id", "collection"], "left_anti"))

    def clear(self, collection: str) -> None:
        self._commit(self.chunks().where(F.col("collection") != collection))

    def search(self, query: list[float], k: int = 10, *, threshold: float = 0.0, collections: list[str] | None = None) -> DataFrame:
        return retrieval.vector_topk(retrieval.scoped(self.chunks(), collections=collections), query, k, threshold)

    def search_text(self, query: str, k: int = 10, *, collections: list[str] | None = None) -> DataFrame:
        rows = retrieval.scoped(self.chunks(), collections=collections).withColumn("tokens", T.tokens(F.col("text")))
        return retrieval.keyword_topk(rows, T.query_terms(F.lit(query)), k)

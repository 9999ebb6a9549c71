"""A knowledge graph over Parquet: each change writes the next state of all tables, then moves the pointer file."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import graph as G
from sextant.operators import ingest as I
from sextant.operators import retrieval as R

SCHEMAS = {
    "entities": "id string, name string, type string, description string, embedding array<float>, collection string",
    "mentions": "entity_id string, chunk_id long",
    "relationships": "id string, source_id string, target_id string, type string, description string, strength int",
    "communities": "id string, collection string, level int, entity_ids array<string>, summary string, dirty boolean",
}


class ParquetGraph:
    """One writer at a time; readers see whole states."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def tables(self) -> dict[str, DataFrame]:
        pointer = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT")
        if not pointer.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(pointer):
            return {k: self.spark.createDataFrame([], s) for k, s in SCHEMAS.items()}
        version = self.spark.read.text(f"{self.root}/CURRENT").first()[0]
        return {k: self.spark.read.schema(s).parquet(f"{self.root}/{version}/{k}") for k, s in SCHEMAS.items()}

    def persist(self, tables: dict[str, DataFrame]) -> None:
        version = uuid.uuid4().hex
        for name, schema in SCHEMAS.items():
            columns = [c.split(" ", 1) for c in schema.split(", ")]
            known = set(tables[name].columns)
            tables[name].select(*((F.col(c) if c in known else F.lit(None)).cast(kind).alias(c) for c, kind in columns)).write.parquet(f"{self.root}/{version}/{name}")
        self.spark.createDataFrame([(version,)], "v string").coalesce(1).write.mode("overwrite").text(f"{self.root}/CURRENT")

    def change(self, f: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> None:
        self.persist(f(self.tables()))

    def _added(self, name: str, rows: DataFrame, key: Sequence[str]) -> None:
        """Rows of a table that its key doesn't hold yet; of several new ones with one key, the first by id."""
        def add(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
            new = rows.select(*rows.columns, *(F.lit(None).cast(k).alias(c) for c, k in t[name].dtypes if c not in rows.columns))
            return t | {name: I.insert_or_ignore(t[name], new, key)}

        self.change(add)

    # what a build writes

    def persist_entities(self, collection: str, rows: DataFrame) -> DataFrame:
        """Entities (name, type, ...) of a collection, one for each normalized name: an old one stays as it is. Gives id and name_key of the collection's entities.

        Ids are hashes of collection and normalized name, so a build that runs again writes the same.
        """
        key = T.normalized_name(F.col("name"))
        named = rows.where(F.coalesce(key, F.lit("")) != "").withColumn("id", F.sha2(F.concat_ws(chr(0), F.lit(collection), key), 256)).withColumn("collection", F.lit(collection))
        self._added("entities", R.first_of(named, ["id"], ["name"]), ["id"])
        return self.find_entities(collection).select("id", T.normalized_name(F.col("name")).alias("name_key"))

    def persist_relationships(self, rows: DataFrame, ids: DataFrame) -> None:
        """Relationships (source, target, type, ...) by names, resolved through ids (id, name_key); unknown ends go."""
        ends = G.resolve(G.resolve(rows, ids, "source", "source_id"), ids, "target", "target_id")
        named = G.valid_relationships(ends).withColumn("id", F.sha2(F.concat_ws("|", "source_id", "type", "target_id"), 256))
        self._added("relationships", named.select(*(c for c in named.columns if c not in ("source", "target"))), ["id"])

    def persist_mentions(self, rows: DataFrame, ids: DataFrame) -> None:
        """Mentions (name, chunk_id), resolved through ids, each entity once a chunk."""
        self._added("mentions", G.resolve(rows, ids, "name", "entity_id").select("entity_id", "chunk_id"), ["entity_id", "chunk_id"])

    def persist_communities(self, collection: str, rows: DataFrame) -> None:
        """The collection's communities (level, entity_ids, summary, dirty) in place of those it had."""
        named = rows.withColumn("collection", F.lit(collection)).withColumn("id", F.sha2(F.concat_ws("|", "collection", "level", F.array_join(F.array_sort("entity_ids"), ",")), 256))

        def put(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
            others = t["communities"].where(~F.col("collection").eqNullSafe(F.lit(collection)))
            return t | {"communities": others.unionByName(named, allowMissingColumns=True)}

        self.change(put)

    # search and traversal

    def search(self, names: Sequence[str], depth: int = 0, decay: float = 0.5, collections: Sequence[str] | None = None) -> DataFrame:
        t = self.tables()
        return G.graph_search(t["entities"], t["mentions"], t["relationships"], names, depth=depth, decay=decay, collections=collections)

    def search_by_embedding(self, query: Sequence[float], collections: Sequence[str] | None = None, limit: int = 20, threshold: float = 0.3) -> DataFrame:
        """Entities whose vectors are nearest to the query, above the threshold."""
        return R.vector_topk(R.scoped(self.tables()["entities"], collections=collections), list(query), limit, threshold)

    def related(self, start: DataFrame, depth: int = 1) -> DataFrame:
        t = self.tables()
        return G.expand(start, t["relationships"], depth).join(t["entities"], "id")

    # deletion

    def delete_by_chunks(self, chunk_ids: DataFrame) -> None:
        self.change(lambda t: G.delete_chunks(t, chunk_ids))

    def delete_by_collection(self, collection: str) -> None:
        def without(t: dict[str, DataFrame]) -> dict[str, DataFrame]:
            left = G.delete_collection(t, collection)
            return left | {"communities": left["communities"].where(~F.col("collection").eqNullSafe(F.lit(collection)))}

        self.change(without)

    def sweep(self, collection: str | None) -> None:
        self.change(lambda t: G.sweep_orphans(t, collection))

    # single rows and listings

    def _one(self, table: str, key: str) -> dict | None:
        row = self.tables()[table].where(F.col("id") == key).limit(1).collect()
        return row[0].asDict() if row else None

    def entity(self, key: str) -> dict | None:
        return self._one("entities", key)

    def relationship(self, key: str) -> dict | None:
        return self._one("relationships", key)

    def community(self, key: str) -> dict | None:
        return self._one("communities", key)

    def find_entities(self, collection: str) -> DataFrame:
        return self.tables()["entities"].where(F.col("collection") == collection)

    def relationships(self, key: str) -> DataFrame:
        """Relationships with the entity at either end, with both names."""
        t = self.tables()
        return G.detailed(G.relationships_of(self.spark.createDataFrame([(key,)], "id string"), t["relationships"]), t["entities"])

    def mentions(self, key: str, chunks: DataFrame, limit: int = 5) -> DataFrame:
        return G.mention_details(self.spark.createDataFrame([(key,)], "id string"), self.tables()["mentions"], chunks, limit)

    def community_summaries(self, collection: str, levels: int | Sequence[int] | str | None = None, entity: str | None = None) -> DataFrame:
        rows = self.tables()["communities"].where((F.col("collection") == collection) & G.at_levels(levels))
        return rows if entity is None else rows.where(F.array_contains("entity_ids", entity))

    def list_entities(self, *, collection: str | None = None, kind: str | None = None, name: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        t = self.tables()
        rows = self._matching(t["entities"], collection=collection, type=kind)
        rows = rows if name is None else rows.where(F.contains(F.lower("name"), F.lit(name.lower())))
        return I.page_of(G.entity_counts(rows, t["mentions"], t["relationships"]), ["name", "id"], limit, offset)

    def list_relationships(self, *, collection: str | None = None, kind: str | None = None, bucket: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        t = self.tables()
        rows = self._matching(t["relationships"], type=kind)
        if bucket is not None:
            rows = rows.where(G.strength_bucket(F.col("strength")) == bucket)
        if collection is not None:
            own = t["entities"].where(F.col("collection") == collection).select(F.col("id").alias("source_id"))
            rows = rows.join(own, "source_id", "left_semi")
        return I.page_of(G.detailed(rows, t["entities"]), ["source_name", "target_name", "id"], limit, offset)

    def list_communities(self, *, collection: str | None = None, levels: int | Sequence[int] | str | None = None, summary: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        rows = self._matching(self.tables()["communities"], collection=collection).where(G.at_levels(levels))
        rows = rows if summary is None else rows.where(F.contains(F.lower("summary"), F.lit(summary.lower())))
        return I.page_of(rows.withColumn("entity_count", F.size("entity_ids")), ["level", F.desc("entity_count"), "id"], limit, offset)

    @staticmethod
    def _matching(rows: DataFrame, **equal: str | None) -> DataFrame:
        for column, value in equal.items():
            if value is not None:
                rows = rows.where(F.col(column) == value)
        return rows

    def info(self) -> dict:
        """Numbers of rows, entities without a collection, and communities whose summaries are out of date."""
        t = self.tables()
        out = {k: df.count() for k, df in t.items()}
        out["orphaned_entities"] = t["entities"].where(F.col("collection").isNull()).count()
        out["dirty_communities"] = t["communities"].where("dirty").count()
        return out

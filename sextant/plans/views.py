"""The tables as the engine's chunks, vectors, entities, mentions and relationships."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("collection"), "source")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a document that has a vector: id, text, collection, source, embedding, label."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return documents(spark, sf_dir).join(vectors, "id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector, for the driver."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0])


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query, query_label: every vector as a question."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))


def terms(*words: str) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def with_tokens(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tokens", T.tokens(F.col("text")))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, type, collection: suppliers, parts, nations and regions; a supplier's collection is its region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    place = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("id")
    s = table(spark, sf_dir, "supplier").join(F.broadcast(place), F.col("s_nationkey") == F.col("n_nationkey"))
    parts = [
        s.select(key("s", "s_suppkey"), F.col("s_name").alias("name"), F.lit("supplier").alias("type"), F.col("r_name").alias("collection")),
        table(spark, sf_dir, "part").select(key("p", "p_partkey"), F.col("p_name").alias("name"), F.lit("part").alias("type"), F.lit(None).cast("string").alias("collection")),
        place.select(key("n", "n_nationkey"), F.col("n_name").alias("name"), F.lit("nation").alias("type"), F.col("r_name").alias("collection")),
        region.select(key("r", "r_regionkey"), F.col("r_name").alias("name"), F.lit("region").alias("type"), F.col("r_name").alias("collection")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, target_id, type, strength: suppliers in nations in regions, and the parts that suppliers have shipped."""
    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    line = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.least(F.lit(10), F.count("*")).cast("int").alias("strength"))
    row = lambda df, a, b, kind, strength: df.select(a.alias("source_id"), b.alias("target_id"), F.lit(kind).alias("type"), strength.alias("strength"))
    located = row(table(spark, sf_dir, "supplier"), key("s", "s_suppkey"), key("n", "s_nationkey"), "LOCATED_IN", F.lit(10))
    within = row(table(spark, sf_dir, "nation"), key("n", "n_nationkey"), key("r", "n_regionkey"), "PART_OF", F.lit(10))
    supplies = row(line, key("s", "l_suppkey"), key("p", "l_partkey"), "SUPPLIES", F.col("strength"))
    return located.unionByName(within).unionByName(supplies)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, chunk_id: the parts that an order names."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("entity_id"), F.col("l_orderkey").alias("chunk_id")).distinct()


def region_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, level, entity_ids, summary...: level 0 a nation's suppliers, level 1 a region's."""
    e = entities(spark, sf_dir).where("type = 'supplier'")
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("k"))
    low = s.groupBy(F.concat(F.lit("n"), F.col("k").cast("string")).alias("cid")).agg(F.array_sort(F.collect_list("id")).alias("entity_ids")).select("cid", F.lit(0).alias("level"), "entity_ids")
    high = e.groupBy(F.concat(F.lit("R-"), F.col("collection")).alias("cid")).agg(F.array_sort(F.collect_list("id")).alias("entity_ids")).select("cid", F.lit(1).alias("level"), "entity_ids")
    rows = low.union(high).withColumnRenamed("cid", "id")
    n = F.size("entity_ids")
    return rows.select("id", "level", "entity_ids", F.when(n % 3 != 0, F.concat(F.lit("summary of "), "id")).alias("summary"), (n % 2 == 0).alias("dirty"), (n % 13).alias("change_count"), F.when(n % 5 != 0, F.lit("f")).alias("summary_fingerprint"))

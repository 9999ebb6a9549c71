"""Hierarchical communities: local moving by modularity or the constant Potts model, connected parts, contraction, level by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.operators.components import connected
from sextant.operators.graph import community_lists, hierarchy, weighted_edges
from sextant.plans.storage import cut


@dataclass(frozen=True)
class Detection:
    """objective: cpm or modularity. A greater resolution gives more and smaller communities. rounds bound a level's moves,
    max_level the last level; communities under min_size aren't listed. seed deals nodes to the rounds in which they may move."""

    objective: str = "cpm"
    resolution: float = 1.0
    rounds: int = 16
    max_level: int = 3
    min_size: int = 1
    seed: int = 0

    def __post_init__(self) -> None:
        if self.objective not in ("cpm", "modularity"):
            raise ValueError("objective must be cpm or modularity")
        if self.resolution <= 0 or self.rounds < 1 or self.max_level < 0 or self.min_size < 1:
            raise ValueError("resolution, rounds and min_size must be positive, max_level at least 0")


def moved(nodes: DataFrame, edges: DataFrame, how: Detection, total: float) -> DataFrame:
    """(id, community) after local moving. nodes: id, size, degree; edges: a, b, weight in both directions, no loops.

    In a round, each node of one half sees what its weights to a community bring less what the objective expects of its
    size, and takes the best of its neighbours' communities if that is more than in its own. The halves change by a hash
    of id, seed and round, so neighbours seldom swap places; a single node only joins another single one of a smaller
    label. Ends after two rounds without a move.
    """
    labels, still = cut(nodes.withColumn("community", F.col("id"))), 0
    for number in range(how.rounds):
        mass = "size" if how.objective == "cpm" else "degree"
        scale = how.resolution if how.objective == "cpm" else how.resolution / max(total, 1e-300)
        sums = labels.groupBy("community").agg(F.sum(mass).alias("mass"), F.count("*").alias("members"))
        links = edges.join(labels.select(F.col("id").alias("b"), "community"), "b").groupBy(F.col("a").alias("id"), "community").agg(F.sum("weight").alias("weight"))
        every = links.unionByName(labels.select("id", "community", F.lit(0.0).alias("weight"))).groupBy("id", "community").agg(F.sum("weight").alias("weight"))
        own = labels.select("id", F.col(mass).alias("own_mass"), F.col("community").alias("own"))
        rows = every.join(own, "id").join(sums, "community")
        stays = F.col("community") == F.col("own")
        gain: Column = F.col("weight") - F.lit(scale) * F.col("own_mass") * (F.col("mass") - F.when(stays, F.col("own_mass")).otherwise(0.0))
        best = rows.withColumn("gain", gain).groupBy("id").agg(
            F.min_by(F.struct("community", "gain", "members"), F.struct(-F.col("gain"), ~stays, F.col("community"))).alias("best"),
            F.max(F.when(stays, F.struct("gain", "members"))).alias("now"),
        )
        may = F.pmod(F.xxhash64("id", F.lit(how.seed), F.lit(number // 2)) + number, F.lit(2)) == 0
        singles = (F.col("best.members") == 1) & (F.col("now.members") == 1)
        goes = may & (F.col("best.gain") > F.col("now.gain") + 1e-9) & (~singles | (F.col("best.community") < F.col("community")))
        both = labels.join(best, "id")
        new = cut(both.select("id", "size", "degree", F.when(goes, F.col("best.community")).otherwise(F.col("community")).alias("community"), goes.alias("goes")))
        labels = new.drop("goes")
        still = still + 1 if new.where("goes").isEmpty() else 0
        if still == 2:
            break
    return labels.select("id", "community")


def connected_parts(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Communities cut into the parts that edges inside them connect, each named by its smallest id."""
    a, b = labels.toDF("a", "__a"), labels.toDF("b", "__b")
    inside = edges.where("a < b").join(a, "a").join(b, "b").where(F.col("__a") == F.col("__b")).select("a", "b")
    found = connected(inside, lambda df, _: cut(df))
    return cut(labels.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("community")))


def detect_levels(entities: DataFrame, relationships: DataFrame, how: Detection = Detection()) -> list[DataFrame]:
    """Memberships (id, community) from fine to coarse, without those equal to the one before; at least one.

    Weights are strengths, 1 where there is none; relationships with unknown ends don't count. A level's communities are the
    nodes of the next.
    """
    raw = weighted_edges(relationships, entities).select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("weight").cast("double").alias("weight")).where("a != b")
    edges = cut(raw.union(raw.select("b", "a", "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    degrees = edges.groupBy(F.col("a").alias("id")).agg(F.sum("weight").alias("degree"))
    nodes = cut(entities.select("id").distinct().join(degrees, "id", "left").select("id", F.lit(1.0).alias("size"), F.coalesce("degree", F.lit(0.0)).alias("degree")))
    total = edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    members = nodes.select("id", F.col("id").alias("community"))
    levels = []
    for _ in range(how.max_level + 1):
        labels = connected_parts(moved(nodes, edges, how, total), edges)
        if levels and labels.where(F.col("id") != F.col("community")).isEmpty():
            break
        members = cut(members.join(labels.toDF("community", "__next"), "community").select("id", F.col("__next").alias("community")))
        levels.append(members)
        grouped = nodes.join(labels, "id")
        nodes = cut(grouped.groupBy(F.col("community").alias("id")).agg(F.sum("size").alias("size"), F.sum("degree").alias("degree")))
        a, b = labels.toDF("a", "__a"), labels.toDF("b", "__b")
        edges = cut(edges.join(a, "a").join(b, "b").where(F.col("__a") != F.col("__b")).groupBy(F.col("__a").alias("a"), F.col("__b").alias("b")).agg(F.sum("weight").alias("weight")))
        if edges.isEmpty():
            break
    return hierarchy(levels)


def detect(entities: DataFrame, relationships: DataFrame, how: Detection = Detection()) -> DataFrame:
    """community, level, entity_ids of all levels."""
    lists = [community_lists(m, i, how.min_size) for i, m in enumerate(detect_levels(entities, relationships, how))]
    out = lists[0]
    for more in lists[1:]:
        out = out.unionByName(more)
    return out


def detect_by_collection(entities: DataFrame, relationships: DataFrame, how: Detection = Detection()) -> DataFrame:
    """As detect(), each collection by itself: relationships between collections don't count."""
    where = entities.select("id", "collection")
    a, b = where.toDF("source_id", "__a"), where.toDF("target_id", "__b")
    own = relationships.join(a, "source_id").join(b, "target_id").where(F.col("__a").eqNullSafe(F.col("__b"))).drop("__a", "__b")
    return detect(entities, own, how)


def quality(labels: DataFrame, entities: DataFrame, relationships: DataFrame, how: Detection = Detection()) -> float:
    """The objective's value of a membership: weight inside less what the objective expects."""
    raw = weighted_edges(relationships, entities).where("source_id != target_id")
    a, b = labels.toDF("source_id", "__a"), labels.toDF("target_id", "__b")
    inside = raw.join(a, "source_id").join(b, "target_id").where(F.col("__a") == F.col("__b")).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    ends = raw.select(F.explode(F.array("source_id", "target_id")).alias("id"), "weight").groupBy("id").agg(F.sum("weight").alias("degree"))
    sums = labels.join(ends, "id", "left").groupBy("community").agg(F.count("*").alias("n"), F.sum(F.coalesce("degree", F.lit(0))).alias("k"))
    if how.objective == "cpm":
        expected = sums.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0]
    else:
        m = raw.agg(F.sum("weight")).first()[0] or 1
        expected = sums.agg(F.sum(F.col("k") * F.col("k"))).first()[0] / (4 * m)
    return float(inside) - how.resolution * float(expected or 0)

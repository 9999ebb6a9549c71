"""Knowledge graphs as entity, mention, relationship and community tables: build, traverse, search, detect, maintain.

entities: id, name, type, collection; mentions: entity_id, chunk_id; relationships: source_id, target_id, type, strength;
communities: id, level, entity_ids, summary and bookkeeping. Functions return new tables; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators.components import connected
from sextant.operators.retrieval import first_of, fuse, ranked, scoped, top
from sextant.plans.storage import cut


# --- building ---------------------------------------------------------------------------------------------------


def extract(chunks: DataFrame) -> DataFrame:
    """chunk_id, name, type of every entity that a chunk (id, text) names, each once a chunk."""
    found = chunks.select(F.col("id").alias("chunk_id"), F.posexplode(T.entities_in(F.col("text"))).alias("place", "name"))
    return found.select("chunk_id", "name", T.entity_type(F.col("name"), F.col("place")).alias("type"))


def distinct_entities(found: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """One row a normalized name, the first seen; names that normalize to nothing go."""
    keyed = found.withColumn("name_key", T.normalized_name(F.col("name"))).where(F.col("name_key") != "")
    return first_of(keyed, ["name_key"], order)


def resolve(rows: DataFrame, entities: DataFrame, name_col: str, id_col: str) -> DataFrame:
    """Adds id_col, the id of the entity of that name; rows with unknown names go."""
    keys = entities.select(F.col("id").alias(id_col), F.col("name_key").alias("__key"))
    return rows.withColumn("__key", T.normalized_name(F.col(name_col))).join(keys, "__key").drop("__key")


def cooccurrences(mentions: DataFrame, block: int = 64) -> DataFrame:
    """Extension: source_id < target_id named in the same chunk, strength the number of such chunks.

    Every pair of every chunk. A chunk's entities lie in blocks of `block` by id; pairs of blocks are dealt out, so that a
    large chunk's pairs come from many tasks, and counted there before the shuffle.
    """
    groups = mentions.distinct().groupBy("chunk_id").agg(F.array_sort(F.collect_set("entity_id")).alias("e")).where(F.size("e") > 1)
    last = F.floor((F.size("e") - 1) / block).cast("int")
    lefts = groups.select("chunk_id", "e", last.alias("last"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    both = lefts.select("chunk_id", "e", "i", F.explode(F.sequence("i", "last")).alias("j"))
    part = lambda c: F.slice("e", F.col(c) * block + 1, block)
    blocks = both.select("chunk_id", "i", "j", part("i").alias("a"), part("j").alias("b")).repartition("chunk_id", "i", "j")
    pairs = blocks.select(F.explode("a").alias("source_id"), "b").select("source_id", F.explode("b").alias("target_id")).where("source_id < target_id")
    return pairs.groupBy("source_id", "target_id").agg(F.count("*").alias("strength"))


def weighted_edges(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """source_id, target_id, weight (strength or 1) of relationships between known entities."""
    ids = entities.select("id")
    rows = relationships.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return rows.select("source_id", "target_id", F.coalesce(F.col("strength"), F.lit(1)).alias("weight"))


def valid_relationships(raw: DataFrame) -> DataFrame:
    """Types in upper snake case, strengths from 1 to 10, no loops."""
    return raw.where("source_id != target_id").withColumn("type", T.relation_type(F.col("type"))).withColumn("strength", F.coalesce(T.clamped(F.col("strength"), 1, 10).cast("int"), F.lit(5)))


def merged(a: dict[str, DataFrame], b: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two builds as one: entities once a name, the first build first; relationships and mentions together."""
    both = a["entities"].withColumn("__build", F.lit(0)).unionByName(b["entities"].withColumn("__build", F.lit(1)))
    return {"entities": first_of(both, ["name_key"], ["__build", "id"]).drop("__build"), **{k: a[k].unionByName(b[k]) for k in ("relationships", "mentions")}}


# --- traversal --------------------------------------------------------------------------------------------------


def adjacency(relationships: DataFrame) -> DataFrame:
    """a, b in both directions, each once."""
    return relationships.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(relationships.select("target_id", "source_id")).where("a != b").distinct()


def expand(start: DataFrame, relationships: DataFrame, depth: int, allowed: DataFrame | None = None) -> DataFrame:
    """id, hop: what the start entities (id) reach within depth hops, with the least hop; the start has hop 0.

    allowed (id) limits the neighbours that may be entered. The frontier is joined a hop at a time, and lineage is cut;
    with more than one hop, the edges are computed once. Repeated edges aren't removed first: what a hop reaches is
    made distinct, which is less.
    """
    edges = relationships.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(relationships.select("target_id", "source_id"))
    if allowed is not None:
        edges = edges.join(allowed.select(F.col("id").alias("b")).distinct(), "b", "left_semi").select("a", "b")
    if depth > 1:
        edges = cut(edges)
    seen = cut(start.select("id").distinct().withColumn("hop", F.lit(0)))
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.select(F.col("id").alias("a")).join(edges, "a").select(F.col("b").alias("id")).distinct()
        frontier = cut(reached.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def traverse(start: DataFrame, relationships: DataFrame, depth: int = 1) -> DataFrame:
    """As expand(), without the start."""
    return expand(start, relationships, depth).where("hop > 0")


# --- search -----------------------------------------------------------------------------------------------------


def by_name(entities: DataFrame, names: Sequence[str], *, fuzzy: bool = False) -> DataFrame:
    """Entities whose name equals (or, fuzzy, contains) one of the names, letter case aside."""
    low = F.lower(F.col("name"))
    if not names:
        return entities.where(F.lit(False))
    if fuzzy:
        test = F.lit(False)
        for n in names:
            test = test | F.contains(low, F.lit(n.lower()))
        return entities.where(test)
    return entities.where(low.isin(*(n.lower() for n in names)))


def chunks_of(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Distinct chunk_id that name one of the entities (id)."""
    return mentions.join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("chunk_id").distinct()


def mention_scores(hops: DataFrame, mentions: DataFrame, decay: float = 1.0) -> DataFrame:
    """chunk_id, score: 0.1 for each mention of a reached entity (id, hop), times decay to the power of its hop."""
    rows = mentions.join(hops.select(F.col("id").alias("entity_id"), "hop"), "entity_id")
    return rows.groupBy("chunk_id").agg(F.sum(F.lit(0.1) * F.pow(F.lit(float(decay)), F.col("hop"))).alias("score"))


def by_normalized_name(entities: DataFrame, names: Sequence[str], collections: Sequence[str] | None = None) -> DataFrame:
    """Entities whose normalized name is that of one of the names, in the collections (None: anywhere).

    The stored row keeps the spelling that came first, so "two year warranty" finds "Two_Year_Warranty". Names that
    normalize to nothing find nothing.
    """
    if not names:
        return entities.where(F.lit(False))
    wanted = F.filter(F.transform(F.array(*map(F.lit, names)), T.normalized_name), lambda n: n != "")
    return scoped(entities, collections=collections).where(F.array_contains(wanted, T.normalized_name(F.col("name"))))


def graph_search(entities: DataFrame, mentions: DataFrame, relationships: DataFrame, names: Sequence[str], *, depth: int = 0, decay: float = 0.5, collections: Sequence[str] | None = None, chunks: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """chunk_id, score of chunks near the named entities.

    collections limits the entities that are matched and entered; with chunks (id, source), source limits the mentions
    that count. hydrated() adds the chunks' columns.
    """
    allowed = None if collections is None else scoped(entities, collections=collections)
    if source is not None:
        if chunks is None:
            raise ValueError("a source needs the chunks that have it")
        mentions = mentions.join(scoped(chunks, source=source).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return mention_scores(expand(by_normalized_name(entities, names, collections), relationships, depth, allowed), mentions, decay)


def hydrated(found: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits (chunk_id, score) with the columns of their chunks (id, ...); hits whose chunk is gone go."""
    return found.join(chunks.withColumnRenamed("id", "chunk_id"), "chunk_id")


def matched_in_source(entities: DataFrame, mentions: DataFrame, chunks: DataFrame, source: str) -> DataFrame:
    """Entities that a chunk (id, source) of the source names."""
    own = mentions.join(scoped(chunks, source=source).select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi")
    return entities.join(own.select(F.col("entity_id").alias("id")), "id", "left_semi")


def fused_search(vector_hits: DataFrame, graph_hits: DataFrame, limit: int, k: int = 60, pool: int | None = None) -> DataFrame:
    """RRF of a vector list (id, score) and a graph list (chunk_id, score); pool cuts both lists first."""
    graph = graph_hits.select(F.col("chunk_id").alias("id"), "score")
    return top(fuse([ranked(vector_hits, 0, most=pool), ranked(graph, 1, most=pool)], k).withColumn("score", F.round("score", 12)), limit)


# --- communities ------------------------------------------------------------------------------------------------


def components(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """id, community: connected components, named by their smallest id; single entities too."""
    found = connected(relationships.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")), lambda df, name: cut(df))
    return entities.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("community"))


def label_propagation(edges: DataFrame, entities: DataFrame, rounds: int = 5) -> DataFrame:
    """id, community by weighted label propagation: each round, every entity takes the label of greatest weight among
    itself (weight 1) and its neighbours, ties to the smaller. Deterministic; rounds bound the work."""
    sym = cut(edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), "weight").union(edges.select("target_id", "source_id", "weight")).groupBy("a", "b").agg(F.sum("weight").alias("weight")))
    labels = cut(entities.select("id", F.col("id").alias("community")))
    for _ in range(rounds):
        votes = sym.join(labels.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "community", F.col("weight").cast("double"))
        every = votes.union(labels.select("id", "community", F.lit(1.0)))
        sums = every.groupBy("id", "community").agg(F.sum("weight").alias("w"))
        new = cut(sums.groupBy("id").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("community")))
        if new.join(labels, ["id", "community"], "left_anti").isEmpty():
            break
        labels = new
    return labels


def community_lists(membership: DataFrame, level: int = 0, min_size: int = 1) -> DataFrame:
    """community, level, entity_ids (sorted) of those with at least min_size members."""
    lists = membership.groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("entity_ids"))
    return lists.where(F.size("entity_ids") >= min_size).select("community", F.lit(level).alias("level"), "entity_ids")


def hierarchy(levels: Sequence[DataFrame]) -> list[DataFrame]:
    """Memberships from fine to coarse without those equal to the one before."""
    out: list[DataFrame] = []
    for m in levels:
        signature = m.groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("e")).select("e")
        if not out or not signature.exceptAll(out[-1][1]).isEmpty():
            out.append((m, signature))
    return [m for m, _ in out]


def top_summaries(communities: DataFrame, entity_ids: Sequence, limit: int = 5, levels: int | range | Sequence[int] | str | None = None) -> DataFrame:
    """Communities with a summary that overlap the entities, at the readable levels: most shared first, then the smaller, then by id."""
    wanted = F.array(*map(F.lit, entity_ids))
    told = communities.where(F.col("summary").isNotNull() & (F.col("summary") != "") & at_levels(levels))
    shared = told.where(F.arrays_overlap("entity_ids", wanted)).withColumn("overlap", F.size(F.array_intersect("entity_ids", wanted)))
    return shared.orderBy(F.desc("overlap"), F.size("entity_ids"), "id").limit(limit)


def at_levels(levels: int | range | Sequence[int] | str | None) -> Column:
    """Whether a community's level is readable; None and "all" take every level but null."""
    wanted = levels_of(levels)
    return F.col("level").isNotNull() if wanted is None else F.col("level").isin(*wanted)


def levels_of(value: int | range | Sequence[int] | None) -> list[int] | None:
    """Readable levels as a list; None or "all" for all."""
    if value is None or value == "all":
        return None
    levels = [value] if isinstance(value, int) else list(value)
    if any(not isinstance(x, int) or x < 0 for x in levels):
        raise ValueError("levels are integers from 0 on")
    return levels


def needs_summary(threshold: int = 10) -> Column:
    return F.coalesce(F.col("dirty"), F.lit(False)) | F.col("summary").isNull() | F.col("summary_fingerprint").isNull() | (F.coalesce(F.col("change_count"), F.lit(0)) >= threshold)


def fingerprints(communities: DataFrame, entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """id, fingerprint: sha256 over each community's sorted entities and inner relationships."""
    members = communities.select("id", F.explode("entity_ids").alias("entity_id"))
    named = members.join(entities.select(F.col("id").alias("entity_id"), F.concat_ws("|", "name", "type").alias("line")), "entity_id").select("id", F.concat(F.lit("e|"), "line").alias("line"))
    a, b = members.withColumnRenamed("entity_id", "source_id"), members.withColumnRenamed("entity_id", "target_id")
    inner = relationships.join(a, "source_id").join(b, ["id", "target_id"]).select("id", F.concat_ws("|", F.lit("r"), "source_id", "target_id", "type", "strength").alias("line"))
    return named.union(inner).groupBy("id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("fingerprint"))


def carried_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """New communities (level, entity_ids, fingerprint) with the summary of the old one of the same level and members;
    dirty where there was none or its content has changed."""
    key = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: x.cast("string"))), ",")
    o = old.select(F.col("level"), key(F.col("entity_ids")).alias("__key"), "summary", F.col("summary_fingerprint"))
    rows = new.withColumn("__key", key(F.col("entity_ids"))).join(o, ["level", "__key"], "left")
    return rows.withColumn("dirty", ~F.coalesce(F.col("summary_fingerprint") == F.col("fingerprint"), F.lit(False))).drop("__key")


def extractive_summaries(communities: DataFrame, entities: DataFrame, relationships: DataFrame, most: int = 50) -> DataFrame:
    """id, summary: the names of a community's best connected entities, a stand-in for a language model."""
    members = communities.select("id", F.explode("entity_ids").alias("entity_id"))
    degree = relationships.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).groupBy("entity_id").agg(F.count("*").alias("degree"))
    rows = members.join(degree, "entity_id", "left").join(entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
    listed = F.slice(F.array_sort(F.collect_list(F.struct((-F.coalesce("degree", F.lit(0))).alias("d"), "name"))), 1, most)
    return rows.groupBy("id").agg(F.array_join(F.transform(listed, lambda s: s["name"]), ", ").alias("summary"))


# --- maintenance ------------------------------------------------------------------------------------------------


def orphans(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    return entities.join(mentions.select(F.col("entity_id").alias("id")), "id", "left_anti")


def sweep(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the entities in gone (id): edges and mentions cascade, communities are stripped and marked dirty."""
    ids = cut(gone.select("id").distinct())  # every table below asks for them
    without = lambda df, col: df.join(ids.withColumnRenamed("id", col), col, "left_anti")
    out = dict(tables)
    out["entities"] = without(tables["entities"], "id")
    out["relationships"] = without(without(tables["relationships"], "source_id"), "target_id")
    out["mentions"] = without(tables["mentions"], "entity_id")
    if "communities" in tables:
        members = tables["communities"].select(F.col("id").alias("cid"), F.posexplode("entity_ids").alias("p", "id"))
        left = members.join(ids, "id", "left_anti").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("p", "id"))).alias("rest"))
        rows = tables["communities"].join(left, F.col("id") == F.col("cid"), "left")
        rest = F.coalesce(F.transform("rest", lambda s: s["id"]), F.slice("entity_ids", 1, 0))
        changed = F.size(rest) < F.size("entity_ids")
        out["communities"] = rows.withColumn("dirty", changed | F.coalesce(F.col("dirty"), F.lit(False))).withColumn("entity_ids", rest).select(*tables["communities"].columns)
    return out


def sweep_orphans(tables: dict[str, DataFrame], collection: str | None = None) -> dict[str, DataFrame]:
    """Without the collection's entities that nothing mentions: others' orphans stay. None: those without a collection."""
    return sweep(tables, orphans(tables["entities"].where(F.col("collection").eqNullSafe(F.lit(collection))), tables["mentions"]))


def delete_chunks(tables: dict[str, DataFrame], chunk_ids: DataFrame) -> dict[str, DataFrame]:
    """Without the chunks' mentions. Then every orphan of the collections that these touched goes, and of the entities
    without a collection those that the chunks named and nothing else does."""
    gone = chunk_ids.select("chunk_id").distinct()
    touched = tables["entities"].join(tables["mentions"].join(gone, "chunk_id", "left_semi").select(F.col("entity_id").alias("id")), "id", "left_semi").select("id", "collection")
    mentions = tables["mentions"].join(gone, "chunk_id", "left_anti")
    touched, unnamed = cut(touched), cut(orphans(tables["entities"].select("id", "collection"), mentions))
    swept = unnamed.join(touched.select("collection").distinct(), "collection", "left_semi").select("id")
    uncollected = unnamed.where(F.col("collection").isNull()).join(touched.where(F.col("collection").isNull()), "id", "left_semi").select("id")
    return sweep(tables | {"mentions": mentions}, swept.union(uncollected))


def delete_collection(tables: dict[str, DataFrame], collection: str) -> dict[str, DataFrame]:
    return sweep(tables, tables["entities"].where(F.col("collection") == collection))


def unprocessed(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Chunks that no mention names yet: a rebuild goes on with them."""
    return chunks.join(mentions.select(F.col("chunk_id").alias("id")), "id", "left_anti")


# --- listings ---------------------------------------------------------------------------------------------------


def entity_counts(entities: DataFrame, mentions: DataFrame, relationships: DataFrame) -> DataFrame:
    """Entities with numbers of mentions, outgoing and incoming relationships, counted before they are joined."""
    def counted(df: DataFrame, col: str, name: str) -> DataFrame:
        return df.groupBy(F.col(col).alias("id")).agg(F.count("*").alias(name))

    parts = [counted(mentions, "entity_id", "mention_count"), counted(relationships, "source_id", "out_degree"), counted(relationships, "target_id", "in_degree")]
    out = entities
    for p in parts:
        out = out.join(p, "id", "left")
    return out.fillna(0, ["mention_count", "out_degree", "in_degree"])


def strength_bucket(strength: Column) -> Column:
    return F.when(strength >= 7, "strong").when(strength >= 4, "medium").otherwise("weak")


def detailed(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Relationships with the names of both ends."""
    names = entities.select("id", "name")
    a, b = names.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), names.select(F.col("id").alias("target_id"), F.col("name").alias("target_name"))
    return relationships.join(a, "source_id").join(b, "target_id")


def type_histogram(rows: DataFrame, limit: int | None = None) -> DataFrame:
    out = rows.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")
    return out if limit is None else out.limit(limit)


def degrees_within(communities: DataFrame, relationships: DataFrame) -> DataFrame:
    """id (community), entity_id, degree: relationships inside the community, each end counted."""
    members = communities.select("id", F.explode("entity_ids").alias("entity_id"))
    a, b = members.withColumnRenamed("entity_id", "source_id"), members.withColumnRenamed("entity_id", "target_id")
    inner = relationships.join(a, "source_id").join(b, ["id", "target_id"])
    return inner.select("id", F.explode(F.array("source_id", "target_id")).alias("entity_id")).groupBy("id", "entity_id").agg(F.count("*").alias("degree"))


def mention_details(entity_ids: DataFrame, mentions: DataFrame, chunks: DataFrame, limit: int = 5) -> DataFrame:
    """entity_id, chunk_id, text: the first chunks that name each entity (id)."""
    rows = mentions.join(entity_ids.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").select("entity_id", "chunk_id").distinct()
    order = Window.partitionBy("entity_id").orderBy("chunk_id")
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).drop("n")
    return first.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id").select("entity_id", "chunk_id", "text")


def relationships_of(entity_ids: DataFrame, relationships: DataFrame) -> DataFrame:
    """Relationships with one of the entities (id) at either end, each once."""
    ids = entity_ids.select("id").distinct()
    out = relationships.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi")
    into = relationships.join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti")
    return out.unionByName(into)


def summaries_containing(communities: DataFrame, entity_id: object, levels: int | Sequence[int] | None = None) -> DataFrame:
    """Summaries of the communities that hold the entity, at the readable levels."""
    return communities.where(F.array_contains("entity_ids", F.lit(entity_id)) & F.col("summary").isNotNull() & at_levels(levels))

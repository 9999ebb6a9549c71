"""Registered queries: knowledge graph, maintenance and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import communities as C
from sextant.operators import graph as G
from sextant.operators import ingest as I
from sextant.operators import retrieval as R
from sextant.plans import storage, views
from sextant.plans.catalog import register
from sextant.streaming import ingest as stream

PLACE = "place AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)"
ENTITIES = f"{PLACE}, ents AS (SELECT 's' || s_suppkey AS id, s_name AS name, 'supplier' AS type, r_name AS collection FROM supplier JOIN place ON s_nationkey = n_nationkey UNION ALL SELECT 'p' || p_partkey, p_name, 'part', NULL FROM part UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation', r_name FROM place UNION ALL SELECT 'r' || r_regionkey, r_name, 'region', r_name FROM region)"
RELS = "rels AS (SELECT 's' || s_suppkey AS source_id, 'n' || s_nationkey AS target_id, 'LOCATED_IN' AS type, 10 AS strength FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF', 10 FROM nation UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey, 'SUPPLIES', least(10, count(*))::INTEGER FROM lineitem GROUP BY l_suppkey, l_partkey)"
MENTIONS = "ments AS (SELECT DISTINCT 'p' || l_partkey AS entity_id, l_orderkey AS chunk_id FROM lineitem)"
BASE = f"WITH RECURSIVE {ENTITIES}, {RELS}, {MENTIONS}"
ADJ = "adj AS (SELECT DISTINCT a, b FROM (SELECT source_id AS a, target_id AS b FROM rels UNION ALL SELECT target_id, source_id FROM rels) WHERE a <> b)"
KEY = r"trim(regexp_replace(regexp_replace(lower(name), '[_-]+', ' ', 'g'), '[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"
# The extractor's rules: a run of capitalized words between word boundaries, each once a text, numbered by first place.
RUN = r"'\b[A-Z][a-z]+(?:[ \t\n\r\f\v]+[A-Z][a-z]+)*\b'"
FOUND = f"runs AS (SELECT doc_id AS chunk_id, regexp_extract_all(text, {RUN}) AS every FROM documents), numbered AS (SELECT chunk_id, unnest(every) AS name, unnest(range(len(every))) AS n FROM runs), firsts AS (SELECT chunk_id, name, min(n) AS n FROM numbered GROUP BY ALL), found AS (SELECT chunk_id, name, row_number() OVER (PARTITION BY chunk_id ORDER BY n) - 1 AS place FROM firsts)"
COMMS = "comms AS (SELECT id, level, entity_ids, CASE WHEN len(entity_ids) % 3 <> 0 THEN 'summary of ' || id END AS summary, len(entity_ids) % 2 = 0 AS dirty, len(entity_ids) % 13 AS change_count, CASE WHEN len(entity_ids) % 5 <> 0 THEN 'f' END AS summary_fingerprint FROM (SELECT 'n' || s_nationkey AS id, 0 AS level, list_sort(list('s' || s_suppkey)) AS entity_ids FROM supplier GROUP BY s_nationkey UNION ALL SELECT 'R-' || collection, 1, list_sort(list(id)) FROM ents WHERE type = 'supplier' GROUP BY collection))"
ALL = f"{BASE}, {COMMS}"
START = ("n1", "n3")


def _walk(depth: int, start: str = "SELECT unnest(['n1', 'n3']) AS id", allowed: str = "") -> str:
    return f"walk AS (SELECT id, 0 AS hop FROM ({start}) UNION SELECT adj.b, hop + 1 FROM walk JOIN adj ON adj.a = walk.id {allowed} WHERE hop < {depth}), hops AS (SELECT id, min(hop) AS hop FROM walk GROUP BY id)"


def _start(spark, ids=START):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def _graph(spark, sf):
    return {"entities": views.entities(spark, sf), "relationships": views.relationships(spark, sf), "mentions": views.mentions(spark, sf)}


@register("entity_extract_regex", f"WITH {FOUND} SELECT chunk_id, name, CASE WHEN contains(name, ' ') THEN 'person' WHEN place = 0 THEN 'organization' ELSE 'concept' END AS type FROM found")
def entity_extract_regex(spark, sf):
    return G.extract(views.documents(spark, sf))


@register("entity_normalize_dedup", f"WITH {FOUND}, k AS (SELECT *, {KEY} AS name_key FROM found) SELECT name_key, min(chunk_id) AS chunk_id FROM k WHERE name_key <> '' GROUP BY name_key")
def entity_normalize_dedup(spark, sf):
    return G.distinct_entities(G.extract(views.documents(spark, sf)), ["chunk_id", "name"]).select("name_key", "chunk_id")


@register("mentions_unique", f"WITH {FOUND} SELECT DISTINCT {KEY} AS entity_id, chunk_id FROM found")
def mentions_unique(spark, sf):
    rows = G.extract(views.documents(spark, sf)).select(T.normalized_name(F.col("name")).alias("entity_id"), "chunk_id")
    return I.insert_or_ignore(rows.limit(0), rows, ["entity_id", "chunk_id"])


@register("cooccurrence_edges", f"{BASE} SELECT a.entity_id AS source_id, b.entity_id AS target_id, count(*) AS strength FROM ments a JOIN ments b ON a.chunk_id = b.chunk_id AND a.entity_id < b.entity_id GROUP BY ALL")
def cooccurrence_edges(spark, sf):
    return G.cooccurrences(views.mentions(spark, sf))


@register("entity_list_counts", f"{BASE} SELECT e.id, e.name, coalesce(m.c, 0) AS mention_count, coalesce(o.c, 0) AS out_degree, coalesce(i.c, 0) AS in_degree FROM ents e LEFT JOIN (SELECT entity_id AS id, count(*) AS c FROM ments GROUP BY 1) m USING (id) LEFT JOIN (SELECT source_id AS id, count(*) AS c FROM rels GROUP BY 1) o USING (id) LEFT JOIN (SELECT target_id AS id, count(*) AS c FROM rels GROUP BY 1) i USING (id)")
def entity_list_counts(spark, sf):
    g = _graph(spark, sf)
    return G.entity_counts(g["entities"], g["mentions"], g["relationships"]).select("id", "name", "mention_count", "out_degree", "in_degree")


@register("entity_filter_type_name", f"{BASE} SELECT id, name FROM ents WHERE type = 'part' AND name ILIKE '%ring%'")
def entity_filter_type_name(spark, sf):
    return views.entities(spark, sf).where((F.col("type") == "part") & F.ilike("name", F.lit("%ring%"))).select("id", "name")


@register("entities_by_name", f"{BASE} SELECT id FROM ents WHERE lower(name) IN ('france', 'asia', 'germany')")
def entities_by_name(spark, sf):
    return G.by_name(views.entities(spark, sf), ["France", "ASIA", "germany"]).select("id")


@register("entities_by_name_fuzzy", f"{BASE} SELECT id FROM ents WHERE lower(name) LIKE '%ia%'")
def entities_by_name_fuzzy(spark, sf):
    return G.by_name(views.entities(spark, sf), ["IA"], fuzzy=True).select("id")


@register("relationship_list_strength", f"{BASE} SELECT type, CASE WHEN strength >= 7 THEN 'strong' WHEN strength >= 4 THEN 'medium' ELSE 'weak' END AS bucket, count(*) AS n FROM rels GROUP BY ALL")
def relationship_list_strength(spark, sf):
    return views.relationships(spark, sf).groupBy("type", G.strength_bucket(F.col("strength")).alias("bucket")).agg(F.count("*").alias("n"))


@register("relationship_detail", f"{BASE} SELECT r.source_id, r.target_id, r.type, a.name AS source_name, b.name AS target_name, a.name ILIKE '%1%' OR b.name ILIKE '%1%' OR r.type ILIKE '%part%' AS matches FROM rels r JOIN ents a ON a.id = r.source_id JOIN ents b ON b.id = r.target_id")
def relationship_detail(spark, sf):
    like = lambda c, x: F.ilike(c, F.lit(x))
    matches = like("source_name", "%1%") | like("target_name", "%1%") | like("type", "%part%")
    return G.detailed(views.relationships(spark, sf), views.entities(spark, sf)).select("source_id", "target_id", "type", "source_name", "target_name", matches.alias("matches"))


@register("entity_type_histogram", f"{BASE} SELECT type, count(*) AS n FROM ents GROUP BY type")
def entity_type_histogram(spark, sf):
    return G.type_histogram(views.entities(spark, sf))


@register("relationship_type_histogram", f"{BASE} SELECT type, count(*) AS n FROM rels GROUP BY type ORDER BY n DESC, type LIMIT 100")
def relationship_type_histogram(spark, sf):
    return G.type_histogram(views.relationships(spark, sf), 100)


@register("weighted_edges", f"{BASE} SELECT source_id, target_id, strength AS weight FROM rels WHERE source_id IN (SELECT id FROM ents) AND target_id IN (SELECT id FROM ents)")
def weighted_edges(spark, sf):
    return G.weighted_edges(views.relationships(spark, sf), views.entities(spark, sf))


@register("bfs_1hop", f"{BASE}, {ADJ} SELECT DISTINCT b AS id FROM adj WHERE a IN ('n1', 'n3') AND b NOT IN ('n1', 'n3')")
def bfs_1hop(spark, sf):
    return G.traverse(_start(spark), views.relationships(spark, sf), 1).select("id")


@register("bfs_khop_min_hop", f"{BASE}, {ADJ}, {_walk(3)} SELECT id, hop FROM hops")
def bfs_khop_min_hop(spark, sf):
    return G.expand(_start(spark), views.relationships(spark, sf), 3)


@register("expand_scoped", f"{BASE}, {ADJ}, {_walk(3, allowed='JOIN ents ON ents.id = adj.b AND ents.collection = ' + chr(39) + 'ASIA' + chr(39), start='SELECT unnest([' + chr(39) + 'r2' + chr(39) + ']) AS id')} SELECT id, hop FROM hops")
def expand_scoped(spark, sf):
    allowed = views.entities(spark, sf).where("collection = 'ASIA'")
    return G.expand(_start(spark, ("r2",)), views.relationships(spark, sf), 3, allowed)


@register("expand_empty_scope", "SELECT 'r2' AS id, 0 AS hop")
def expand_empty_scope(spark, sf):
    return G.expand(_start(spark, ("r2",)), views.relationships(spark, sf), 3, views.entities(spark, sf).where("false"))


@register("related_including_start", f"{BASE}, {ADJ}, {_walk(2)} SELECT h.id, e.name FROM hops h JOIN ents e USING (id)")
def related_including_start(spark, sf):
    return G.expand(_start(spark), views.relationships(spark, sf), 2).join(views.entities(spark, sf), "id").select("id", "name")


@register("graph_search_chunks", f"{BASE}, {ADJ}, {_walk(1, start='SELECT id FROM ents WHERE lower(name) = ' + chr(39) + 'supplier#000000003' + chr(39))} SELECT DISTINCT chunk_id FROM ments JOIN hops ON hops.id = ments.entity_id")
def graph_search_chunks(spark, sf):
    g = _graph(spark, sf)
    return G.chunks_of(G.expand(G.by_normalized_name(g["entities"], ["supplier#000000003"]), g["relationships"], 1), g["mentions"])


@register("mention_score", f"{BASE} SELECT chunk_id, round(count(*) * 0.1::DOUBLE, 6) AS score FROM ments WHERE entity_id IN (SELECT id FROM ents WHERE name LIKE 'small%' AND type = 'part') GROUP BY chunk_id")
def mention_score(spark, sf):
    hops = views.entities(spark, sf).where("name LIKE 'small%' AND type = 'part'").select("id", F.lit(0).alias("hop"))
    return G.mention_scores(hops, views.mentions(spark, sf)).select("chunk_id", F.round("score", 6).alias("score"))


@register("mention_score_decayed", f"{BASE}, {ADJ}, {_walk(2, start='SELECT id FROM ents WHERE id = ' + chr(39) + 's3' + chr(39))} SELECT chunk_id, round(sum(0.1::DOUBLE * pow(0.5::DOUBLE, hop)), 6) AS score FROM ments JOIN hops ON hops.id = ments.entity_id GROUP BY chunk_id")
def mention_score_decayed(spark, sf):
    g = _graph(spark, sf)
    found = G.graph_search(g["entities"], g["mentions"], g["relationships"], ["Supplier#000000003"], depth=2, decay=0.5)
    return found.select("chunk_id", F.round("score", 6).alias("score"))


_GRAPH_LIST = f"{_walk(1, start='SELECT id FROM ents WHERE id = ' + chr(39) + 's3' + chr(39))}, gs AS (SELECT chunk_id AS id, round(sum(0.1::DOUBLE * pow(0.5::DOUBLE, hop)), 6) AS s FROM ments JOIN hops ON hops.id = ments.entity_id GROUP BY chunk_id), gl AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM gs)"


@register("graph_rrf_search", f"{BASE}, {ADJ}, {_GRAPH_LIST}, qv AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), vl AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT vec_id AS id, list_cosine_similarity(embedding::DOUBLE[], q) AS s FROM embeddings, qv ORDER BY s DESC, id LIMIT 20)) SELECT id, round(s, 9) AS score FROM (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS s FROM (SELECT * FROM vl UNION ALL SELECT * FROM gl) GROUP BY id) ORDER BY s DESC, id LIMIT 10")
def graph_rrf_search(spark, sf):
    g = _graph(spark, sf)
    near = R.vector_topk(views.vectors(spark, sf), views.vector(spark, sf), 20, threshold=-2.0)
    linked = G.graph_search(g["entities"], g["mentions"], g["relationships"], ["Supplier#000000003"], depth=1).withColumn("score", F.round("score", 6))
    return G.fused_search(near, linked, 10).select("id", F.round("score", 9).alias("score"))


@register("community_connected_components")
def community_connected_components(spark, sf):
    """Over all relationships and entities. Recursive SQL is too slow for them: a test compares with union-find."""
    return G.components(views.relationships(spark, sf), views.entities(spark, sf))


@register("community_hierarchy")
def community_hierarchy(spark, sf):
    """level, community, id of every entity, by modularity over the whole graph; tests hold fixtures against their optimum."""
    levels = C.detect_levels(views.entities(spark, sf), views.relationships(spark, sf), C.Detection("modularity", max_level=1, rounds=6))
    out = None
    for i, m in enumerate(levels):
        own = m.select(F.lit(i).alias("level"), "community", "id")
        out = own if out is None else out.unionByName(own)
    return out


@register("community_carry_over", f"{ALL}, n AS (SELECT level, entity_ids, CASE WHEN len(entity_ids) % 2 = 0 THEN 'f' ELSE 'g' END AS fingerprint FROM comms), o AS (SELECT * FROM comms WHERE len(entity_ids) % 3 <> 0) SELECT n.level, array_to_string(n.entity_ids, ',') AS members, o.summary, NOT coalesce(o.summary_fingerprint = n.fingerprint, false) AS dirty FROM n LEFT JOIN o ON o.level = n.level AND o.entity_ids = n.entity_ids")
def community_carry_over(spark, sf):
    """Newly detected communities take over the summaries of old ones with the same members."""
    old = views.region_communities(spark, sf)
    new = old.select("level", F.reverse("entity_ids").alias("entity_ids"), F.when(F.size("entity_ids") % 2 == 0, "f").otherwise("g").alias("fingerprint"))
    rows = G.carried_over(new, old.where(F.size("entity_ids") % 3 != 0))
    return rows.select("level", F.array_join(F.array_sort("entity_ids"), ",").alias("members"), "summary", "dirty")


@register("community_label_propagation")
def community_label_propagation(spark, sf):
    entities = views.entities(spark, sf)
    return G.label_propagation(G.weighted_edges(views.relationships(spark, sf), entities), entities)




@register("community_membership_lists", f"{ALL} SELECT id, array_to_string(entity_ids, ',') AS members, len(entity_ids) AS n FROM comms WHERE level = 0 AND len(entity_ids) >= 2")
def community_membership_lists(spark, sf):
    s = views.table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("community"))
    lists = G.community_lists(s, 0, 2)
    return lists.select(F.col("community").alias("id"), F.array_join("entity_ids", ",").alias("members"), F.size("entity_ids").cast("long").alias("n"))


@register("community_list", f"{ALL} SELECT id, level, len(entity_ids) AS entity_count FROM comms WHERE level = 1 AND summary ILIKE '%A%'")
def community_list(spark, sf):
    rows = views.region_communities(spark, sf).where(F.col("level").isin(*G.levels_of(1)) & F.ilike("summary", F.lit("%A%")))
    return rows.select("id", "level", F.size("entity_ids").cast("long").alias("entity_count"))


_SEEDS = [f"s{i}" for i in range(12)]
_SEED_SQL = "[" + ", ".join(f"'{s}'" for s in _SEEDS) + "]"


@register("community_summary_topk", f"{ALL} SELECT id, len(list_intersect(entity_ids, {_SEED_SQL})) AS overlap, len(entity_ids) AS size FROM comms WHERE list_has_any(entity_ids, {_SEED_SQL}) AND summary IS NOT NULL AND summary <> '' AND level IN (0, 1) ORDER BY overlap DESC, size, id LIMIT 5")
def community_summary_topk(spark, sf):
    return G.top_summaries(views.region_communities(spark, sf), _SEEDS, levels=[0, 1]).select("id", F.col("overlap").cast("long").alias("overlap"), F.size("entity_ids").cast("long").alias("size"))


@register("community_contains_entity", f"{ALL} SELECT id, level FROM comms WHERE list_contains(entity_ids, 's7')")
def community_contains_entity(spark, sf):
    return views.region_communities(spark, sf).where(F.array_contains("entity_ids", "s7")).select("id", "level")


@register("needs_regeneration", f"{ALL} SELECT id FROM comms WHERE dirty OR summary IS NULL OR summary_fingerprint IS NULL OR change_count >= 10")
def needs_regeneration(spark, sf):
    return views.region_communities(spark, sf).where(G.needs_summary()).select("id")


_GONE = "gone AS (SELECT id FROM ents WHERE type = 'supplier' AND substring(id, 2)::INTEGER % 4 = 0)"


def _gone(spark, sf):
    return views.entities(spark, sf).where("type = 'supplier' AND cast(substring(id, 2) AS int) % 4 = 0").select("id")


@register("community_overlap_dirty", f"{ALL}, {_GONE}, g AS (SELECT list(id) AS ids FROM gone) SELECT id, len(list_filter(entity_ids, lambda x: NOT list_contains(ids, x))) AS n, dirty OR list_has_any(entity_ids, ids) AS dirty FROM comms, g")
def community_overlap_dirty(spark, sf):
    tables = G.sweep(_graph(spark, sf) | {"communities": views.region_communities(spark, sf)}, _gone(spark, sf))
    return tables["communities"].select("id", F.size("entity_ids").cast("long").alias("n"), "dirty")


@register("orphan_entities", f"{BASE} SELECT id FROM ents WHERE id NOT IN (SELECT entity_id FROM ments)")
def orphan_entities(spark, sf):
    g = _graph(spark, sf)
    return G.orphans(g["entities"], g["mentions"]).select("id")


@register("sweep_result", f"{BASE}, {_GONE} SELECT 'entities' AS kind, count(*) AS n FROM ents WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'relationships', count(*) FROM rels WHERE source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)")
def sweep_result(spark, sf):
    left = G.sweep(_graph(spark, sf), _gone(spark, sf))
    one = lambda k: left[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return one("entities").union(one("relationships"))


# Suppliers are named by orders too: their collections are what a deletion sweeps.
_NAMED = "named AS (SELECT * FROM ments UNION ALL SELECT DISTINCT 's' || l_suppkey, l_orderkey FROM lineitem), dead AS (SELECT o_orderkey AS chunk_id FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT'), hit AS (SELECT DISTINCT entity_id AS id FROM named WHERE chunk_id IN (SELECT chunk_id FROM dead)), kept AS (SELECT DISTINCT entity_id AS id FROM named WHERE chunk_id NOT IN (SELECT chunk_id FROM dead)), swept AS (SELECT id FROM ents WHERE id NOT IN (SELECT id FROM kept) AND (collection IN (SELECT collection FROM ents WHERE id IN (SELECT id FROM hit) AND collection IS NOT NULL) OR collection IS NULL AND id IN (SELECT id FROM hit)))"


def _named(spark, sf):
    """The graph with mentions of parts and of suppliers, and the orders that go."""
    line = views.table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("entity_id"), F.col("l_orderkey").alias("chunk_id")).distinct()
    dead = views.table(spark, sf, "orders").where("o_orderstatus <> 'P' OR o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("chunk_id"))
    g = _graph(spark, sf)
    return g | {"mentions": g["mentions"].unionByName(line)}, dead


@register("delete_by_chunks_result", f"{BASE}, {_NAMED} SELECT id FROM ents WHERE id NOT IN (SELECT id FROM swept)")
def delete_by_chunks_result(spark, sf):
    return G.delete_chunks(*_named(spark, sf))["entities"].select("id")


@register("delete_by_chunks_edges", f"{BASE}, {_NAMED} SELECT source_id, target_id FROM rels WHERE source_id NOT IN (SELECT id FROM swept) AND target_id NOT IN (SELECT id FROM swept)")
def delete_by_chunks_edges(spark, sf):
    return G.delete_chunks(*_named(spark, sf))["relationships"].select("source_id", "target_id")


@register("sweep_orphans_of_collection", f"{BASE} SELECT id FROM ents WHERE NOT (coalesce(collection = 'ASIA', false) AND id NOT IN (SELECT entity_id FROM ments))")
def sweep_orphans_of_collection(spark, sf):
    return G.sweep_orphans(_graph(spark, sf), "ASIA")["entities"].select("id")


@register("entities_by_normalized_name", f"{BASE} SELECT id FROM ents WHERE {KEY} IN ('united states', 'middle east', 'france') AND collection IN ('AMERICA', 'MIDDLE EAST')")
def entities_by_normalized_name(spark, sf):
    return G.by_normalized_name(views.entities(spark, sf), ["United_States", " middle-east ", "FRANCE"], ["AMERICA", "MIDDLE EAST"]).select("id")


_SCOPED = "FROM ments JOIN hops ON hops.id = ments.entity_id JOIN orders ON o_orderkey = chunk_id WHERE o_orderpriority = '1-URGENT'"


@register("graph_search_scoped", f"{BASE}, {ADJ}, {_walk(1, start='SELECT id FROM ents WHERE id = ' + chr(39) + 's3' + chr(39))} SELECT chunk_id, any_value(o_orderstatus) AS status, round(sum(0.1::DOUBLE * pow(0.5::DOUBLE, hop)), 6) AS score {_SCOPED} GROUP BY chunk_id")
def graph_search_scoped(spark, sf):
    """Mentions from one source only, with the columns of the chunks that were found."""
    g = _graph(spark, sf)
    chunks = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("status"))
    found = G.graph_search(g["entities"], g["mentions"], g["relationships"], ["Supplier#000000003"], depth=1, chunks=chunks, source="1-URGENT")
    return G.hydrated(found, chunks).select("chunk_id", "status", F.round("score", 6).alias("score"))


@register("entities_of_source", f"{BASE} SELECT id FROM ents WHERE id IN (SELECT entity_id FROM ments JOIN orders ON o_orderkey = chunk_id WHERE o_orderpriority = '1-URGENT')")
def entities_of_source(spark, sf):
    chunks = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"))
    return G.matched_in_source(views.entities(spark, sf), views.mentions(spark, sf), chunks, "1-URGENT").select("id")


@register("delete_by_collection_result", f"{BASE} SELECT r.source_id, r.target_id FROM rels r WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.collection = 'ASIA' AND e.id IN (r.source_id, r.target_id))")
def delete_by_collection_result(spark, sf):
    return G.delete_collection(_graph(spark, sf), "ASIA")["relationships"].select("source_id", "target_id")


@register("already_processed_chunks", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def already_processed_chunks(spark, sf):
    return G.unprocessed(views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), views.mentions(spark, sf))


@register("summary_fingerprint", f"{ALL}, m AS (SELECT id, unnest(entity_ids) AS e FROM comms), l AS (SELECT m.id, 'e|' || x.name || '|' || x.type AS line FROM m JOIN ents x ON x.id = m.e) SELECT id, sha256(string_agg(line, chr(10) ORDER BY line)) AS fingerprint FROM l GROUP BY id")
def summary_fingerprint(spark, sf):
    g = _graph(spark, sf)
    return G.fingerprints(views.region_communities(spark, sf), g["entities"], g["relationships"])


@register("degree_centrality_topn", f"{BASE} SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM rels UNION ALL SELECT target_id FROM rels) GROUP BY id ORDER BY degree DESC, id LIMIT 50")
def degree_centrality_topn(spark, sf):
    ends = views.relationships(spark, sf).select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return R.top(ends.groupBy("id").agg(F.count("*").alias("degree")), 50, "degree")


@register("community_degrees", f"{BASE}, m AS (SELECT 'R-' || collection AS id, ents.id AS entity_id FROM ents WHERE type IN ('nation', 'region')), i AS (SELECT a.id, r.source_id, r.target_id FROM rels r JOIN m a ON a.entity_id = r.source_id JOIN m b ON b.entity_id = r.target_id AND b.id = a.id) SELECT id, entity_id, count(*) AS degree FROM (SELECT id, source_id AS entity_id FROM i UNION ALL SELECT id, target_id FROM i) GROUP BY ALL")
def community_degrees(spark, sf):
    e = views.entities(spark, sf).where("type IN ('nation', 'region')")
    comms = e.groupBy(F.concat(F.lit("R-"), "collection").alias("cid")).agg(F.collect_list("id").alias("entity_ids")).withColumnRenamed("cid", "id")
    return G.degrees_within(comms, views.relationships(spark, sf))


@register("relationship_context_order", f"{BASE}, {ADJ}, {_walk(1)} SELECT source_id, target_id, source_id IN ('n1', 'n3') OR target_id IN ('n1', 'n3') AS direct FROM rels WHERE source_id IN (SELECT id FROM hops) AND target_id IN (SELECT id FROM hops) ORDER BY direct DESC, source_id, target_id LIMIT 20")
def relationship_context_order(spark, sf):
    rels, near = views.relationships(spark, sf), G.expand(_start(spark), views.relationships(spark, sf), 1).select("id")
    inner = rels.join(near.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(near.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    direct = (F.col("source_id").isin(*START) | F.col("target_id").isin(*START)).alias("direct")
    return inner.select("source_id", "target_id", direct).orderBy(F.desc("direct"), "source_id", "target_id").limit(20)


@register("replace_latest_per_identity", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def replace_latest_per_identity(spark, sf):
    return I.latest_per_identity(views.table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id")


@register("upsert_oldest_variant", "SELECT p_name AS name_key, min(p_partkey) AS id FROM part GROUP BY p_name")
def upsert_oldest_variant(spark, sf):
    rows = views.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.normalized_name(F.col("p_name")).alias("name_key"))
    return R.first_of(rows, ["name_key"], ["id"]).select("name_key", "id")


@register("dedup_mentions", "SELECT l_partkey AS entity_id, l_orderkey AS chunk_id, min(l_linenumber) AS line FROM lineitem GROUP BY ALL")
def dedup_mentions(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity_id"), F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("line"))
    return R.first_of(rows, ["entity_id", "chunk_id"], ["line"])


@register("upsert_chunks", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def upsert_chunks(spark, sf):
    stored = views.vectors(spark, sf).select("id", "label")
    return I.upserted(stored, stored.where("id % 3 = 0").withColumn("label", F.lit(-1)), ["id"])


@register("delete_documents_cascade", "SELECT doc_id AS document_id FROM documents WHERE source <> 'src2' AND lang <> 'fr'")
def delete_documents_cascade(spark, sf):
    docs = views.documents(spark, sf).withColumnRenamed("id", "document_id")
    tables = I.deleted({"documents": docs, "chunks": docs.select("document_id")}, docs.where("source = 'src2'"))
    return I.cleared(tables, "fr")["chunks"]


@register("list_documents_page", "SELECT doc_id AS id FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 20 OFFSET 10")
def list_documents_page(spark, sf):
    return I.page_of(views.documents(spark, sf).where("collection = 'en'"), [F.desc("id")], 20, 10).select("id")


@register("count_documents_by_status", "SELECT lang AS collection, CASE WHEN n_chars = 0 THEN 'pending' ELSE 'completed' END AS status, count(*) AS n FROM documents GROUP BY ALL")
def count_documents_by_status(spark, sf):
    status = F.when(F.col("n_chars") == 0, "pending").otherwise("completed")
    return views.table(spark, sf, "documents").groupBy(F.col("lang").alias("collection"), status.alias("status")).agg(F.count("*").alias("n"))


@register("distinct_sources", "SELECT DISTINCT source FROM documents")
def distinct_sources(spark, sf):
    return views.documents(spark, sf).select("source").distinct()


@register("collection_counts", "SELECT c.name, count(d.doc_id) AS n_documents, count(DISTINCT d.source) AS n_sources FROM (VALUES ('en'), ('fr'), ('none')) c(name) LEFT JOIN documents d ON d.lang = c.name GROUP BY c.name")
def collection_counts(spark, sf):
    names = spark.createDataFrame([("en",), ("fr",), ("none",)], "name string")
    docs = views.documents(spark, sf).groupBy(F.col("collection").alias("name")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"))
    return names.join(docs, "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("n_documents"), F.coalesce("s", F.lit(0)).alias("n_sources"))


@register("duplicate_keys", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return I.duplicates(views.table(spark, sf, "part"), ["p_name"])


@register("orphaned_graph_counts", f"{BASE} SELECT type, count(*) AS n FROM ents WHERE collection IS NULL GROUP BY type")
def orphaned_graph_counts(spark, sf):
    return views.entities(spark, sf).where(F.col("collection").isNull()).groupBy("type").agg(F.count("*").alias("n"))


@register("allowed_collections", f"{BASE} SELECT collection, count(DISTINCT id) AS n FROM ents WHERE collection IN ('ASIA', 'EUROPE') GROUP BY collection")
def allowed_collections(spark, sf):
    return R.scoped(views.entities(spark, sf), collections=["ASIA", "EUROPE"]).groupBy("collection").agg(F.countDistinct("id").alias("n"))


@register("community_summaries")
def community_summaries(spark, sf):
    g = _graph(spark, sf)
    return G.extractive_summaries(views.region_communities(spark, sf), g["entities"], g["relationships"])


@register("stream_ingest_latest", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def stream_ingest_latest(spark, sf):
    """The newest event of each user, by a stream over the table's files that ends when it has read them all."""
    folder = storage.work_dir(spark, "stream")
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    rows = stream.source(spark, f"{sf}/events.parquet*", schema).select("user_id", "ts", "event_id")
    query = stream.table_of(stream.latest(rows, "user_id", "ts"), f"{folder}/state", f"{folder}/checkpoint")
    query.awaitTermination()
    return stream.newest(spark, f"{folder}/state").select("user_id", "event_id")

"""Communities, builds, stores, judges and evaluation runs on small fixtures."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators import building, evaluation, grounding, ingest, judging, steps
from sextant.operators import communities as C
from sextant.operators import graph as G
from sextant.operators import retrieval as R
from sextant.plans import storage
from sextant.sources import files
from sextant.sources.evaluation_store import EvaluationStore
from sextant.sources.graph_store import ParquetGraph
from sextant.streaming import ingest as stream

EDGE = "source_id string, target_id string, strength int"


def network(spark, edges, extra=""):
    names = sorted({x for a, b, _ in edges for x in (a, b)} | set(extra))
    return spark.createDataFrame([(x, "one") for x in names], "id string, collection string"), spark.createDataFrame(edges, EDGE)


def groups(membership):
    out = {}
    for r in membership.collect():
        out.setdefault(r["community"], set()).add(r["id"])
    return sorted(map(sorted, out.values()))


TRIANGLES = [("a", "b", 10), ("b", "c", 10), ("a", "c", 10), ("d", "e", 10), ("e", "f", 10), ("d", "f", 10), ("c", "d", 1)]


@pytest.mark.parametrize("objective", ["cpm", "modularity"])
def test_two_triangles_and_a_bridge(spark, objective):
    entities, rels = network(spark, TRIANGLES, "z")
    how = C.Detection(objective, max_level=0, rounds=8)
    labels = C.detect_levels(entities, rels, how)[0]
    assert groups(labels) == [["a", "b", "c"], ["d", "e", "f"], ["z"]]
    # No other membership of the six is better.
    best = C.quality(labels, entities, rels, how)
    for cut_at in itertools.combinations("abcdef", 3):
        other = spark.createDataFrame([(x, "x" if x in cut_at else "y") for x in "abcdef"] + [("z", "z")], "id string, community string")
        if sorted(cut_at) in (["a", "b", "c"], ["d", "e", "f"]):
            continue
        assert C.quality(other, entities, rels, how) <= best
        break


def test_levels_and_resolution(spark):
    entities, rels = network(spark, TRIANGLES)
    assert len(groups(C.detect_levels(entities, rels, C.Detection("modularity", resolution=8.0, max_level=0, rounds=4))[0])) > 2
    found = C.detect(entities, rels, C.Detection(resolution=0.01, max_level=1, rounds=4)).collect()
    levels = {}
    for r in found:
        levels.setdefault(r["level"], set()).add(tuple(r["entity_ids"]))
    assert max(levels) <= 1 and all(levels[i] != levels[i + 1] for i in range(len(levels) - 1)) and ("a", "b", "c", "d", "e", "f") in levels[max(levels)]
    assert C.detect(entities, rels.limit(0), C.Detection(min_size=2, rounds=1)).count() == 0
    for wrong in ({"objective": "x"}, {"resolution": 0}, {"max_level": -1}):
        with pytest.raises(ValueError):
            C.Detection(**wrong)


def names_in(text):
    if "broken" in text:
        raise RuntimeError("no extractor")
    return [{"name": w, "type": "thing"} for w in text.split() if w[0].isupper()]


def pairs_in(text, found):
    if "unlinked" in text:
        raise RuntimeError("no relations")
    return [{"source": found[0]["name"], "target": x["name"], "type": "near to", "strength": 40} for x in found[1:]] + [{"source": "Nobody", "target": "Else"}]


def test_build_tolerates_extractors_and_resumes(spark, tmp_path):
    store = ParquetGraph(spark, f"file://{tmp_path}/graph")
    chunks = spark.createDataFrame([(1, "Alice met Bob"), (2, "broken"), (3, "unlinked Carol alice ALICE Dave"), (4, None)], "id long, text string")
    assert building.build(store, "one", chunks, names_in, pairs_in) == {"chunks": 4, "failed": 2}
    t = store.tables()
    assert {r["name"] for r in t["entities"].collect()} == {"Alice", "Bob", "Carol", "Dave"}
    assert t["mentions"].count() == 5  # Alice in two chunks
    edge = t["relationships"].collect()
    assert [(r["type"], r["strength"]) for r in edge] == [("NEAR_TO", 10)]
    assert building.build(store, "one", chunks, names_in, pairs_in)["chunks"] == 2  # what no mention names is tried again
    assert store.tables()["entities"].count() == 4 and store.tables()["mentions"].count() == 5
    building.build(store, "two", chunks.limit(1), names_in, resume=False)
    assert store.find_entities("two").count() == 2 and store.tables()["entities"].count() == 6
    # single rows, listings, searches
    alice = store.find_entities("one").where("name = 'Alice'").first()["id"]
    assert store.entity(alice)["name"] == "Alice" and store.entity("none") is None
    assert store.relationships(alice).first()["target_name"] == "Bob" and store.relationship(edge[0]["id"])["strength"] == 10
    assert store.mentions(alice, chunks).count() == 2
    assert [r["name"] for r in store.list_entities(collection="one", name="a", limit=2, offset=1).collect()] == ["Carol", "Dave"]
    assert store.list_relationships(bucket="strong", collection="one").count() == 1 and store.list_relationships(bucket="weak").count() == 0
    assert {r["chunk_id"] for r in store.search(["BOB"], collections=["one"]).collect()} == {1} and store.search(["bob"], collections=["none"]).count() == 0
    # communities
    store.persist_communities("one", spark.createDataFrame([(0, [alice], "about Alice", False), (1, [alice], None, True)], "level int, entity_ids array<string>, summary string, dirty boolean"))
    assert store.community_summaries("one", 0, alice).count() == 1 and store.list_communities(summary="ALICE").count() == 1
    key = store.list_communities(levels=0).first()["id"]
    assert store.community(key)["summary"] == "about Alice"
    assert store.info() == {"entities": 6, "mentions": 7, "relationships": 1, "communities": 2, "orphaned_entities": 0, "dirty_communities": 1}
    store.persist_communities("one", spark.createDataFrame([(0, [alice], "new", False)], "level int, entity_ids array<string>, summary string, dirty boolean"))
    assert store.info()["communities"] == 1
    store.delete_by_collection("one")
    assert store.info()["entities"] == 2 and store.info()["communities"] == 0


def test_entity_search_by_vector(spark, tmp_path):
    store = ParquetGraph(spark, f"file://{tmp_path}/graph")
    store.persist_entities("one", spark.createDataFrame([("A", [1.0, 0.0]), ("B", [0.0, 1.0]), ("C", None)], "name string, embedding array<float>"))
    assert [r["name"] for r in store.search_by_embedding([1.0, 0.1]).collect()] == ["A"]


def test_judges(spark):
    assert judging.judged(lambda p: 'well {"score": 14, "reasoning": "x"}', "?") == (10.0, "x")
    assert judging.judged(lambda p: "none", "?") == (None, None) and judging.judged(lambda p: 1 / 0, "?") == (None, None) and judging.judged(lambda p: '{"score": true}', "?") == (None, None)
    rows = [{"text": "a"}, {"text": "b"}, {"text": "c"}]
    assert [r["text"] for r in judging.rated("q", rows, lambda p: '{"1": 7, "3": 9}')] == ["c", "a"]
    assert judging.rated("q", rows, lambda p: "can't say") == rows and judging.rated("q", rows, lambda p: 1 / 0) == rows and judging.rated("q", [], lambda p: 1 / 0) == []
    answers = spark.createDataFrame([(1, "q", ["p"], "a", "r"), (2, "q", [], "a", None)], "case_id long, question string, passages array<string>, answer string, reference string")
    got = {r["case_id"]: (r["faithfulness"], r["correctness"]) for r in judging.judge_answers(answers, lambda p: '{"score": 3}' if "reference:" in p else '{"score": 8}').collect()}
    assert got == {1: (8.0, 3.0), 2: (8.0, None)}
    means = evaluation.answer_means(spark.createDataFrame(list(got.values()), "faithfulness double, correctness double")).first()
    assert tuple(means) == (8.0, 3.0)


def test_reranking_falls_back(spark):
    fetched = spark.createDataFrame([(i, float(i)) for i in range(9)], "id long, score double")
    failures = []
    broken = lambda df: df.withColumn("x", F.raise_error(F.lit("no model")))
    assert [r["id"] for r in judging.reranked_or_first(fetched, broken, 3, failures.append).collect()] == [8, 7, 6] and len(failures) == 1
    assert [r["id"] for r in judging.reranked_or_first(fetched, lambda df: df.orderBy("id"), 2).collect()] == [0, 1]
    assert judging.reranked_or_first(fetched, None, 4).count() == 4


def share(pairs):
    assert len(pairs) <= 8
    return [len(set(p.split()) & set(h.split())) / len(h.split()) for p, h in pairs]


def test_grounding_in_batches(spark):
    sentences = spark.createDataFrame([(i, 1, "a b") for i in range(20)] + [(99, 1, "x y")], "sentence_id long, answer_id long, text string")
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b c"), (1, 2, "y" * 6000)], "answer_id long, position int, text string")
    got = {r["sentence_id"]: (r["score"], r["verdict"]) for r in judging.grounded(sentences.coalesce(1), chunks, share).collect()}
    assert got == {i: (1.0, "faithful") for i in range(20)} | {99: (0.0, "hallucinated")}
    assert grounding.premise(chunks.drop("answer_id"), budget=10).first()[0] == "a\nb c"


def test_evaluation_store(spark, tmp_path):
    store = EvaluationStore(spark, f"file://{tmp_path}/eval")
    first = store.create("where?", [1, 2])
    second = store.create("who?", [9], mode="hard")
    assert store.get(first)["relevant"] == [1, 2] and store.update(first, question="when?", relevant=[1]) and store.get(first)["question"] == "when?"
    assert not store.update("none", question="x") and not store.delete("none")
    with pytest.raises(ValueError):
        store.create(" ", [])
    found = lambda cases: cases.select("case_id", F.lit(1).cast("long").alias("id"), F.lit(1).alias("rank"))
    run = store.run(found, {"collections": ["en"]})
    assert run["status"] == "completed" and run["n_cases"] == 2 and run["metrics"]["recall_at_5"] == 0.5
    assert store.run(lambda cases: cases.select("nothing"))["status"] == "failed"
    assert store.runs().count() == 2 and [r["id"] for r in store.runs(["en", "fr"]).collect()] == [run["id"]] and store.runs(["fr"]).count() == 0
    assert json.loads(store.runs(["en"]).first()["metrics"])["mrr"] == 0.5
    assert store.delete(second) and store.cases().count() == 1
    store.add(spark.createDataFrame([("k", "q")], "case_id string, question string"))
    assert store.get("k")["source"] is None and store.cases().count() == 2


def test_evaluate_in_one_plan(spark):
    cases = spark.createDataFrame([(1, "a"), (2, "b")], "case_id long, question string")
    hits = spark.createDataFrame([(1, 5, 0.5), (1, 6, 0.9)], "case_id long, id long, score double")
    got = {(r["case_id"], r["id"], r["rank"]) for r in steps.evaluate(cases, lambda c: c.join(hits, "case_id").select("case_id", "id", "score")).collect()}
    assert got == {(1, 6, 1), (1, 5, 2)}
    assert steps.evaluate(cases, lambda c: 1 / 0).count() == 0


def test_names_that_resolve(spark):
    entities = spark.createDataFrame([(1, "foo bar"), (2, "baz")], "id long, name_key string")
    rows = spark.createDataFrame([("Foo_Bar",), ("unknown",)], "source string")
    assert [r["source_id"] for r in G.resolve(rows, entities, "source", "source_id").collect()] == [1]
    build = lambda rows: {"entities": spark.createDataFrame(rows, "id long, name_key string"), "relationships": spark.createDataFrame([(1, 2)], "a int, b int"), "mentions": spark.createDataFrame([(1, 2)], "a int, b int")}
    both = G.merged(build([(1, "x"), (2, "y")]), build([(3, "x"), (4, "z")]))
    assert {r["id"] for r in both["entities"].collect()} == {1, 2, 4} and both["mentions"].count() == 2
    assert [r["id"] for r in G.by_normalized_name(spark.createDataFrame([(1, "Two_Year-Warranty")], "id long, name string"), ["two year warranty"]).collect()] == [1]


def test_text_helpers(spark):
    row = spark.createDataFrame([("B-PER", "name", "about", None, {"a": "1", "b": "2"}, {"b": "3", "c": "4"})], "tag string, n string, d string, no string, declared map<string,string>, extra map<string,string>")
    got = row.select(T.label_type(F.col("tag")), T.entity_text(F.col("n"), F.col("d")), T.entity_text(F.col("n"), F.col("no")), T.prefixed(F.col("n"), "query"), T.merged_metadata(F.col("declared"), F.col("extra")), T.first_json_object(F.lit('x {"a": 1} y')), T.content_type(F.lit("a/b.MD"))).first()
    assert tuple(got) == ("person", "name: about", "name", "query: name", {"a": "1", "b": "2", "c": "4"}, '{"a": 1}', "text/markdown")


def test_embedding_failures(spark):
    chunks = spark.createDataFrame([(1, "a"), (2, "bad")], "id long, text string")
    embed = lambda t: F.when(t != "bad", F.array(F.lit(1.0)))
    kept, skipped = ingest.embedded(chunks, embed, on_error="skip")
    assert [r["id"] for r in kept.collect()] == [1] and [r["id"] for r in skipped.collect()] == [2]
    with pytest.raises(Exception, match="no embedding"):
        ingest.embedded(chunks, embed)[0].collect()
    rows = spark.createDataFrame([(1, [0.0]), (2, [5.0])], "id long, embedding array<double>")
    assert {r["id"]: r["embedding"] for r in ingest.upsert_vectors(rows, rows.where("id = 1").withColumn("embedding", F.array(F.lit(9.0)))).collect()} == {1: [9.0], 2: [5.0]}
    docs = spark.createDataFrame([(0, "completed"), (3, "pending"), (3, "completed")], "chunk_count int, status string")
    assert docs.where(ingest.to_rechunk()).count() == 2


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\ftwo\f")
    rows = files.text_files(spark, f"file://{tmp_path}/a.md").collect()
    assert [(r["content_type"], r["text"]) for r in rows] == [("text/markdown", "one\ftwo\f")]
    got = files.pages(spark.createDataFrame([(1, "one\ftwo\f")], "id long, raw string")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 0, 3), (1, 2, 4, 7)]


def test_steps_that_search_again(spark):
    hits = lambda q, c: spark.createDataFrame([(hash(q) % 100, q, 1.0)], "id long, text string, score double")
    said = iter(['{"query": "more"}', '{"query": "more"}'])
    ctx = steps.reason(steps.retrieve(steps.Context("first"), hits), lambda p: next(said), hits)
    assert ctx.error is None and [q for q, *_ in ctx.results] == ["first", "more"] and ctx.chunks.count() == 2
    ctx = steps.rerank(ctx, lambda q, df: df.limit(1))
    answers = iter(["bad", '{"feedback": "shorter"}', "good", '{"grounded": true}'])
    ctx = steps.answer(ctx, lambda p: next(answers), corrections=2)
    assert ctx.answer == "good" and ctx.corrections == 1
    assert steps.ground(ctx, lambda a, df: df).grounding.count() == 1
    assert steps.expand(steps.Context("q"), lambda p: " wide ").expanded == "wide"
    assert steps.ask("q", hits, lambda p: p[-1] if "facts" in p else "", graph_context="facts") == "q"


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 30), (2, "y")], "id long, text string").write.parquet(f"file://{tmp_path}/in")
    rows = stream.source(spark, f"file://{tmp_path}/in", spark.read.parquet(f"file://{tmp_path}/in").schema)
    stream.chunks_to(rows, lambda df, n: df.write.mode("overwrite").parquet(f"file://{tmp_path}/out/{n}"), f"file://{tmp_path}/ck", size=20, overlap=0).awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out/*").count() == 3
    spark.sql("SELECT timestamp'2024-01-01 00:00:01' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:00:09', 'a' UNION ALL SELECT timestamp'2024-01-01 00:00:11', 'a'").write.parquet(f"file://{tmp_path}/ev")
    events = stream.source(spark, f"file://{tmp_path}/ev", spark.read.parquet(f"file://{tmp_path}/ev").schema)
    query = stream.counts_by_window(events, "ts", "10 seconds", "1 minute", "k").writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/ck2").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [1, 2]


def test_cut_keeps_rows_and_types(spark):
    df = spark.createDataFrame([(1, [1.5], None)], "a int, b array<double>, c string")
    again = storage.cut(df)
    assert again.schema == df.schema and again.collect() == df.collect() and storage.cut(df.limit(0)).count() == 0
    assert R.numbered(df, ["a"], "n").first()["n"] == 1


def test_runs_compare(spark):
    cases = spark.createDataFrame([(1,)], "case_id long")
    hits = spark.createDataFrame([(1, 7, 1)], "case_id long, id long, rank int")
    metrics = evaluation.case_metrics(cases, hits, hits.select("case_id", "id"))
    assert {(r["run"], r["mrr"]) for r in evaluation.compare({"a": metrics, "b": metrics}).collect()} == {("a", 1.0), ("b", 1.0)}

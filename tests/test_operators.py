"""Small fixtures for semantics that the tables don't show."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.functions import vector as V
from sextant.operators import communities as C
from sextant.operators import evaluation as E
from sextant.operators import graph as G
from sextant.operators import grounding, ingest, steps
from sextant.operators import retrieval as R
from sextant.plans import catalog, plugins, views
from sextant.sources import files, store


SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(column).first()[0]


def test_metrics(spark):
    cases = spark.createDataFrame([(1,), (2,), (3,)], "case_id long")
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)], "case_id long, id long, rank int")
    judged = spark.createDataFrame([(1, 11), (1, 99), (2, 21)], "case_id long, id long")
    rows = {r["case_id"]: r for r in E.case_metrics(cases, results, judged).collect()}
    assert rows[1]["recall_at_1"] == 0 and rows[1]["recall_at_3"] == 0.5 and rows[1]["precision_at_5"] == pytest.approx(0.2)
    assert rows[1]["reciprocal_rank"] == 0.5 and rows[1]["hit_at_3"] == 1 and rows[2]["reciprocal_rank"] == 0 and rows[3]["recall_at_10"] == 0
    empty = E.run_metrics(E.case_metrics(cases.limit(0), results, judged)).first()
    assert empty["n_cases"] == 0 and empty["mrr"] == 0
    assert E.passes({"recall_at_5": 0.5}, 0.5) and not E.passes({"recall_at_5": 0.4}, 0.5)


def test_names(spark):
    rows = [("Foo_Bar",), ("foo--bar",), (" FOO   bar ",), (None,), ("__",)]
    got = [r[0] for r in spark.createDataFrame(rows, "n string").select(T.normalized_name(F.col("n"))).collect()]
    assert got == ["foo bar", "foo bar", "foo bar", None, ""]


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0], [1.0, 2.0], 0.0), ([0.0], [1.0], 0.0), (None, [1.0], None)]
    for a, b, want in rows:
        got = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b"))).first()[0]
        assert got == want
    vector = spark.createDataFrame([(["a", "b"],)], "w array<string>").select(V.hash_embedding(F.col("w"), 32)).first()[0]
    assert sum(x * x for x in vector) == pytest.approx(1.0)


def test_fusion_absent_items_get_nothing(spark):
    a = spark.createDataFrame([(1, 0, 1), (2, 0, 2)], "id long, list_id int, rank int")
    b = spark.createDataFrame([(2, 1, 1), (2, 1, 4)], "id long, list_id int, rank int")
    got = {r["id"]: r["score"] for r in R.fuse([a, b]).collect()}
    assert got == {1: pytest.approx(1 / 61), 2: pytest.approx(1 / 62 + 1 / 61)}


def test_hybrid_floor(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], ["cat"]), (2, [1.0, 0.0], ["dog"])], "id long, embedding array<double>, tokens array<string>")
    terms = F.array(F.lit("cat"))
    best = R.hybrid_topk(rows, [1.0, 0.0], terms, floor=0.0).collect()
    assert best[0]["id"] == 1 and best[0]["score"] == pytest.approx(1.0) and best[1]["score"] == pytest.approx(0.5)
    assert R.hybrid_topk(rows, [1.0, 0.0], terms, floor=1.0).first()["keyword_score"] < 1
    assert R.hybrid_topk(rows, [1.0, 0.0], F.array(F.lit("cow")), floor=0.0).first()["keyword_score"] == 0
    with pytest.raises(ValueError):
        R.hybrid_scores(rows, [1.0, 0.0], terms, floor=2)


GRAPH_EDGES = [("a", "b", "KNOWS", 3), ("b", "c", "KNOWS", 9), ("d", "e", "KNOWS", 1)]


@pytest.fixture()
def graph(spark):
    return {
        "entities": spark.createDataFrame([(x, x.upper(), "person", "one") for x in "abcdef"], "id string, name string, type string, collection string"),
        "relationships": spark.createDataFrame(GRAPH_EDGES, "source_id string, target_id string, type string, strength int"),
        "mentions": spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3)], "entity_id string, chunk_id long"),
        "communities": spark.createDataFrame([("x", 0, ["a", "b", "f"], False), ("y", 1, ["f"], False)], "id string, level int, entity_ids array<string>, dirty boolean"),
    }


def test_expand(spark, graph):
    start = spark.createDataFrame([("a",)], "id string")
    assert {(r["id"], r["hop"]) for r in G.expand(start, graph["relationships"], 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r["id"] for r in G.traverse(start, graph["relationships"], 1).collect()} == {"b"}
    assert {r["id"] for r in G.expand(start, graph["relationships"], 0).collect()} == {"a"}


def test_components_and_labels(graph):
    got = {r["id"]: r["community"] for r in G.components(graph["relationships"], graph["entities"]).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "f": "f"}
    labels = G.label_propagation(G.weighted_edges(graph["relationships"], graph["entities"]), graph["entities"])
    assert {r["id"] for r in labels.collect()} == set("abcdef")


def test_components_of_the_whole_graph(spark):
    rels, entities = views.relationships(spark, SF), views.entities(spark, SF)
    up = {r["id"]: r["id"] for r in entities.collect()}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in rels.collect():
        a, b = sorted((root(r["source_id"]), root(r["target_id"])))
        up[b] = a
    got = {r["id"]: r["community"] for r in catalog.queries()["community_connected_components"](spark, SF).collect()}
    assert got == {x: root(x) for x in up}
    assert catalog.queries()["relationship_detail"](spark, SF).count() == rels.count()


def test_cooccurrences_of_large_chunks(spark):
    rows = [(f"e{i:03}", c) for c, n in ((1, 150), (2, 70), (3, 64), (4, 1)) for i in range(n)]
    got = G.cooccurrences(spark.createDataFrame(rows, "entity_id string, chunk_id long")).collect()
    want = {(f"e{a:03}", f"e{b:03}"): 1 + (b < 70) + (b < 64) for b in range(150) for a in range(b)}
    assert len(got) == len(want) and {(r["source_id"], r["target_id"]): r["strength"] for r in got} == want


def test_searches_over_all_vectors(spark):
    all_ids = {r["id"] for r in views.vectors(spark, SF).collect()}
    q = views.questions(spark, SF).select("query_id", "query")
    rows = lambda df: {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 9)) for r in df.collect()}
    pairs = views.vectors(spark, SF).join(q, F.col("id") != F.col("query_id")).select("query_id", "id", V.cosine(F.col("embedding"), F.col("query")).alias("score"))
    want = rows(R.top_per(pairs, 3))
    assert rows(R.vector_batch(views.vectors(spark, SF), q, 3, threshold=None, exclude_self=True, block=100)) == want
    near = {r["query_id"]: r["id"] for r in catalog.queries()["knn_self_join"](spark, SF).collect()}
    assert near == {i: want[i, 1][0] for i in all_ids}
    assert catalog.queries()["eval_mrr_hit"](spark, SF).first()["n_cases"] == len(all_ids)


def test_search_keeps_ties_and_odd_vectors(spark):
    rng = random.Random(3)
    vectors = [[rng.choice((-1.0, 0.0, 1.0, 2.0)) for _ in range(3)] for _ in range(1500)]
    vectors += [[0.0] * 3, None, [1.0, 2.0], [1e200] * 3, [1e-200, 0.0, 1e-200], [1e-155, 2e-155, 0.0], [0.1, 0.1, 0.1], [0.3, 0.3, 0.3]]
    rows = [(7 * i % len(vectors), v) for i, v in enumerate(vectors)]
    table = spark.createDataFrame([*rows, (3, [1.0, 1.0, 2.0])], "id long, embedding array<double>")
    asked = table.where("id % 40 < 2 or id > 1480").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")).dropDuplicates(["query_id"])
    pairs = table.join(asked, F.col("id") != F.col("query_id")).select("query_id", "id", V.cosine(F.col("embedding"), F.col("query")).alias("score")).where("score is not null")
    ranks = lambda df: {(r["query_id"], r["rank"]): (r["id"], str(r["score"])) for r in df.collect()}
    for threshold, block in ((None, 8192), (0.9, 400)):
        want = ranks(R.top_per(pairs if threshold is None else pairs.where(F.col("score") > threshold), 12))
        assert ranks(R.vector_batch(table, asked, 12, threshold=threshold, exclude_self=True, block=block)) == want


def rows_made(plan) -> int:
    """The most rows that a node of a plan that has run has made."""
    for inner in ("executedPlan", "plan"):
        if any(x in plan.getClass().getSimpleName() for x in ("AdaptiveSparkPlan", "QueryStage")) and inner in {m.getName() for m in plan.getClass().getMethods()}:
            return rows_made(getattr(plan, inner)())
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *(rows_made(plan.children().apply(i)) for i in range(plan.children().size()))])


@pytest.mark.parametrize("name", ["eval_recall_precision", "eval_mrr_hit"])
def test_evaluation_makes_no_relevance_pairs(spark, name):
    found = catalog.queries()[name](spark, SF)
    found.collect()
    assert 0 < rows_made(found._jdf.queryExecution().executedPlan()) <= 20 * views.vectors(spark, SF).count()


def test_metrics_by_label(spark):
    items = [(1, 5), (2, 5), (3, 5), (4, 6), (5, None), (None, 5), (6, 7)]
    table = spark.createDataFrame(items, "id long, label int")
    cases = spark.createDataFrame([*items, (9, 5), (10, 8)], "case_id long, label int")
    results = spark.createDataFrame([(1, 4, 1), (1, 3, 2), (1, 1, 3), (1, 2, 4), (4, 1, 1), (9, 1, 1), (9, 1, 2), (9, 77, 3), (5, 5, 1), (10, 1, 1)], "case_id long, id long, rank int")
    judged = cases.join(table, "label").where("id != case_id").select("case_id", "id")
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(E.label_metrics(cases, results, table)) == rows(E.case_metrics(cases, results, judged))


def test_sweep(graph):
    left = G.sweep_orphans(graph, "one")
    assert G.sweep_orphans(graph, "two")["entities"].count() == 6
    assert {r["id"] for r in left["entities"].collect()} == set("abc")
    assert left["relationships"].count() == 2
    assert {(r["id"], tuple(r["entity_ids"]), r["dirty"]) for r in left["communities"].collect()} == {("x", ("a", "b"), True), ("y", (), True)}
    assert {r["id"] for r in G.delete_chunks(graph, graph["mentions"].where("chunk_id = 3").select("chunk_id"))["entities"].collect()} == set("ab")


def test_levels():
    assert G.levels_of("all") is None and G.levels_of(range(2)) == [0, 1] and G.levels_of(1) == [1]
    with pytest.raises(ValueError):
        G.levels_of([-1])


def test_relationships_are_validated(spark):
    raw = spark.createDataFrame([("a", "a", "x", 1), ("a", "b", "works at!", 99), ("b", "c", "x", None)], "source_id string, target_id string, type string, strength int")
    assert {(r["type"], r["strength"]) for r in G.valid_relationships(raw).collect()} == {("WORKS_AT", 10), ("X", 5)}


def test_chunks_slice_their_text():
    text = "Erste Zeile.\n\nZweiter Absatz mit mehr Wörtern 漢字 " * 30
    how = ingest.Chunking(chunk_size=20, chunk_overlap=5, max_chunk_chars=60)
    chunks = ingest.chunk_text(text, how)
    raw = text.encode()
    assert [c[0] for c in chunks] == list(range(len(chunks)))
    for _, part, n, start, end in chunks:
        assert raw[start:end].decode() == part and end - start <= 60 and n >= 1 and part.strip()
    covered = set()
    for *_, start, end in chunks:
        covered |= set(range(start, end))
    assert all(raw[i : i + 1].isspace() for i in set(range(len(raw))) - covered)
    assert ingest.chunk_text("") == [] and ingest.chunk_text(" \n ") == []
    for bad in ({"chunk_size": 0}, {"chunk_overlap": 999}, {"size_unit": "bytes"}):
        with pytest.raises(ValueError):
            ingest.Chunking(**bad)


def test_pages(spark):
    got = one(spark, T.page_ranges(F.lit("ab\fé\f\f")))
    assert [tuple(p) for p in got] == [(1, 0, 2), (2, 3, 5), (3, 6, 6)]


def test_sentences(spark):
    got = one(spark, T.sentences(F.lit("Ünd so. Why? ok")))
    assert [tuple(s) for s in got] == [("Ünd so.", 0, 8), ("Why?", 9, 13), ("ok", 14, 16)]
    assert one(spark, T.byte_position(F.lit("éa"), F.lit("a"))) == 2


def test_grounding(spark):
    rows = spark.createDataFrame([(1, "", 0.2)], "answer_id long, text string, score double")
    assert grounding.weighted_score(rows).first()["score"] == 1.0
    chunks = spark.createDataFrame([(0, "x" * 9000), (1, "y")], "position int, text string")
    assert grounding.premise_chunks(chunks).count() == 0


def test_upsert_and_latest(spark):
    stored = spark.createDataFrame([(1, "old"), (2, "old")], "id long, v string")
    new = spark.createDataFrame([(2, "new"), (3, "new"), (3, "new")], "id long, v string")
    assert sorted(map(tuple, ingest.upserted(stored, new, ["id"]).collect())) == [(1, "old"), (2, "new"), (3, "new")]
    rows = spark.createDataFrame([("a", 1), ("a", 2), (None, 1), (None, 2)], "k string, t int")
    assert ingest.latest_per_identity(rows, ["k"], [F.desc("t")]).count() == 3
    named = ingest.collections_upserted(spark.createDataFrame([("x", "")], "name string, description string"), "x", "filled")
    assert named.first()["description"] == "filled"
    with pytest.raises(ValueError):
        ingest.resolved_collections(spark.createDataFrame([(1, "x")], "id long, name string"), ["y"], strict=True)


def test_store(spark, tmp_path):
    s = store.ParquetStore(spark, f"file://{tmp_path}/store")
    rows = [(1, "en", 1, "the red cat", [1.0, 0.0]), (2, "fr", 2, "chat rouge", [0.0, 1.0])]
    s.store(spark.createDataFrame(rows, s.SCHEMA))
    assert [r["id"] for r in s.search([1.0, 0.1]).collect()] == [1, 2]
    assert [r["id"] for r in s.search_text("red cat").collect()] == [1]
    s.delete(spark.createDataFrame([(1,)], "id long"), "en")
    s.clear("fr")
    assert s.chunks().count() == 0


def test_parsers(spark, tmp_path):
    p = files.Parsers()
    p.register("pdf", lambda b: files.magic_pdf(b).decode())
    p.register("md", False)
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.pdf").write_text("no pdf")
    got = {r["path"].rsplit("/", 1)[-1]: (r["text"], r["error"]) for r in files.parsed(files.binary_files(spark, str(tmp_path)), p).collect()}
    assert got["a.txt"] == ("hello", None) and got["b.pdf"][1] == "not a PDF file"
    with pytest.raises(ValueError):
        p.get("md")


def test_plugins():
    class Thing:
        def embed(self):
            return 1

    assert plugins.resolve(None, "embed", len) is len and plugins.resolve(False, "embed") is None
    assert plugins.resolve(Thing(), "embed")() == 1 and plugins.resolve((Thing, {}), "embed")() == 1
    with pytest.raises(ValueError):
        plugins.resolve("x", "embed")
    assert plugins.layered({"a": 1, "b": 1}, {"a": 2, "b": None}) == {"a": 2, "b": 1}
    assert plugins.redacted({"api_key": "x", "n": {"token": "y", "k": 1}}) == {"api_key": "[redacted]", "n": {"token": "[redacted]", "k": 1}}


def test_pipeline_steps(spark):
    hits = spark.createDataFrame([(1, "one", 0.9), (2, "two", 0.5)], "id long, text string, score double")
    said = iter(['```json\n{"needs_retrieval": true}\n```', "no list", 'talk {"questions": ["a", "b"]}', "answer"])
    ctx = steps.gate(steps.Context("q"), lambda p: next(said))
    ctx = steps.select(ctx, lambda p: next(said), ["c1", "c2"])
    assert ctx.retrieve and ctx.collections == ("c1", "c2")
    ctx = steps.decompose(ctx, lambda p: next(said))
    ctx = steps.retrieve(ctx, lambda q, c: hits)
    assert len(ctx.results) == 4 and ctx.chunks.count() == 2
    ctx = steps.answer(ctx, lambda p: next(said))
    assert ctx.answer == "answer" and ctx.error is None

    def broken(prompt):
        raise RuntimeError("down")

    failed = steps.rewrite(ctx, broken)
    assert "down" in failed.error and steps.expand(failed, broken).error == failed.error


def test_loop(spark):
    hits = spark.createDataFrame([(1, "one", 0.9), (2, "two", 0.5)], "id long, text string, score double")
    calls = iter([{"tool": "search", "args": {"query": "x"}}, {"tool": "search", "args": {"collection": "other"}}, {"tool": "answer", "args": {"text": "done"}}])
    state = steps.run_loop("q", lambda s: next(calls), lambda q, c: hits, collections=["mine"])
    assert state.terminated_by == "answered" and state.answer == "done" and state.history[1]["refused"] and state.chunks.count() == 2
    state = steps.run_loop("q", lambda s: {"tool": "nothing"}, lambda q, c: hits, max_iterations=2, fallback=lambda s: "fallback")
    assert state.terminated_by == "max_iterations" and state.answer == "fallback"


def test_only_the_entry_knows_the_llm_package():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "sextant"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "sextant.llm" not in path.read_text()


def test_telemetry(spark):
    from sextant.plans import telemetry

    events = []
    handler = lambda name, data: events.append((name, data))
    telemetry.attach(handler)
    with telemetry.span("search", k=3) as out:
        out["found"] = 2
    with pytest.raises(ValueError), telemetry.span("search"):
        raise ValueError
    telemetry.detach(handler)
    assert [n for n, _ in events] == ["search.start", "search.stop", "search.start", "search.exception"] and events[1][1]["found"] == 2
    df, seen = telemetry.observed(spark.range(5), n=F.count("*"))
    df.collect()
    assert seen.get == {"n": 5}


def test_command_line(capsys):
    from sextant.__main__ import main

    assert main(["list"]) == 0 and "hybrid_weighted" in capsys.readouterr().out
    assert main(["run", "no such query", "x"]) == 2


def test_graph_store(spark, graph, tmp_path):
    from sextant.sources.graph_store import ParquetGraph

    g = ParquetGraph(spark, f"file://{tmp_path}/graph")
    assert g.tables()["entities"].count() == 0
    g.persist(graph | {"communities": graph["communities"].withColumn("summary", F.lit("s"))})
    assert {r["chunk_id"]: round(r["score"], 3) for r in g.search(["A"], depth=1).collect()} == {1: 0.15, 2: 0.05}
    assert {r["name"] for r in g.related(spark.createDataFrame([("a",)], "id string"), 2).collect()} == {"A", "B", "C"}
    g.sweep("one")
    assert g.tables()["entities"].count() == 3 and g.tables()["communities"].where("dirty").count() == 2
    g.delete_by_collection("one")
    assert g.tables()["relationships"].count() == 0


def test_lookups(spark, graph):
    ids = spark.createDataFrame([("b",)], "id string")
    chunks = spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string")
    assert {(r["chunk_id"], r["text"]) for r in G.mention_details(ids, graph["mentions"], chunks, 1).collect()} == {(1, "x")}
    assert G.relationships_of(ids, graph["relationships"]).count() == 2
    comms = graph["communities"].withColumn("summary", F.lit("s"))
    assert [r["id"] for r in G.summaries_containing(comms, "f", 1).collect()] == ["y"]
    found = C.detect_by_collection(graph["entities"], graph["relationships"], C.Detection(min_size=2)).collect()
    assert {x for r in found for x in r["entity_ids"]} == set("abcde")
    assert one(spark, T.is_uuid(F.lit("no"))) is False
    assert one(spark, T.relation_line(F.lit("a"), F.lit("R"), F.lit("b"), F.lit(None).cast("string"))) == "a -R-> b"


def test_schema_and_embeddings(spark):
    from sextant.plans import schema

    chunks = schema.empty(spark, "chunks")
    assert schema.problems("chunks", chunks, 3).count() == 0
    bad = spark.createDataFrame([("1", None, [1.0], 0, 1, {}, "d")], schema.TABLES["chunks"])
    assert {r["problem"] for r in schema.problems("chunks", bad, 3).collect()} == {"no text", "other dimension"}
    rows = spark.createDataFrame([(1, "a", None), (2, "b", [9.0])], "id long, text string, embedding array<double>")
    embed = lambda t: V.hash_embedding(F.array(t), 8)
    got = {r["id"]: r["embedding"] for r in ingest.embed_missing(rows, embed, F.col("text")).collect()}
    assert got[2] == [9.0] and len(got[1]) == 8
    cases = E.generated_cases(rows, lambda t: f"What about {t}?", 2)
    assert len(cases) == 2 and cases[0]["relevant"]


# --- long inputs and deep graphs ----------------------------------------------------------------------------------


def test_long_texts_go_through(spark):
    run = spark.createDataFrame([(1, "Aa " * 400_000), (2, "Ab cd. " * 30_000), (3, "p\f" * 30_000)], "id long, text string")
    assert run.where("id = 1").select(F.size(T.entities_in(F.col("text")))).first()[0] == 1
    got = run.where("id = 2").select(T.sentences(F.col("text")).alias("s")).select(F.size("s"), F.col("s")[29_999]["end"]).first()
    assert tuple(got) == (30_000, 30_000 * 7 - 1)
    pages = run.where("id = 3").select(T.page_ranges(F.col("text")).alias("s")).select(F.size("s"), F.col("s")[29_999]["start"]).first()
    assert tuple(pages) == (30_000, 59_998)


def test_running_folds_any_length(spark):
    from sextant.functions.arrays import running

    for n in (0, 1, 2, 255, 256, 257, 1000):
        got = spark.range(1).select(running(F.array(*map(F.lit, range(n))).cast("array<int>") if n else F.array().cast("array<int>"), F.lit(0), lambda s, x: s + x, lambda s, x: s, "int", 16)).first()[0]
        assert got == [i * (i - 1) // 2 for i in range(n)]


def test_entities_of_a_text(spark):
    row = spark.createDataFrame([("Acme met Jane Doe, Acme and\tBob9 Alice\nSmith",)], "t string").select(F.posexplode(T.entities_in(F.col("t"))).alias("p", "n"))
    got = [(r["n"], r["k"]) for r in row.withColumn("k", T.entity_type(F.col("n"), F.col("p"))).collect()]
    assert got == [("Acme", "organization"), ("Jane Doe", "person"), ("Alice\nSmith", "concept")]


def test_page_ranges_of_trimmed_texts(spark):
    got = spark.createDataFrame([("  ab\fcd\f",)], "r string").select(T.page_ranges(F.col("r"), 2, F.lit(4))).first()[0]
    assert [tuple(x) for x in got] == [(1, 0, 2), (2, 3, 4)]


def test_components_need_few_rounds(spark):
    import random

    from sextant.operators.components import connected
    from sextant.plans.storage import cut

    ids = list(range(1000))
    for seed in (None, 1):
        names = ids[:]
        if seed is not None:
            random.Random(seed).shuffle(names)
        chain = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
        steps_taken = []
        got = {r["id"]: r["component"] for r in connected(chain, lambda df, _: cut(df), steps_taken.append).collect()}
        assert got == dict.fromkeys(ids, 0) and len(steps_taken) <= (15 if seed is None else 30)


def test_numbered_over_partitions(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 7919 % 1000).alias("score")).repartition(7)
    got = {r["id"]: r["rank"] for r in R.ranked(rows, 0).collect()}
    assert got == {r["id"]: r["rank"] for r in R.ranked(rows, 0, most=1000).collect()} and sorted(got.values()) == list(range(1, 1001))


def test_attribution_meets_by_rare_words(spark):
    spans = spark.createDataFrame([(1, "the cat sat"), (2, "the the of"), (3, "zebra the cat"), (4, "")], "span_id long, text string")
    chunks = spark.createDataFrame([(10, "the cat sat on the mat"), (11, "the of"), (12, "the"), (13, None), (14, "cat zebra")], "chunk_id long, text string")
    words = lambda t: set((t or "").split())
    for least in (0.3, 0.5, 0.6, 2 / 3, 1.0):
        got = {(r["span_id"], r["chunk_id"]): round(r["score"], 6) for r in grounding.attribution(spans, chunks, least).collect()}
        want = {(s, c): round(len(words(a) & words(b)) / len(words(a)), 6) for s, a in map(tuple, spans.collect()) for c, b in map(tuple, chunks.collect()) if words(a) and len(words(a) & words(b)) and len(words(a) & words(b)) / len(words(a)) >= least}
        assert got == want

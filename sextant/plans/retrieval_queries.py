"""Registered queries: retrieval, fusion, reranking, evaluation and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.functions import vector as V
from sextant.operators import evaluation as E
from sextant.operators import grounding as G
from sextant.operators import ingest as I
from sextant.operators import retrieval as R
from sextant.plans import views
from sextant.plans.catalog import register

CHUNKS = "chunks AS (SELECT d.doc_id AS id, d.text, d.lang AS collection, d.source, e.embedding::DOUBLE[] AS v, e.label FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)"
QUERY = "q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 0)"
TOKENS = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9_ \t\n\r\f\v]', '', 'g'), '[ \t\n\r\f\v]+'), lambda x: x <> ''))"
SCORED = f"WITH {CHUNKS}, {QUERY}, scored AS (SELECT id, collection, source, label, list_cosine_similarity(v, qv) AS s FROM chunks, q)"
WORDS = ("the", "of", "and")
LIST = "['the', 'of', 'and']"


def _scored(spark, sf):
    return R.vector_scores(views.chunks(spark, sf), views.vector(spark, sf))


def _out(df, *extra):
    return df.select("id", *extra, F.round("score", 6).alias("score"))


@register("vector_topk", f"{SCORED} SELECT id, round(s, 6) AS score FROM scored WHERE s > 0 ORDER BY s DESC, id LIMIT 10")
def vector_topk(spark, sf):
    return _out(R.vector_topk(views.chunks(spark, sf), views.vector(spark, sf), 10))


@register("vector_topk_collection", f"{SCORED} SELECT id, round(s, 6) AS score FROM scored WHERE s > 0 AND collection = 'en' ORDER BY s DESC, id LIMIT 10")
def vector_topk_collection(spark, sf):
    return _out(R.vector_topk(R.scoped(views.chunks(spark, sf), collections=["en"]), views.vector(spark, sf), 10))


@register("vector_topk_source", f"{SCORED} SELECT id, round(s, 6) AS score FROM scored WHERE s > 0 AND source = 'src3' ORDER BY s DESC, id LIMIT 10")
def vector_topk_source(spark, sf):
    return _out(R.vector_topk(R.scoped(views.chunks(spark, sf), source="src3"), views.vector(spark, sf), 10))


@register("vector_empty_scope", f"{SCORED} SELECT id, round(s, 6) AS score FROM scored WHERE false")
def vector_empty_scope(spark, sf):
    return _out(R.vector_topk(R.scoped(views.chunks(spark, sf), collections=[]), views.vector(spark, sf), 10))


@register("vector_threshold_strict", f"{SCORED} SELECT id, round(s, 6) AS score FROM scored WHERE s > 0.2")
def vector_threshold_strict(spark, sf):
    return _out(_scored(spark, sf).where("score > 0.2"))


_PAIRS = "p AS (SELECT a.vec_id AS query_id, a.label AS query_label, b.vec_id AS id, a.label = b.label AS rel, list_cosine_similarity(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"


@register("vector_batch_topk", f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p WHERE s > 0) SELECT query_id, id, round(s, 6) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5")
def vector_batch_topk(spark, sf):
    found = R.vector_batch(views.vectors(spark, sf), views.questions(spark, sf), 5, exclude_self=True)
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@register("knn_self_join", f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p) SELECT query_id, id, round(s, 6) AS score FROM r WHERE rank = 1")
def knn_self_join(spark, sf):
    """Each vector's nearest other."""
    found = R.vector_batch(views.vectors(spark, sf), views.questions(spark, sf), 1, threshold=None, exclude_self=True)
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@register("entity_topk_by_embedding", f"{SCORED} SELECT id, round(s, 6) AS score FROM scored WHERE 1 - s < 1 - 0.3 ORDER BY s DESC, id LIMIT 20")
def entity_topk_by_embedding(spark, sf):
    return _out(R.top(_scored(spark, sf).where((1 - F.col("score")) < (1 - 0.3)), 20))


@register("keyword_overlap_topk", f"WITH t AS (SELECT doc_id AS id, {TOKENS} AS k FROM documents), s AS (SELECT id, len(list_intersect(k, {LIST}))::DOUBLE / 3 / ln(greatest(len(k), 2) + 1) AS s FROM t) SELECT id, round(s, 6) AS score FROM s WHERE s > 0 ORDER BY s DESC, id LIMIT 10")
def keyword_overlap_topk(spark, sf):
    return _out(R.keyword_topk(views.with_tokens(views.documents(spark, sf)), views.terms(*WORDS), 10))


@register("keyword_and_gate", f"WITH t AS (SELECT doc_id AS id, {TOKENS} AS k FROM documents) SELECT id, len(k) AS n_tokens FROM t WHERE list_has_all(k, {LIST})")
def keyword_and_gate(spark, sf):
    rows = views.with_tokens(views.documents(spark, sf))
    return rows.where(R.gated(F.col("tokens"), views.terms(*WORDS))).select("id", F.size("tokens").cast("long").alias("n_tokens"))


def _hybrid_sql(words: str, n: int, vw: float, kw: float, floor: float) -> str:
    gate = f"list_has_all(k, {words})" if n else "false"
    overlap = f"len(list_intersect(k, {words}))::DOUBLE / {n} / ln(greatest(len(k), 2) + 1)" if n else "0.0::DOUBLE"
    return (
        f"WITH {CHUNKS}, {QUERY}, t AS (SELECT id, list_cosine_similarity(v, qv) AS vs, {TOKENS} AS k FROM chunks, q WHERE collection = 'en'), "
        f"r AS (SELECT id, vs, CASE WHEN {gate} THEN {overlap} ELSE 0.0::DOUBLE END AS raw FROM t), "
        f"b AS (SELECT nullif(greatest(max(raw), {floor}::DOUBLE), 0) AS m FROM r), "
        f"f AS (SELECT id, vs, coalesce(raw / m, 0.0::DOUBLE) AS ks FROM r, b), g AS (SELECT *, {vw}::DOUBLE * vs + {kw}::DOUBLE * ks AS s FROM f) "
        "SELECT id, round(vs, 6) AS vector_score, round(ks, 6) AS keyword_score, round(s, 6) AS score FROM g WHERE s > 0 ORDER BY s DESC, id LIMIT 10"
    )


def _hybrid(words, vw, kw, floor):
    def run(spark, sf):
        rows = views.with_tokens(R.scoped(views.chunks(spark, sf), collections=["en"]))
        found = R.hybrid_topk(rows, views.vector(spark, sf), views.terms(*words), 10, vector_weight=vw, keyword_weight=kw, floor=floor)
        return found.select("id", *(F.round(c, 6).alias(c) for c in ("vector_score", "keyword_score", "score")))

    return run


for _name, _args in {"hybrid_weighted": (WORDS, 0.5, 0.5, 0.05), "hybrid_weights_70_30": (WORDS, 0.7, 0.3, 0.05), "hybrid_floor_zero": (WORDS, 0.5, 0.5, 0.0), "hybrid_floor_damped": (WORDS, 0.5, 0.5, 1.0), "hybrid_no_match_zero": (("nosuchword",), 0.5, 0.5, 0.0), "hybrid_no_terms": ((), 0.5, 0.5, 0.05)}.items():
    _sql_words = "['the', 'of', 'and']" if _args[0] == WORDS else "['nosuchword']"
    register(_name, _hybrid_sql(_sql_words, len(_args[0]), *_args[1:]))(_hybrid(*_args))


def _list_sql(name: str, cond: str, limit: int) -> str:
    return f"{name} AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT * FROM scored WHERE s > 0 AND {cond} ORDER BY s DESC, id LIMIT {limit}))"


_KEYS = f"kw AS (SELECT id, len(list_intersect(k, {LIST}))::DOUBLE / 3 / ln(greatest(len(k), 2) + 1) AS s FROM (SELECT id, {TOKENS} AS k FROM chunks)), l2 AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS rank FROM (SELECT * FROM kw WHERE s > 0 ORDER BY s DESC, id LIMIT 20))"


def _vector_list(spark, sf, no, collection=None, k=20):
    rows = R.scoped(views.chunks(spark, sf), collections=collection)
    return R.ranked(R.vector_topk(rows, views.vector(spark, sf), k), no, most=k)


def _keyword_list(spark, sf, no, k=20):
    return R.ranked(R.keyword_topk(views.with_tokens(views.chunks(spark, sf)), views.terms(*WORDS), k), no, most=k)


def _fuse_sql(*lists: str) -> str:
    union = " UNION ALL ".join(f"SELECT id, rank FROM {x}" for x in lists)
    return f"SELECT id, round(s, 9) AS score FROM (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM ({union}) GROUP BY id) ORDER BY round(s, 12) DESC, id LIMIT 10"


def _fused(lists):
    out = R.fuse(lists).withColumn("score", F.round("score", 12))
    return R.top(out, 10).select("id", F.round("score", 9).alias("score"))


@register("rrf_two_lists", f"{SCORED}, {_list_sql('l1', 'true', 20)}, {_KEYS} {_fuse_sql('l1', 'l2')}")
def rrf_two_lists(spark, sf):
    return _fused([_vector_list(spark, sf, 0), _keyword_list(spark, sf, 1)])


@register("rrf_three_lists", f"{SCORED}, {_list_sql('l1', 'true', 20)}, {_KEYS}, {_list_sql('l3', chr(39).join(['collection = ', 'en', '']), 20)} {_fuse_sql('l1', 'l2', 'l3')}")
def rrf_three_lists(spark, sf):
    return _fused([_vector_list(spark, sf, 0), _keyword_list(spark, sf, 1), _vector_list(spark, sf, 2, ["en"])])


@register("hybrid_rrf_overfetch", f"{SCORED}, {_list_sql('l1', 'true', 10 * R.POOL)}, {_KEYS} {_fuse_sql('l1', 'l2')}")
def hybrid_rrf_overfetch(spark, sf):
    return _fused([_vector_list(spark, sf, 0, k=10 * R.POOL), _keyword_list(spark, sf, 1, k=10 * R.POOL)])


_TWO = "en AS (SELECT *, 0 AS n FROM scored WHERE s > 0 AND collection = 'en' ORDER BY s DESC, id LIMIT 10), fr AS (SELECT *, 1 AS n FROM scored WHERE s > 0 AND collection = 'fr' ORDER BY s DESC, id LIMIT 10), u AS (SELECT * FROM en UNION ALL SELECT * FROM fr)"


def _two(spark, sf):
    return [R.vector_topk(R.scoped(views.chunks(spark, sf), collections=[c]), views.vector(spark, sf), 10) for c in ("en", "fr")]


@register("multi_collection_merge", f"{SCORED}, {_TWO} SELECT id, collection, round(s, 6) AS score FROM u ORDER BY s DESC, id LIMIT 10")
def multi_collection_merge(spark, sf):
    return _out(R.merge_collections(_two(spark, sf), 10), "collection")


@register("multi_collection_concat_rank", f"{SCORED}, {_TWO} SELECT id, (row_number() OVER (ORDER BY n, s DESC, id))::INTEGER AS position, round(s, 6) AS score FROM u")
def multi_collection_concat_rank(spark, sf):
    return _out(R.concat_rank(_two(spark, sf)), "position")


_RERANK = f"{SCORED}, p AS (SELECT s.id, d.n_chars FROM (SELECT * FROM scored WHERE s > 0 ORDER BY s DESC, id LIMIT 30) s JOIN documents d ON d.doc_id = s.id), z AS (SELECT id, (n_chars % 11)::DOUBLE AS r FROM p)"


def _pool(spark, sf):
    sizes = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars")
    return R.vector_topk(views.chunks(spark, sf), views.vector(spark, sf), R.over_fetched(10)).select("id").join(sizes, "id")


def _judge(rows):
    return (F.col("n_chars") % 11).cast("double")


@register("rerank_overfetch", f"{_RERANK} SELECT id, r AS rerank_score FROM z ORDER BY r DESC, id LIMIT 10")
def rerank_overfetch(spark, sf):
    return R.rerank(_pool(spark, sf), _judge, top_k=10).select("id", "rerank_score")


@register("rerank_threshold_then_topk", f"{_RERANK} SELECT id, r AS rerank_score FROM z WHERE r >= 7 ORDER BY r DESC, id LIMIT 5")
def rerank_threshold_then_topk(spark, sf):
    return R.rerank(_pool(spark, sf), _judge, threshold=7, top_k=5).select("id", "rerank_score")


@register("rerank_topk_overrides_threshold", f"{_RERANK} SELECT id, r AS rerank_score FROM z ORDER BY r DESC, id LIMIT 20")
def rerank_topk_overrides_threshold(spark, sf):
    return R.rerank(_pool(spark, sf), _judge, threshold=7, top_k=20, top_k_overrides=True).select("id", "rerank_score")


@register("rerank_keep_relevant", f"{_RERANK} SELECT id, r AS rerank_score FROM z WHERE r >= 7")
def rerank_keep_relevant(spark, sf):
    return R.rerank(_pool(spark, sf), _judge, threshold=7).select("id", "rerank_score")


@register("maxsim", "WITH p AS (SELECT q.label AS query_id, q.vec_id AS token, t.label AS id, max(list_cosine_similarity(t.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS m FROM embeddings t, embeddings q GROUP BY ALL) SELECT query_id, id, round(sum(m), 6) AS score FROM p GROUP BY query_id, id")
def maxsim(spark, sf):
    """Every label's vectors as the token vectors of a query and of a text."""
    tokens = views.vectors(spark, sf)
    queries = tokens.select(F.col("label").alias("query_id"), F.col("id").alias("token"), F.col("embedding").alias("query"))
    found = R.max_sim(queries, tokens.select(F.col("label").alias("id"), "embedding"))
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


_EVAL = f"WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM p), h AS (SELECT query_id AS case_id, query_label, count(*) FILTER (rel) AS n, " + ", ".join(f"count(*) FILTER (rel AND rank <= {k}) AS h{k}" for k in E.CUTS) + ", min(rank) FILTER (rel AND rank <= 10) AS first FROM r GROUP BY query_id, query_label)"


def _cases(spark, sf):
    q = views.questions(spark, sf)
    results = R.vector_batch(views.vectors(spark, sf), q, 10, threshold=None, exclude_self=True).select(F.col("query_id").alias("case_id"), "id", "rank")
    cases = q.select(F.col("query_id").alias("case_id"), F.col("query_label").alias("label"))
    return E.label_metrics(cases, results, views.vectors(spark, sf).select("id", "label"))


@register("eval_recall_precision", f"{_EVAL} SELECT case_id, " + ", ".join(f"round(CASE WHEN n > 0 THEN h{k}::DOUBLE / n ELSE 0.0 END, 6) AS recall_at_{k}, round(h{k}::DOUBLE / {k}, 6) AS precision_at_{k}" for k in E.CUTS) + " FROM h")
def eval_recall_precision(spark, sf):
    return _cases(spark, sf).select("case_id", *(F.round(f"{m}_at_{k}", 6).alias(f"{m}_at_{k}") for k in E.CUTS for m in ("recall", "precision")))


_MEANS = "count(*) AS n_cases, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, " + ", ".join(f"round(avg((h{k} > 0)::INTEGER), 6) AS hit_at_{k}" for k in E.CUTS)


@register("eval_mrr_hit", f"{_EVAL} SELECT {_MEANS} FROM h")
def eval_mrr_hit(spark, sf):
    return E.run_metrics(_cases(spark, sf)).select("n_cases", F.round("mrr", 6).alias("mrr"), *(F.round(f"hit_at_{k}", 6).alias(f"hit_at_{k}") for k in E.CUTS))


@register("eval_by_mode", f"{_EVAL} SELECT query_label % 2 AS mode, {_MEANS} FROM h GROUP BY mode")
def eval_by_mode(spark, sf):
    """The means of each mode of cases; here a case's mode is its label's parity."""
    modes = views.questions(spark, sf).select(F.col("query_id").alias("case_id"), (F.col("query_label") % 2).alias("mode"))
    found = E.run_metrics(_cases(spark, sf).join(modes, "case_id"), by=["mode"])
    return found.select("mode", "n_cases", F.round("mrr", 6).alias("mrr"), *(F.round(f"hit_at_{k}", 6).alias(f"hit_at_{k}") for k in E.CUTS))


@register("eval_answer_means", "SELECT avg(CASE WHEN quality IS NOT NULL THEN least(greatest(quality * 12, 0), 10) END) AS faithfulness, avg(CASE WHEN toxic IS NOT NULL THEN least(greatest(toxic * 4, 0), 10) END) AS correctness FROM labels")
def eval_answer_means(spark, sf):
    return E.answer_means(views.table(spark, sf, "labels").select((F.col("quality") * 12).alias("faithfulness"), (F.col("toxic") * 4).alias("correctness")))


@register("scoped_test_cases", "WITH links AS (SELECT doc_id AS case_id, doc_id AS chunk_id FROM labels UNION ALL SELECT doc_id, doc_id + 1 FROM labels) SELECT doc_id AS case_id FROM labels c WHERE EXISTS (SELECT 1 FROM links l JOIN documents d ON d.doc_id = l.chunk_id WHERE l.case_id = c.doc_id AND d.lang = 'en') AND NOT EXISTS (SELECT 1 FROM links l LEFT JOIN documents d ON d.doc_id = l.chunk_id WHERE l.case_id = c.doc_id AND coalesce(d.lang <> 'en', true))")
def scoped_test_cases(spark, sf):
    labels = views.table(spark, sf, "labels").select(F.col("doc_id").alias("case_id"))
    links = labels.select("case_id", F.col("case_id").alias("chunk_id")).union(labels.select("case_id", F.col("case_id") + 1))
    docs = views.table(spark, sf, "documents")
    placed = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"))
    return E.in_scope(labels, links, placed, docs.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("collection")), ["en"])


_CONFIGS = "configs AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '{}' WHEN 1 THEN '{\"collections\": []}' WHEN 2 THEN '{\"collections\": \"click\"}' WHEN 3 THEN NULL WHEN 4 THEN '{\"collections\": [\"' || event_type || '\"]}' ELSE '{\"collections\": [\"view\", \"' || event_type || '\"]}' END AS config FROM events)"


@register("runs_scope_json", f"WITH {_CONFIGS} SELECT event_id FROM configs WHERE CASE WHEN json_type(config, '$.collections') = 'ARRAY' THEN json_array_length(config, '$.collections') > 0 AND list_has_all(['click', 'view'], json_extract_string(config, '$.collections[*]')) ELSE false END")
def runs_scope_json(spark, sf):
    n, kind = F.col("event_id") % 6, F.col("event_type")
    config = F.when(n == 0, "{}").when(n == 1, '{"collections": []}').when(n == 2, '{"collections": "click"}').when(n == 4, F.format_string('{"collections": ["%s"]}', kind)).when(n == 5, F.format_string('{"collections": ["view", "%s"]}', kind))
    return E.runs_in_scope(views.table(spark, sf, "events").select("event_id", config.alias("config")), ["click", "view"]).select("event_id")


@register("sample_chunks_hash", "SELECT doc_id AS id FROM documents ORDER BY sha256('7:' || doc_id::VARCHAR), doc_id LIMIT 25")
def sample_chunks_hash(spark, sf):
    return E.sample(views.documents(spark, sf), 25, 7).select("id")


@register("token_estimate", "SELECT doc_id AS id, greatest(1, length(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf):
    return views.documents(spark, sf).select("id", T.token_estimate(F.col("text")).alias("tokens"))


@register("tokenize_distinct", f"SELECT doc_id AS id, len({TOKENS}) AS n, md5(array_to_string(list_sort({TOKENS}), ' ')) AS h FROM documents")
def tokenize_distinct(spark, sf):
    rows = views.with_tokens(views.documents(spark, sf))
    return rows.select("id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("tokens"), " ").cast("binary")).alias("h"))


_SETS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"


@register("word_overlap_attribution", f"WITH s AS (SELECT item_id AS span_id, {_SETS} AS w FROM benchmark), a AS (SELECT span_id, len(w) AS n, unnest(w) AS word FROM s), b AS (SELECT doc_id AS chunk_id, unnest({_SETS}) AS word FROM documents) SELECT span_id, chunk_id, round(count(*)::DOUBLE / max(n), 6) AS score FROM a JOIN b USING (word) GROUP BY span_id, chunk_id HAVING count(*)::DOUBLE / max(n) >= 0.6")
def word_overlap_attribution(spark, sf):
    spans = views.table(spark, sf, "benchmark").select(F.col("item_id").alias("span_id"), "text")
    found = G.attribution(spans, views.documents(spark, sf).select(F.col("id").alias("chunk_id"), "text"), 0.6)
    return found.select("span_id", "chunk_id", F.round("score", 6).alias("score"))


@register("sentence_split", r"WITH m AS (SELECT doc_id AS id, regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g') AS x FROM documents), s AS (SELECT id, unnest(string_split(x, chr(1))) AS t FROM m) SELECT id, count(*) AS n, sum(strlen(t))::BIGINT AS bytes FROM s WHERE trim(t) <> '' GROUP BY id")
def sentence_split(spark, sf):
    rows = views.documents(spark, sf).select("id", F.explode(T.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.sum((F.col("s.end") - F.col("s.start")).cast("long")).alias("bytes"))


@register("chunk_fixed_window", "WITH w AS (SELECT doc_id, text, unnest(generate_series(0, greatest(0, ceil((length(text) - 1800) / 1600.0)::BIGINT))) AS i FROM documents), c AS (SELECT doc_id AS document_id, i, substring(text, i * 1600 + 1, 1800) AS t FROM w) SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY i) - 1)::INTEGER AS chunk_index, md5(t) AS h FROM c WHERE trim(t) <> ''")
def chunk_fixed_window(spark, sf):
    return I.windowed(views.documents(spark, sf), 1800, 200).select("document_id", "chunk_index", F.md5(F.col("text").cast("binary")).alias("h"))


@register("chunk_recursive")
def chunk_recursive(spark, sf):
    return I.chunked(views.documents(spark, sf))


@register("page_range_lookup", "WITH c AS (SELECT doc_id AS document_id, unnest([0, strlen(text) // 2, strlen(text) - 1]) AS b, strlen(text) AS n FROM documents), p AS (SELECT *, 500 AS size FROM c) SELECT document_id, b::BIGINT AS start_byte, (least(b // 500, greatest(0, ceil(n / 500.0) - 1)) + 1)::INTEGER AS page_start FROM p")
def page_range_lookup(spark, sf):
    n = F.octet_length("text")
    docs = views.documents(spark, sf).select(F.col("id").alias("document_id"), n.alias("n"))
    count = F.greatest(F.lit(1), F.ceil(F.col("n") / 500)).cast("int")
    pages = docs.select("document_id", "n", F.explode(F.sequence(F.lit(1), count)).alias("number")).select("document_id", "number", ((F.col("number") - 1) * 500).alias("start"), F.least(F.col("number") * 500, "n").alias("end"))
    places = docs.select("document_id", F.explode(F.array(F.lit(0).cast("long"), F.floor(F.col("n") / 2), F.col("n").cast("long") - 1)).alias("start_byte")).withColumn("end_byte", F.col("start_byte") + 1)
    return I.with_pages(places, pages).select("document_id", "start_byte", "page_start")


@register("blank_reindex", "WITH c AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS t, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents) SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY i) - 1)::INTEGER AS chunk_index, strlen(t)::BIGINT AS bytes FROM c WHERE trim(t) <> ''")
def blank_reindex(spark, sf):
    lines = F.filter(F.split("text", "\n"), lambda t: F.trim(t) != "")
    return views.documents(spark, sf).select(F.col("id").alias("document_id"), F.posexplode(lines).alias("chunk_index", "t")).select("document_id", "chunk_index", F.octet_length("t").cast("long").alias("bytes"))


@register("hash_embed")
def hash_embed(spark, sf):
    words = F.array_sort(T.tokens(F.col("text")))
    return views.table(spark, sf, "benchmark").select("item_id", F.transform(V.hash_embedding(words), lambda x: F.round(x, 6)).alias("embedding"))


@register("ann_lsh_topk")
def ann_lsh_topk(spark, sf):
    return _out(R.lsh_topk(views.vectors(spark, sf), views.vector(spark, sf), 10))


@register("docs_grouped_by_best_chunk", f"{SCORED} SELECT source AS document_id, round(max(s), 6) AS best, count(*) AS n FROM (SELECT * FROM scored WHERE s > 0 ORDER BY s DESC, id LIMIT 50) GROUP BY source")
def docs_grouped_by_best_chunk(spark, sf):
    hits = R.vector_topk(views.chunks(spark, sf), views.vector(spark, sf), 50).select(F.col("source").alias("document_id"), "id", "score")
    return R.by_document(hits).select("document_id", F.round("best", 6).alias("best"), "n")


@register("grounding_weighted_score", "SELECT conv_id AS answer_id, round(coalesce(sum(strlen(text) * ((turn % 5) / 4.0)) / nullif(sum(strlen(text)), 0), 1.0), 6) AS score FROM conversations GROUP BY conv_id")
def grounding_weighted_score(spark, sf):
    rows = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("answer_id"), "text", ((F.col("turn") % 5) / 4.0).alias("score"))
    return G.weighted_score(rows).select("answer_id", F.round("score", 6).alias("score"))


@register("concat_budget_prefix", "WITH r AS (SELECT conv_id AS answer_id, turn AS position, sum(strlen(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT answer_id, position FROM r WHERE t <= 500 AND n <= 3")
def concat_budget_prefix(spark, sf):
    """Of each answer's chunks, here the turns of a conversation, the first that fit the budget."""
    rows = views.table(spark, sf, "conversations").select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("position"), "text")
    return G.premise_chunks(rows, 500, 3, by=["answer_id"]).select("answer_id", "position")


@register("judged_support", "SELECT conv_id AS answer_id, avg((role = 'user')::INTEGER) AS score FROM conversations GROUP BY conv_id")
def judged_support(spark, sf):
    return G.judged_score(views.table(spark, sf, "conversations").select(F.col("conv_id").alias("answer_id"), (F.col("role") == "user").alias("supported")))


@register("best_score_per_sentence", "SELECT conv_id AS sentence_id, max(turn)::DOUBLE AS score FROM conversations GROUP BY conv_id")
def best_score_per_sentence(spark, sf):
    return G.best_per_sentence(views.table(spark, sf, "conversations").select(F.col("conv_id").alias("sentence_id"), F.col("turn").cast("double").alias("score")))


_ITER = "WITH h AS (SELECT user_id AS id, event_id AS iteration, (event_id % 7)::INTEGER AS position, round(value, 6) AS score FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY iteration, position) AS n FROM h)"


def _iterations(spark, sf):
    return views.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("iteration"), (F.col("event_id") % 7).cast("int").alias("position"), F.round("value", 6).alias("score"))


@register("loop_accumulate_chunks", f"{_ITER} SELECT id, score FROM f WHERE n = 1 ORDER BY score DESC, id LIMIT 30")
def loop_accumulate_chunks(spark, sf):
    return R.accumulate(_iterations(spark, sf)).select("id", "score")


@register("first_seen_iteration", "SELECT user_id AS chunk_id, min(event_id) AS iteration, arg_min(event_type, event_id) AS query FROM events GROUP BY user_id")
def first_seen_iteration(spark, sf):
    rows = views.table(spark, sf, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("iteration"), F.col("event_type").alias("query"))
    return G.enriched(rows.select("chunk_id").distinct(), rows).select("chunk_id", "iteration", "query")


@register("merge_dedup_results", f"{_ITER} SELECT id, iteration, position FROM f WHERE n = 1")
def merge_dedup_results(spark, sf):
    return R.first_of(_iterations(spark, sf), ["id"], ["iteration", "position"]).select("id", "iteration", "position")


@register("positional_scores", f"{SCORED}, t AS (SELECT * FROM scored WHERE s > 0 ORDER BY s DESC, id LIMIT 15) SELECT id, (count(*) OVER () - row_number() OVER (ORDER BY s DESC, id) + 1)::BIGINT AS positional FROM t")
def positional_scores(spark, sf):
    found = R.vector_topk(views.chunks(spark, sf), views.vector(spark, sf), 15)
    return R.positional_scores(found, [F.desc("score"), "id"]).select("id", "positional")

"""Oracle SQL of the numbered queries that SQL can express, for DuckDB."""

from __future__ import annotations

from sextant.llm.secrets import BASE, RULES

_QUOTE = "''"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", _QUOTE) + "'"


def _secrets() -> str:
    """Matches and the stretches between them alternate; running sums of their lengths are places."""
    parts = []
    for i, r in enumerate(RULES):
        p = _literal(r.pattern)
        keep = f"regexp_matches(hit, {_literal(r.keep)})" if r.keep else "true"
        parts.append(
            f"SELECT doc_id, '{r.kind}' AS kind, {i} AS ord, after - length(hit) AS s, after AS e FROM ("
            f"SELECT doc_id, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM ("
            f"SELECT doc_id, unnest(regexp_extract_all(t, {p})) AS hit, unnest(list_slice(string_split_regex(t, {p}), 1, len(regexp_extract_all(t, {p})))) AS gap, "
            f"unnest(range(len(regexp_extract_all(t, {p})))) AS i FROM d WHERE regexp_matches(t, {p}))) WHERE {keep}"
        )
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    line = "kind || ':' || s || ':' || e"
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (" + " UNION ALL ".join(parts) + ") "
        f"SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({line}, ',' ORDER BY s, ord) FILTER (kind IN ({base})), '')) AS base_sha256, "
        f"coalesce(string_agg({line}, ',' ORDER BY s, ord), '') AS spans FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"
    )


def _warc() -> str:
    """Base32 of a digest: five hexadecimal digits at a time are four letters."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    quads = " || ".join(f"substr({letters}, 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::INTEGER >> {s}) & 31), 1)" for i in range(8) for s in (15, 10, 5, 0))
    return (
        f"WITH p AS (SELECT page_id, coalesce(html, '') AS b, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p) "
        f"SELECT page_id, strlen(b)::BIGINT AS payload_bytes, {quads} AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f"
    )


_NEARDUP = r"""WITH RECURSIVE w AS (
SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""

_TOPK = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": _secrets(), "op4_warc": _warc(), "op5_neardup": _NEARDUP, "op9_topk": _TOPK}

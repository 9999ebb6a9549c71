"""Retrieval: vector, keyword and hybrid top-k, rank fusion, merging, reranking. Rows in, ranked rows out.

A ranked list has columns id and score (and what else the input carries); ties always go to the smaller id. Batched
forms carry query_id, so any number of questions is one plan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions import vector as V
from sextant.plans.storage import cut

RRF_K, POOL, FLOOR = 60, 2, 0.05


def top(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    return scored.orderBy(F.desc(by), "id").limit(k)


def top_per(scored: DataFrame, k: int, group: str | Sequence[str] = "query_id", by: str = "score") -> DataFrame:
    """The k best of each group with their rank; Spark keeps k a group before the shuffle."""
    keys = [group] if isinstance(group, str) else list(group)
    order = Window.partitionBy(*keys).orderBy(F.desc(by), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def scoped(rows: DataFrame, *, collections: Sequence[str] | None = None, source: str | None = None, collection_col: str = "collection", source_col: str = "source") -> DataFrame:
    """Filters that reach the scan. collections None: everything; an empty list: nothing."""
    if collections is not None:
        rows = rows.where(F.col(collection_col).isin(*collections)) if collections else rows.where(F.lit(False))
    return rows if source is None else rows.where(F.col(source_col) == source)


def vector_scores(chunks: DataFrame, query: Sequence[float], vector_col: str = "embedding") -> DataFrame:
    """Adds score, the cosine similarity with one query vector; rows without a vector go."""
    return chunks.where(F.col(vector_col).isNotNull()).withColumn("score", V.cosine_to(F.col(vector_col), list(query)))


def vector_topk(chunks: DataFrame, query: Sequence[float], k: int = 10, threshold: float = 0.0, vector_col: str = "embedding") -> DataFrame:
    """Top k by cosine similarity, strictly above the threshold."""
    return top(vector_scores(chunks, query, vector_col).where(F.col("score") > threshold), k)


def _dealt(left: DataFrame, right: DataFrame, left_id: str, right_id: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns c and q: every pair of a left and a right block, of at most about `block` rows, meets once.

    Small left sides are cut finer, so that all cores have work; the right side is copied once for each left block.
    """
    cores = left.sparkSession.sparkContext.defaultParallelism
    n, rows = max(1, -(-right.count() // block)), left.count()
    m = max(1, -(-rows // block), min(-(-cores // n), rows // 64))
    spread = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    right = right.withColumn("c", spread(right_id, n)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left = left.withColumn("q", spread(left_id, m)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left, right


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as a matrix, padded with zeros, their lengths and their norms, summed in vector.cosine's order."""
    lengths = vectors.map(len).to_numpy()
    x = np.zeros((len(vectors), max([0, *lengths])))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    squares = np.zeros(len(x))
    for d in range(x.shape[1]):
        squares += x[:, d] * x[:, d]
    return x, lengths, np.sqrt(squares)


def _cosines(a: tuple, b: tuple, rows: slice) -> np.ndarray:
    """Cosines of some rows of a with all of b; 0 for other lengths and zero vectors."""
    (x, n, p), (y, m, q) = (a[0][rows], a[1][rows], a[2][rows]), b
    score = np.zeros((len(x), len(y)))
    for d in range(min(x.shape[1], y.shape[1])):
        score += x[:, d, None] * y[None, :, d]
    scale = p[:, None] * q[None, :]
    return np.divide(score, scale, out=np.zeros_like(score), where=(scale != 0) & (n[:, None] == m[None, :]))


def _unit(vectors: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Vectors at unit length (zero ones stay), and which of them are odd: their norms are not finite, or so great or small
    that sums of squares overflow or lose digits. Odd ones are zeros here."""
    x, _, norms = vectors
    odd = ~((norms == 0) | (norms > 1e-140) & (norms < 1e140))
    return np.divide(x, norms[:, None], out=np.zeros_like(x), where=((norms > 0) & ~odd)[:, None]), odd


def _at_least(near: np.ndarray, k: int) -> np.ndarray:
    """Of each row a value that k of its columns reach, and hardly more: the k-th of the maxima of columns taken together."""
    width = near.shape[1]
    if k >= width:
        return np.full(len(near), -np.inf)
    together = min(64, width // (4 * k))
    if together > 1:
        groups = width // together
        head = near[:, : together * groups].reshape(len(near), together, groups).max(1)
        near = np.hstack([head, near[:, together * groups :]])
    return np.partition(near, near.shape[1] - k, axis=1)[:, -k]


def _pair_cosines(a: tuple, b: tuple, row: np.ndarray, col: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Cosines of pairs of rows of a and b, summed in vector.cosine's order; 0 for other lengths and zero vectors.
    a and b hold their matrices transposed."""
    (x, n, p), (y, m, q) = a, b
    out = np.zeros(len(row))
    for begin in range(0, len(row), step):
        i, j = row[begin : begin + step], col[begin : begin + step]
        score = np.zeros(len(i))
        for d in range(min(len(x), len(y))):
            score += x[d][i] * y[d][j]
        scale = p[i] * q[j]
        np.divide(score, scale, out=out[begin : begin + step], where=(scale != 0) & (n[i] == m[j]))
    return out


def vector_batch(chunks: DataFrame, queries: DataFrame, k: int, threshold: float | None = 0.0, exclude_self: bool = False, block: int = 8192) -> DataFrame:
    """query_id, id, score, rank: the k best chunks (id, embedding) of each query (query_id, query), however many there are.

    Chunks and queries meet block by block, each pair of blocks in one task. Rows without a vector go. A matrix product
    leaves, of each query, the chunks that may be among its k best by the product's greatest error, ties and all; the
    scores of these are summed in the order of vector.cosine, so that scores and ties are the same.
    """
    kinds = dict(chunks.dtypes)["id"], dict(queries.dtypes)["query_id"]
    plain = lambda df, c: (F.col(c) if dict(df.dtypes)[c] == "array<float>" else F.col(c).cast("array<double>")).alias("v")
    right = chunks.where(F.col("embedding").isNotNull()).select("id", plain(chunks, "embedding"))
    left = queries.where(F.col("query").isNotNull()).select("query_id", plain(queries, "query"))
    left, right = _dealt(left, right, "query_id", "id", block)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        b = b.sort_values("id", kind="stable")
        own, other, found = _matrix(a["v"]), _matrix(b["v"]), []
        asked, ids = a["query_id"].to_numpy(), b["id"].to_numpy()
        (x, odd_rows), (y, odd_cols) = _unit(own), _unit(other)
        common = min(x.shape[1], y.shape[1])
        x, y = x[:, :common], y[:, :common].T
        slack = 8 * (common + 4) * np.finfo(float).eps
        most = k + (int(b["id"].value_counts().max() or 0) if exclude_self and b["id"].notna().any() else 0)  # the query's own rows may be among the best
        own, other = ((np.ascontiguousarray(v[0].T), *v[1:]) for v in (own, other))
        alike = len({*own[1].tolist(), *other[1].tolist()}) == 1
        for begin in range(0, len(a), 256):
            rows = slice(begin, begin + 256)
            near = x[rows] @ y
            if not alike:
                near[own[1][rows][:, None] != other[1][None, :]] = 0
            near[:, odd_cols] = -np.inf
            may = near >= (_at_least(near, most) - slack)[:, None]
            may[:, odd_cols] = True
            may[odd_rows[rows]] = True
            row, col = np.nonzero(may)
            row += begin
            score = _pair_cosines(own, other, row, col)
            use = asked[row] != ids[col] if exclude_self else np.ones(len(row), bool)
            use &= True if threshold is None else (score > threshold) | np.isnan(score)
            row, col, score = row[use], col[use], score[use]
            order = np.lexsort((col, -score, ~np.isnan(score), row))  # NaN is the greatest, as in SQL
            row, col, score = row[order], col[order], score[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            found.append(pd.DataFrame({"query_id": asked[row[keep]], "id": ids[col[keep]], "score": score[keep]}))
        return pd.concat(found)

    found = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(meet, f"query_id {kinds[1]}, id {kinds[0]}, score double")
    return top_per(found.withColumn("score", F.coalesce("score", F.lit(math.nan))), k)  # pandas makes NaN null


def overlap_score(tokens: Column, terms: Column) -> Column:
    """Share of the query's terms in the text, damped by the number of its distinct tokens."""
    n = F.greatest(F.size(tokens), F.lit(2))
    shared = F.size(F.array_intersect(tokens, terms)).cast("double") / F.size(terms)
    return F.when(F.size(terms) == 0, 0.0).otherwise(shared / F.log(n + F.lit(1.0)))


def keyword_topk(chunks: DataFrame, terms: Column, k: int = 10, tokens_col: str = "tokens") -> DataFrame:
    return top(chunks.withColumn("score", overlap_score(F.col(tokens_col), terms)).where(F.col("score") > 0), k)


def gated(tokens: Column, terms: Column) -> Column:
    """Whether every term is there; a query without terms matches nothing."""
    return (F.size(terms) > 0) & (F.size(F.array_except(terms, tokens)) == 0)


def hybrid_scores(chunks: DataFrame, query: Sequence[float], terms: Column, *, vector_weight: float = 0.5, keyword_weight: float = 0.5, floor: float = FLOOR, tokens_col: str = "tokens") -> DataFrame:
    """id, vector_score, keyword_score (of gated rows, over the greater of the best and the floor) and score, their blend.

    Texts and vectors are read once: what both scores need of a row is kept as three numbers, and the greatest keyword score
    and the blend come from those.
    """
    if not 0 <= floor <= 1:
        raise ValueError("the floor must lie between 0 and 1")
    raw = F.when(gated(F.col(tokens_col), terms), overlap_score(F.col(tokens_col), terms)).otherwise(0.0)
    rows = cut(vector_scores(chunks, query).select("id", F.col("score").alias("vector_score"), raw.alias("raw_keyword")))
    bounds = rows.agg(F.max("raw_keyword").alias("most"))  # one row
    scale = F.nullif(F.greatest("most", F.lit(float(floor))), F.lit(0.0))
    rows = rows.crossJoin(F.broadcast(bounds)).withColumn("keyword_score", F.coalesce(F.col("raw_keyword") / scale, F.lit(0.0)))
    return rows.withColumn("score", F.lit(float(vector_weight)) * F.col("vector_score") + F.lit(float(keyword_weight)) * F.col("keyword_score")).drop("most", "raw_keyword")


def hybrid_topk(chunks: DataFrame, query: Sequence[float], terms: Column, k: int = 10, threshold: float = 0.0, **options) -> DataFrame:
    """The k best of hybrid_scores() above the threshold; the chunks' other columns can be joined to so few rows."""
    return top(hybrid_scores(chunks, query, terms, **options).where(F.col("score") > threshold), k)


def numbered(rows: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """Adds each row's number, from 1 on, in the order over all rows, without bringing them into one task.

    Rows are sorted over all partitions and kept; a row's number is its place in its partition after the partitions before,
    whose sizes are one small row each.
    """
    part, place = f"__part_{name}", f"__place_{name}"
    kept = cut(rows.orderBy(*order).withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = kept.groupBy(part).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(part, F.coalesce(before, F.lit(0)).alias("__before"))
    return kept.join(F.broadcast(offsets), part).withColumn(name, (F.col("__before") + F.col(place) + 1).cast("int")).drop(part, place, "__before")


def ranked(rows: DataFrame, list_id: int, by: str = "score", most: int | None = None) -> DataFrame:
    """id, list_id and rank of a list of results; of at most `most` rows in one window, else by numbered()."""
    slim = rows.select("id", F.lit(list_id).alias("list_id"), by)
    if most is not None:
        return top(slim, most, by).select("id", "list_id", F.row_number().over(Window.orderBy(F.desc(by), "id")).alias("rank"))
    return numbered(slim, [F.desc(by), "id"], "rank").select("id", "list_id", "rank")


def fuse(lists: Sequence[DataFrame], k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """id, score: reciprocal rank fusion of lists (id, list_id, rank); an item absent from a list gets nothing there."""
    every = reduce(DataFrame.unionByName, [x.select("id", "list_id", "rank") for x in lists])
    once = every.groupBy("id", "list_id").agg(F.min("rank").alias("rank"))
    out = once.groupBy("id").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("score"))
    return out if limit is None else top(out, limit)


def merge_collections(lists: Sequence[DataFrame], k: int) -> DataFrame:
    """Results of several collections as one list, best first; an id in two collections stays twice."""
    return top(reduce(DataFrame.unionByName, lists), k)


def concat_rank(lists: Sequence[DataFrame]) -> DataFrame:
    """Adds position: lists one after the other, each in its own order, not sorted again."""
    named = [x.withColumn("list_no", F.lit(i)) for i, x in enumerate(lists)]
    return numbered(reduce(DataFrame.unionByName, named), ["list_no", F.desc("score"), "id"], "position")


def rerank(rows: DataFrame, scorer: Callable[[DataFrame], Column], *, threshold: float | None = None, top_k: int | None = None, top_k_overrides: bool = False) -> DataFrame:
    """Score anew, then filter and cut. With top_k_overrides, a top_k makes the threshold void; else it comes after it."""
    scored = rows.withColumn("rerank_score", scorer(rows))
    if threshold is not None and not (top_k_overrides and top_k is not None):
        scored = scored.where(F.col("rerank_score") >= threshold)
    return top(scored, top_k, "rerank_score") if top_k is not None else scored.orderBy(F.desc("rerank_score"), "id")


def over_fetched(limit: int, factor: int = 3) -> int:
    return limit * factor


def max_sim(query_vectors: DataFrame, token_vectors: DataFrame, block: int = 8192) -> DataFrame:
    """query_id, id, score: for each of a query's token vectors (query_id, token, query) the best match among a text's vectors
    (id, embedding), added up. Blocks meet as in vector_batch(); a pair of blocks gives the best of each token and text."""
    kinds = {**dict(query_vectors.dtypes), **{f"text_{k}": v for k, v in token_vectors.dtypes}}
    left = query_vectors.where(F.col("query").isNotNull()).select("query_id", "token", F.col("query").cast("array<double>").alias("v"))
    right = token_vectors.where(F.col("embedding").isNotNull()).select("id", F.col("embedding").cast("array<double>").alias("v"))
    left, right = _dealt(left, right, "token", "v", block)

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id", kind="stable")
        own, other, found = _matrix(a["v"]), _matrix(b["v"]), []
        ids, first = np.unique(b["id"].to_numpy(), return_index=True)
        for begin in range(0, len(a), 256) if len(b) else ():
            rows = slice(begin, begin + 256)
            best = np.maximum.reduceat(_cosines(own, other, rows), first, axis=1)
            asked, token = a["query_id"].to_numpy()[rows], a["token"].to_numpy()[rows]
            found.append(pd.DataFrame({"query_id": np.repeat(asked, len(ids)), "token": np.repeat(token, len(ids)), "id": np.tile(ids, len(asked)), "sim": best.ravel()}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "token": [], "id": [], "sim": []})

    schema = f"query_id {kinds['query_id']}, token {kinds['token']}, id {kinds['text_id']}, sim double"
    pairs = left.groupBy("c", "q").cogroup(right.groupBy("c", "q")).applyInPandas(meet, schema)
    best = pairs.groupBy("query_id", "id", "token").agg(F.max("sim").alias("sim"))
    return best.groupBy("query_id", "id").agg(F.sum("sim").alias("score"))


def positional_scores(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Adds positional: the number of rows for the first, one less for each that follows."""
    placed = numbered(rows, order, "__n")
    return placed.crossJoin(F.broadcast(placed.agg(F.count("*").alias("__all")))).withColumn("positional", F.col("__all") - F.col("__n") + 1).drop("__n", "__all")


def first_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == 1).drop("__n")


def accumulate(found: DataFrame, cap: int = 30) -> DataFrame:
    """Chunks of several iterations (id, iteration, position, score): the first of each id, best first, at most cap."""
    return top(first_of(found, ["id"], ["iteration", "position"]), cap)


def by_document(hits: DataFrame) -> DataFrame:
    """document_id, best, n of hits (id, document_id, score), the best document first."""
    return hits.groupBy("document_id").agg(F.max("score").alias("best"), F.count("*").alias("n")).orderBy(F.desc("best"), "document_id")


def prefix_within(rows: DataFrame, size: Column, order: Sequence[Column | str], budget: int, most: int, by: Sequence[str] = ()) -> DataFrame:
    """Of each group (or of all rows, which should then be few) the longest prefix of at most `most` rows whose sizes, two
    more each, stay within the budget."""
    w = Window.partitionBy(*by).orderBy(*order)
    first = rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most)  # the window keeps no more of a group
    run = first.withColumn("__sum", F.sum(size + 2).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where(F.col("__sum") <= budget).drop("__sum", "__n")


def lsh_topk(chunks: DataFrame, query: Sequence[float], k: int, *, tables: int = 8, width: float = 0.8, seed: int = 3) -> DataFrame:
    """Approximate top k by cosine of unit vectors: random-projection buckets first, exact scores for what they hold."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    unit = chunks.where(F.col("embedding").isNotNull()).withColumn("__v", array_to_vector(F.col("embedding").cast("array<double>")))
    model = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", numHashTables=tables, bucketLength=width, seed=seed).fit(unit)
    near = model.approxNearestNeighbors(unit, Vectors.dense(list(map(float, query))), k, distCol="__d")
    return top(vector_scores(near.drop("__v", "__h", "__d"), query), k)

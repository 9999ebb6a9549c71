"""A stated query set against all vectors, block by block.

Vectors and queries are dealt by a hash of their ids to blocks of bounded bytes. Every pair of a query block and a vector
block of one dimension meets once, in a cogroup; each gives its own nearest, and a window over those gives the result. A
vector is copied once for each query block, a query once for each vector block: blocks are as large as a task's memory
allows, and smaller tables are cut into vector blocks, not query blocks, until every core has one.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BlockSearch = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


#: Different vector lengths of a table, the bound of the counts sent to the driver.
MOST_LENGTHS = 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str, *, zero: bool) -> DataFrame:
    """Columns id and v (doubles) of the rows that take part: a non-null id and a non-empty vector of finite components; zero vectors only if asked for."""
    v = F.col("v")
    fit = F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    if not zero:
        fit = fit & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(fit)


def matrix(table: pa.Table, column: str) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = table.column(column).combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)


def block_counts(n: int, q: int, d: int, block_bytes: int, cores: int, least_rows: int = 2048) -> tuple[int, int]:
    """Numbers of vector blocks and of query blocks for n vectors and q queries of d components."""
    rows = max(1, block_bytes // (8 * d))
    queries = max(1, math.ceil(q / rows))
    return max(1, math.ceil(n / rows), min(math.ceil(cores / queries), n // least_rows)), queries


def search(rows: DataFrame, is_query: Column, find: Callable[..., BlockSearch], *, k: int, block_bytes: int, score_type: str) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of the rows but its own id, ties to the smaller id.

    rows has id and v. find() gives the function from (query ids, queries, ids, vectors) to arrays of query ids, ids and
    scores. One small job counts rows and queries of each dimension; only those counts come to the driver. More than
    MOST_LENGTHS dimensions are an error.
    """
    marked = rows.withColumn("d", F.size("v"))
    counts = {r["d"]: (r["n"], r["q"]) for r in marked.groupBy("d").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).limit(MOST_LENGTHS + 1).collect()}
    if len(counts) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} different lengths")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = {d: block_counts(n, q, d, block_bytes, cores) for d, (n, q) in counts.items()}
    schema = f"query_id long, vec_id long, score {score_type}"
    if not blocks:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, vec_id long, score {score_type}")
    sizes = F.create_map(*(F.lit(x) for d, (c, q) in blocks.items() for x in (d, c))), F.create_map(*(F.lit(x) for d, (c, q) in blocks.items() for x in (d, q)))
    # A hash of the vector too: rows that share an id don't share a block.
    key = F.xxhash64("id", "v", F.lit(7))
    n_blocks, n_queries = sizes[0][F.col("d")], sizes[1][F.col("d")]
    vectors = marked.withColumn("b", F.pmod(key, n_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), n_queries - 1)))
    queries = marked.where(is_query).withColumn("qb", F.pmod(key, n_queries).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks.cast("long") - 1)))
    step = find()

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if len(left) and len(right):
            out = step(left.column("id").to_numpy(), matrix(left, "v"), right.column("id").to_numpy(), matrix(right, "v"))
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64() if score_type == "long" else pa.float64())})

    keys = ("d", "b", "qb")
    found = queries.select(*keys, "id", "v").groupBy(*keys).cogroup(vectors.select(*keys, "id", "v").groupBy(*keys)).applyInArrow(one, schema)
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(ids) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= cut)
    else:
        kept = np.arange(len(ids))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]

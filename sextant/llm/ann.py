"""Approximate nearest neighbours by collision-counting hashing.

Every vector has m single-projection hash values, each kept as a sorted array. A query's window of half-width
width * radius around its own value collides with what lies in it; the radius grows by virtual rehashing, no array is
built anew: a window widens to both sides, and only the entries that come in are counted. Vectors whose collisions reach
the threshold are verified: their inner product is computed on the original vectors. The search of a block ends when k
verified vectors lie within the radius; with k of them outside it, the radius becomes the k-th one's distance.

Inner product becomes distance by one more component: with all vectors scaled by the greatest norm, sqrt(1 - |x|^2) for
vectors and 0 for queries.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm import blocks


def threshold(m: int, width: float, deviations: float) -> int:
    """Collisions that a vector at the radius itself reaches but for `deviations` standard deviations."""
    p = math.erf(width / math.sqrt(2))
    return max(1, math.floor(m * p - deviations * math.sqrt(m * p * (1 - p))))


class Arrays:
    """The m sorted arrays of a block: values, and which vector each belongs to."""

    def __init__(self, lifted: np.ndarray, planes: np.ndarray, rng: np.random.Generator, sample: int = 256):
        hashes = np.ascontiguousarray((lifted @ planes).T)
        self.owners = np.argsort(hashes, axis=1, kind="stable")
        self.values = np.take_along_axis(hashes, self.owners, axis=1)
        self.m, self.n = hashes.shape
        self.sample = hashes[:, rng.choice(self.n, min(self.n, sample), replace=False)]

    def first_radius(self, centres: np.ndarray, k: int) -> np.ndarray:
        """For each query, the distance of the k-th nearest as the hash values of a sample of the vectors suggest it."""
        squares = (self.sample**2).sum(0) + (centres**2).sum(1)[:, None] - 2 * centres @ self.sample
        at = min(squares.shape[1] - 1, squares.shape[1] * k // self.n)
        return np.maximum(np.sqrt(np.maximum(np.partition(squares, at, axis=1)[:, at], 0) / self.m), 1e-3)

    def places(self, j: int, at: np.ndarray, side: str) -> np.ndarray:
        return self.values[j].searchsorted(at, side)


def search_block(k: int, m: int, width: float, deviations: float, growth: float, seed: int, greatest: float, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores of what is found in a block. greatest: the greatest norm of all vectors of the table."""
    rng = np.random.default_rng(seed)
    planes = rng.standard_normal((vectors.shape[1] + 1, m))
    scaled, asked = vectors / greatest, queries / greatest
    lifted = np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))[:, None]])
    arrays = Arrays(lifted, planes, rng)
    del lifted
    centres = asked @ planes[:-1]
    radii, own = arrays.first_radius(centres, k), (asked**2).sum(1)
    least, n = threshold(m, width, deviations), len(ids)
    low = np.stack([arrays.places(j, centres[:, j], "left") for j in range(m)], 1)  # windows are empty at first
    high = low.copy()
    counts = np.zeros((len(queries), n), np.uint8 if m < 256 else np.uint16)
    seen = query_ids[:, None] == ids[None, :]
    wanted = np.minimum(k, n - seen.sum(1))
    hits: list[list[np.ndarray]] = [[] for _ in queries]
    near: list[list[np.ndarray]] = [[] for _ in queries]
    active = np.flatnonzero(wanted > 0)
    while len(active):
        reach = width * radii[active]
        new_low = np.stack([arrays.places(j, centres[active, j] - reach, "left") for j in range(m)], 1)
        new_high = np.stack([arrays.places(j, centres[active, j] + reach, "right") for j in range(m)], 1)
        going = []
        for a, q in enumerate(active):
            edges = zip(new_low[a].tolist(), low[q].tolist(), high[q].tolist(), new_high[a].tolist(), strict=True)
            entries = [part for j, (b0, b1, c0, c1) in enumerate(edges) for part in (arrays.owners[j, b0:b1], arrays.owners[j, c0:c1])]
            counts[q] += np.bincount(np.concatenate(entries), minlength=n).astype(counts.dtype)
            fresh = np.flatnonzero((counts[q] >= least) & ~seen[q])
            seen[q, fresh] = True
            hits[q].append(fresh)
            near[q].append(own[q] + 1 - 2 * (scaled[fresh] @ asked[q]))  # squared distances
            known = np.concatenate(near[q])
            if len(known) < wanted[q]:
                radii[q] *= growth
                going.append(q)
            elif (last := np.partition(known, wanted[q] - 1)[wanted[q] - 1]) > radii[q] ** 2 and not seen[q].all():
                radii[q] = math.sqrt(last) * (1 + 1e-9)  # what lies nearer than the k-th so far collides often enough there
                going.append(q)
        low[active], high[active] = new_low, new_high
        active = np.array(going, np.int64)
    out: tuple[list, list, list] = ([], [], [])
    for q in np.flatnonzero(wanted > 0):
        found = np.concatenate(hits[q])
        with np.errstate(over="ignore", invalid="ignore"):
            scores = np.nan_to_num(vectors[found] @ queries[q], nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        top = blocks.best(ids[found], scores, k)
        out[0].append(np.full(len(top), query_ids[q]))
        out[1].append(ids[found[top]])
        out[2].append(scores[top])
    return tuple(np.concatenate([np.zeros(0, t), *x]) for x, t in zip(out, (np.int64, np.int64, np.float64)))


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, m: int = 64, width: float = 0.8, deviations: float = 1.25, growth: float = 1.25, seed: int = 11, block_bytes: int = 8 << 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each query, the k greatest inner products found.

    is_query is a condition on the column id. Every row is indexed and no candidate is cut off: whatever reaches the
    threshold is verified. Vectors that are null, empty, zero or hold null or non-finite components, and null ids, take
    no part; candidates are the rows of the query's dimension with another id, repeated rows each. Fewer than k: all.
    Ties: the smaller id. A sum that overflows is infinite, one of two infinities counts as the least. An empty table
    gives an empty one; other columns are ignored.
    """
    rows = blocks.usable(vectors, id_col, vector_col, zero=False)
    # A norm by its greatest component, as squares may overflow.
    most = F.array_max(F.transform("v", F.abs))
    norm = rows.select(most.alias("most"), "v").select((F.col("most") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("most")) * (x / F.col("most"))))).alias("norm"))
    greatest = norm.agg(F.max("norm")).first()[0]
    return blocks.search(rows, is_query, lambda: partial(search_block_in_parts, k, m, width, deviations, growth, seed, min(greatest or 1.0, 1e308)), k=k, block_bytes=block_bytes, score_type="double")


def search_block_in_parts(*args, part: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """search_block() for `part` queries at a time, which bounds the counters."""
    *options, query_ids, queries, ids, vectors = args
    found = [search_block(*options, query_ids[i : i + part], queries[i : i + part], ids, vectors) for i in range(0, len(query_ids), part)]
    return tuple(np.concatenate(x) for x in zip(*found))

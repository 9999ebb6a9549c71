"""Vector functions as column expressions, in double precision."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different lengths or a zero vector, null for a null one."""
    scale = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (scale == 0), 0.0).otherwise(dot(a, b) / scale)


def cosine_to(a: Column, query: list[float]) -> Column:
    """cosine() with a vector that is known here: its norm is computed once, and a row's sums come from one pass over it."""
    q = [float(x) for x in query]
    scale = math.sqrt(sum(x * x for x in q))
    literal = F.array(*map(F.lit, q))
    both = F.aggregate(
        F.zip_with(a, literal, lambda x, y: F.struct(x.cast("double").alias("x"), y.alias("y"))),
        F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx")),
        lambda s, p: F.struct((s["xy"] + p["x"] * p["y"]).alias("xy"), (s["xx"] + p["x"] * p["x"]).alias("xx")),
        lambda s: F.coalesce(s["xy"] / F.nullif(F.sqrt(s["xx"]) * scale, F.lit(0.0)), F.lit(0.0)),
    )
    return F.when(a.isNull(), None).when(F.size(a) != len(q), 0.0).otherwise(both)


def normalized(a: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    return F.transform(a, lambda x: F.when(norm(a) > 0, x.cast("double") / norm(a)).otherwise(x.cast("double")))


def hash_embedding(words: Column, dimensions: int = 384) -> Column:
    """A deterministic stand-in for a trained embedder: each word adds 0.5, 0.3 and 0.2 at three places given by its crc32,
    and the sum has unit length."""
    def place(factor: int, weight: float) -> Column:
        return F.transform(words, lambda w: F.struct(F.pmod(F.crc32(w.cast("binary")) * factor, F.lit(dimensions)).alias("p"), F.lit(weight).alias("w")))

    hits = F.concat(place(1, 0.5), place(7, 0.3), place(13, 0.2))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.aggregate(hits, F.lit(0.0), lambda s, h: s + F.when(h["p"] == i, h["w"]).otherwise(0.0)))
    return F.transform(F.array(vector), normalized)[0]

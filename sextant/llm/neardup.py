"""Near-duplicate documents by one-permutation MinHash.

1. Each text's set of word shingles gets a signature (one permutation, optimal densification) and one bucket key a band.
   Texts with equal sets are one class; only its smallest id goes on.
2. In each bucket, the smallest id is the centre of a star: one candidate edge a member, whatever the bucket's size.
3. Candidate edges are confirmed on the full sets; links give components in a logarithmic number of rounds.
4. A bucket whose members still lie in several components may hold a link that its star didn't test. There, members of
   different components are compared by sketches, inside the join; the few pairs that can reach the similarity are
   confirmed as before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import Scratch, map_rows
from sextant.llm.shingles import OnePermutation, set_hash, shingle_sets
from sextant.operators.components import connected

BANDS, ROWS, PERCENT = 50, 6, 75
ODD_BITS = 2048
_STEP = 1 << 20  # bytes of text hashed at a time


def _sets(batch: pa.RecordBatch):
    """(place, set) of each row of a batch."""
    texts = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
    i = 0
    while i < len(texts):
        j, held = i, 0
        while j < len(texts) and (j == i or held + len(texts[j]) <= _STEP):
            held += len(texts[j])
            j += 1
        yield from enumerate(shingle_sets(texts[i:j]), i)
        i = j


def _sketch(values: np.ndarray) -> np.ndarray:
    """Two bits of each value, 32 values in a 64-bit integer."""
    two = np.zeros(-(-len(values) // 32) * 32, np.uint64)
    two[: len(values)] = (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(62)
    with np.errstate(over="ignore"):
        return (two.reshape(-1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(1, dtype=np.uint64).astype(np.int64)


def _odd_sketch(own: np.ndarray) -> np.ndarray:
    """One bit a hash bucket: whether an odd number of the set's shingles falls there. The bits in which two sets differ
    are at most as many as the shingles that only one of them has."""
    odd = np.bincount((own >> np.uint64(20)).astype(np.int64) & (ODD_BITS - 1), minlength=ODD_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """id, n, h1, h2 (the set's name), keys (one a band) and sketch of each row of (id, text)."""

    def make():
        permutation = OnePermutation(bands, rows)

        def step(batch):
            out: dict = {k: [] for k in ("n", "h1", "h2")}
            keys, sketches, sizes = [], [], []
            for _, own in _sets(batch):
                h1, h2 = set_hash(own)
                out["n"].append(len(own))
                out["h1"].append(h1)
                out["h2"].append(h2)
                sizes.append(len(own) > 0)
                if len(own):
                    values = permutation.signature(own)
                    keys.append(permutation.keys_of(values))
                    sketches.append(np.concatenate([_sketch(values), _odd_sketch(own)]))
            at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            none = np.zeros((0, 1), np.int64)
            for name, rows_ in (("keys", keys), ("sketch", sketches)):
                flat = np.stack(rows_) if rows_ else none
                out[name] = pa.ListArray.from_arrays(pa.array(at * flat.shape[1], pa.int32()), pa.array(flat.astype(np.int64).ravel(), pa.int64()))
            return {"id": batch.column("id")} | out

        return step

    return map_rows(docs, "id long, n long, h1 long, h2 long, keys array<long>, sketch array<long>", make)


def full_sets(docs: DataFrame) -> DataFrame:
    """id and the whole shingle set of each row of (id, text)."""

    def make():
        def step(batch):
            sets = [own for _, own in _sets(batch)]
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).astype(np.int64)
            return {"id": batch.column("id"), "shingles": pa.ListArray.from_arrays(pa.array(at), pa.array(flat))}

        return step

    return map_rows(docs, "id long, shingles array<long>", make)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' intersection is at least percent of their union."""
    left, right = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    sized = both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    return sized.where(100 * F.col("common") >= percent * (F.col("sizes") - F.col("common"))).select("a", "b")


def _can_reach(values: int, percent: int, words: int) -> Column:
    """Whether two rows x and y can reach the similarity by their sizes and sketches.

    At the similarity, the shingles that only one set has are at most (100 - percent) / (100 + percent) of both sizes; the
    odd sketches, the last words, never differ in more bits, so they lose nothing. They saturate with large sets. There
    the two-bit values of the signatures tell: with similarity s they differ with probability 3/4 (1 - s), and six
    standard deviations more are let pass. Like the bands, this half of the test can lose a link: of 10,000 planted pairs
    between 0.75 and 0.80 it loses none (tests), where the bands lose one in 18,000.
    """
    both = [F.col("x.sketch")[i].bitwiseXOR(F.col("y.sketch")[i]) for i in range(words + ODD_BITS // 64)]
    differ = sum((F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555))) for z in both[1:words]), F.bit_count(both[0].bitwiseOR(F.shiftrightunsigned(both[0], 1)).bitwiseAND(F.lit(0x5555555555555555))))
    odd = sum((F.bit_count(z) for z in both[words + 1 :]), F.bit_count(both[words]))
    near = odd * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)
    p = 0.75 * (1 - percent / 100)
    independent = F.least(F.lit(float(values)), 0.5 * F.least("x.n", "y.n"))
    most = values * (p + 6 * F.sqrt(F.lit(p * (1 - p)) / independent))
    sizes = (100 * F.least("x.n", "y.n")) >= (percent * F.greatest("x.n", "y.n"))
    return sizes & near & (differ <= most)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT) -> DataFrame:
    """One row for each input row: id, n_shingles, component_id, kept.

    Two documents link if their sets' intersection is at least percent of the union; a component is what links join, its
    id the smallest in it, and only the document of that id is kept. A null text or one without words has no shingles,
    links with nothing and is kept. A text of fewer than five words is one shingle. Rows that share an id are one
    document with several texts; a null id links with nothing, has no component and is kept. An empty table gives an
    empty one; other columns are ignored. A link at the very similarity has 50 bands of 6 rows to be found by: it is
    missed once in 18,000 times, one of 0.8 once in four million.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    signed = scratch.written(signatures(plain, bands, rows), "signatures")
    own = signed.where("n > 0 and id is not null")
    classes = scratch.written(own.groupBy("h1", "h2").agg(F.min("id").alias("id")), "classes")
    chosen = scratch.written(own.select("id", "n", "keys", "sketch").join(classes.select("id").distinct(), "id", "left_semi"), "chosen")
    dealt = chosen.select("id", F.explode("keys").alias("key"))
    centres = scratch.written(dealt.groupBy("key").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre != last").select("key", "centre"), "centres")
    members = scratch.written(dealt.join(centres, "key"), "members")
    sets = scratch.written(full_sets(plain.join(members.select("id").distinct(), "id", "left_semi")), "sets")
    star = members.where("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = scratch.written(confirmed(star, sets, percent), "links")
    found = connected(links, scratch.written)

    labelled = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    labelled = scratch.written(labelled, "labelled")
    mixed = scratch.written(labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key"), "mixed")
    rest = labelled.join(mixed, "key", "left_semi").join(chosen.select("id", "n", "sketch"), "id")
    rest = scratch.written(rest, "rest")
    words = -(-bands * rows // 32)
    untested = (F.col("x.id") < F.col("y.id")) & (F.col("x.id") != F.col("x.centre")) & (F.col("x.component") != F.col("y.component"))
    across = rest.alias("x").join(rest.alias("y"), (F.col("x.key") == F.col("y.key")) & untested & _can_reach(bands * rows, percent, words))
    across = scratch.written(across.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "across")
    more = scratch.written(confirmed(across, sets, percent), "links")
    if not more.isEmpty():
        found = connected(links.union(more), scratch.written)

    by_set = scratch.written(classes.join(found, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component")), "by_set")
    scratch.drop("signatures", "by_set")
    out = signed.select("id", "n", "h1", "h2").join(by_set, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

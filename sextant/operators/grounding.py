"""How well answers rest on their sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators.retrieval import prefix_within
from sextant.plans.storage import cut


def attribution(spans: DataFrame, chunks: DataFrame, min_score: float = 0.3) -> DataFrame:
    """span_id, chunk_id, score: the share of a span's distinct words that a chunk holds, at least min_score.

    A chunk that holds c of a span's n words holds t of any n - c + t of them. Spans and chunks meet by so many of the span's
    rarest words, with t half of c, so that its most frequent ones bring nothing together; pairs that share t are then
    compared in full.
    """
    words = cut(chunks.select("chunk_id", T.word_set(F.col("text")).alias("words")))
    span_words = cut(spans.select("span_id", T.word_set(F.col("text")).alias("w"))).where(F.size("w") > 0)
    asked = span_words.select("span_id", F.explode("w").alias("word"))
    counts = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    rarest = asked.join(counts, "word").groupBy("span_id").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("known"))
    needed = F.greatest(F.lit(1), F.ceil(F.size("w") * F.lit(float(min_score)) - 1e-9)).cast("int")
    least = F.greatest(F.lit(1), F.floor(needed / 2)).cast("int")
    # Words that no chunk holds come first in the order of rarity; they need no join.
    prefix = F.size("known") - needed + least
    few = span_words.join(rarest, "span_id").where(prefix > 0).select("span_id", least.alias("least"), F.explode(F.slice("known", F.lit(1), prefix)).alias("k")).select("span_id", "least", F.col("k.word").alias("word"))
    met = words.select("chunk_id", F.explode("words").alias("word")).join(few, "word").groupBy("span_id", "chunk_id").agg(F.count("*").alias("n"), F.first("least").alias("least"))
    met = met.where("n >= least").select("span_id", "chunk_id")
    both = met.join(span_words, "span_id").join(words, "chunk_id")
    scored = both.select("span_id", "chunk_id", (F.size(F.array_intersect("w", "words")) / F.size("w")).alias("score"))
    return scored.where(F.col("score") >= min_score)


def weighted_score(sentences: DataFrame, group: str = "answer_id") -> DataFrame:
    """Per answer: the mean of its sentences' scores, weighted by bytes; 1 if they have none."""
    size = F.octet_length("text")
    ratio = F.sum(size * F.col("score")) / F.nullif(F.sum(size), F.lit(0))
    return sentences.groupBy(group).agg(F.coalesce(ratio, F.lit(1.0)).alias("score"))


def best_per_sentence(scores: DataFrame) -> DataFrame:
    return scores.groupBy("sentence_id").agg(F.max("score").alias("score"))


def judged_score(claims: DataFrame, group: str = "answer_id") -> DataFrame:
    """The share of claims that a judge found supported."""
    return claims.groupBy(group).agg(F.avg(F.col("supported").cast("double")).alias("score"))


def premise_chunks(chunks: DataFrame, budget: int = 5000, most: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """The first chunks by position whose bytes fit the budget, of each group or of all."""
    return prefix_within(chunks, F.octet_length("text"), ["position"], budget, most, by)


def premise(chunks: DataFrame, by: Sequence[str] = (), budget: int = 5000, most: int = 10) -> DataFrame:
    """The texts of premise_chunks(), a line each, by position: one row, or one for each group."""
    listed = F.array_sort(F.collect_list(F.struct("position", "text")))
    return premise_chunks(chunks, budget, most, by).groupBy(*by).agg(F.array_join(F.transform(listed, lambda s: s["text"]), "\n").alias("premise"))


def split_spans(sentences: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds verdict: faithful from the threshold on, else hallucinated."""
    verdict: Column = F.when(F.col("score") >= threshold, "faithful").otherwise("hallucinated")
    return sentences.withColumn("verdict", verdict)


def enriched(sources: DataFrame, searches: DataFrame) -> DataFrame:
    """Sources (chunk_id) with the first search (iteration, query, chunk_id) that returned them."""
    first = searches.groupBy("chunk_id").agg(F.min("iteration").alias("iteration"), F.min_by("query", F.struct("iteration", "query")).alias("query"))
    return sources.join(first, "chunk_id", "left")

"""The registered queries of this subpackage: one a numbered operator, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import ann, archive, bpe, langid, langmodel, neardup, packing, pii, secrets, sql, topk
from sextant.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PII_KEY = "sextant-demonstration-key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY)
    of = lambda kind: F.filter("found", lambda x: x["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return done.select("doc_id", "text", *counts)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.findings(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), with_ids=False, with_text=False)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = langmodel.score(table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 7) != 2)
    return scored.withColumn("held_out", crc_mod(F.col("doc_id"), 7) == 2).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    found = langid.identify(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_secrets": op2_secrets,
        "op3_ann": op3_ann,
        "op4_warc": op4_warc,
        "op5_neardup": op5_neardup,
        "op6_bpe": op6_bpe,
        "op7_packing": op7_packing,
        "op8_lm": op8_lm,
        "op9_topk": op9_topk,
        "op10_langid": op10_langid,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()

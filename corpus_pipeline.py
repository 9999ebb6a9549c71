"""From raw documents to packed training sequences.

STAGES, in order: language ID (documents that it rejects go), MinHash near-duplicates (of each group the document of the
smallest id stays), secret scans (secrets are replaced by a mark, no document goes), packing. All but the last return
the columns of documents. Part of the subpackage of training-data operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm import langid, neardup, packing, secrets
from sextant.llm.common import written


#: Words whose ids a packing worker remembers: fewer than packing's own default, as its memory lies beside what the stages
#: before have made the executor's heap grow to. Ids are the same.
CACHED_WORDS = 100_000


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is recognized, all columns as they are.

    Null and empty texts, texts without a letter and those with next to no margin go; very long texts are read whole. The
    model is fitted on a bounded sample of the labelled rows. Repeated rows are judged each; ties of languages go to
    the first by name. Without a labelled row nothing can be recognized and every row goes; an empty table stays empty.
    """
    model = langid.fit(docs)
    rest = tuple(c for c in docs.columns if c != "doc_id")
    # The operator's own columns come first: its names may be among those of docs.
    found = langid.identify(docs.toDF(*_numbered(docs)), model, id_col=_name(docs, "doc_id"), text_col=_name(docs, "text"), keep=tuple(_name(docs, c) for c in rest))
    return found.where(~F.col("rejected")).select(*_numbered(docs)).toDF(*docs.columns)


def _numbered(docs: DataFrame) -> list[str]:
    """Names for the columns of docs that no operator uses."""
    return [f"column_{i}_of_documents" for i in range(len(docs.columns))]


def _name(docs: DataFrame, column: str) -> str:
    return _numbered(docs)[docs.columns.index(column)]


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the rows of the smallest id, all columns as they are.

    Null and empty texts and texts without words have no duplicates and stay; so do rows with a null id. Rows that share an
    id stay or go together. An empty table stays empty.
    """
    gone = written(neardup.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "near-duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with [SECRET] in the place of each secret of a text; n_chars follows where a text has changed.

    Null and empty texts and texts without a secret stay as they are, whatever their n_chars; repeated rows are masked
    each; stretches that overlap are one. An empty table stays empty.
    """
    text, chars = _name(docs, "text"), _name(docs, "n_chars")
    found = secrets.findings(docs.toDF(*_numbered(docs)), text_col=text, spans_col="spans_found")
    changed = F.size("spans_found") > 0
    out = found.withColumn("masked", secrets.redacted(F.col(text), F.col("spans_found")))
    new = {text: F.col("masked"), chars: F.when(changed, F.length("masked").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col(chars))}
    return out.select(*(new.get(c, F.col(c)).alias(c) for c in _numbered(docs))).toDF(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens: packing's own columns, not those of docs.

    A null or empty text is one piece of one id; a long one is cut; repeated rows are packed each. An empty table gives
    no pieces.
    """
    return packing.pack(docs, cached_words=CACHED_WORDS)


STAGES = [
    ("language_id", keep_languages),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack_sequences),
]

#: Compression sizes and tokenizers are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs

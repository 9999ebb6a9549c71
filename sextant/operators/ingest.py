"""Documents to chunks, and the next state of stored tables: upserts, replacement, deletion with what depends on it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sextant.functions import text as T
from sextant.operators.retrieval import first_of

CHUNKS = "chunk_index int, text string, token_count long, start_byte long, end_byte long"


@dataclass(frozen=True)
class Chunking:
    """Sizes in tokens (or characters), of which chars_per_token make one; max_chunk_chars is a budget of bytes."""

    chunk_size: int = 450
    chunk_overlap: int = 50
    size_unit: str = "tokens"
    chars_per_token: int = 4
    max_chunk_chars: int | None = None

    def __post_init__(self) -> None:
        for name in ("chunk_size", "chars_per_token"):
            if not isinstance(getattr(self, name), int) or getattr(self, name) < 1:
                raise ValueError(f"{name} must be a positive integer")
        if not 0 <= self.chunk_overlap <= self.chunk_size:
            raise ValueError("chunk_overlap must lie between 0 and chunk_size")
        if self.size_unit not in ("tokens", "characters"):
            raise ValueError("size_unit must be tokens or characters")
        if self.max_chunk_chars is not None and self.max_chunk_chars < 4:
            raise ValueError("max_chunk_chars must hold one character: 4 bytes or more")

    @property
    def size(self) -> int:
        return self.chunk_size * (self.chars_per_token if self.size_unit == "tokens" else 1)

    @property
    def overlap(self) -> int:
        return self.chunk_overlap * (self.chars_per_token if self.size_unit == "tokens" else 1)


def _pieces(text: str, size: int, separators: Sequence[str] = ("\n\n", "\n", " ")) -> Iterator[str]:
    """The text in pieces of at most size characters, cut at the first separator that helps."""
    if len(text) <= size:
        yield text
    elif not separators:
        yield from (text[i : i + size] for i in range(0, len(text), size))
    else:
        parts = text.split(separators[0])
        for i, part in enumerate(parts):
            yield from _pieces(part + (separators[0] if i < len(parts) - 1 else ""), size, separators[1:])


def _within(text: str, budget: int) -> Iterator[str]:
    """Parts of at most budget bytes; no part begins with a combining mark if it can be helped."""
    import unicodedata

    start = used = 0
    for i, c in enumerate(text):
        n = len(c.encode("utf-8", "replace"))
        if used + n > budget:
            at = i
            while at > start + 1 and unicodedata.combining(text[at]):
                at -= 1
            at = at if not unicodedata.combining(text[at]) else i
            yield text[start:at]
            used, start = sum(len(x.encode("utf-8", "replace")) for x in text[at:i]), at
        used += n
    yield text[start:]


def chunk_text(text: str, how: Chunking = Chunking()) -> list[tuple[int, str, int, int, int]]:
    """(index, text, tokens, start, end) of a text's chunks. Pieces merge greedily up to the size; a chunk begins with the
    last pieces of the one before, up to the overlap. Byte ranges slice the text exactly; blank chunks go."""
    spans, start, length, at = [], 0, 0, 0
    pieces = [p for p in _pieces(text, how.size) if p]
    held: list[int] = []
    for p in pieces:
        if held and length + len(p) > how.size:
            spans.append((start, at))
            while held and (length > how.overlap or length + len(p) > how.size):
                length -= held[0]
                start += held.pop(0)
        held.append(len(p))
        length += len(p)
        at += len(p)
    if held:
        spans.append((start, at))
    out = []
    known, first = 0, 0  # a character and its byte offset; the next chunk is counted from there
    for a, b in spans:
        for part in _within(text[a:b], how.max_chunk_chars) if how.max_chunk_chars else (text[a:b],):
            if a < known:
                first -= len(text[a:known].encode("utf-8", "replace"))
            else:
                first += len(text[known:a].encode("utf-8", "replace"))
            known = a
            if part.strip():
                out.append((len(out), part, max(1, len(part) // how.chars_per_token), first, first + len(part.encode("utf-8", "replace"))))
            a += len(part)
    return out


def chunked(docs: DataFrame, how: Chunking = Chunking(), chunker: Callable[[str], list[tuple]] | None = None) -> DataFrame:
    """document_id and the chunks of every document (id, text); null texts have none."""
    kind = dict(docs.dtypes)["id"]
    split = chunker or (lambda t: chunk_text(t, how))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *c) for i, t in zip(frame["id"], frame["text"], strict=True) if t is not None for c in split(t)]
            yield pd.DataFrame(rows, columns=["document_id", "chunk_index", "text", "token_count", "start_byte", "end_byte"])

    return docs.select("id", "text").mapInPandas(run, f"document_id {kind}, {CHUNKS}")


def windowed(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """document_id, chunk_index, text of fixed windows (id, text), blank ones gone and the rest numbered anew."""
    parts = F.filter(T.fixed_windows(F.col("text"), size, overlap), lambda t: F.trim(t) != "")
    return docs.select(F.col("id").alias("document_id"), F.posexplode(parts).alias("chunk_index", "text"))


def with_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds page_start and page_end: the pages (document_id, number, start, end) of a chunk's first and last byte, the
    last page that begins before it where none holds it."""
    listed = pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "number"))).alias("pages"))

    def page(byte: Column) -> Column:
        inside = F.filter("pages", lambda p: (p["start"] <= byte) & (byte < p["end"]))
        before = F.filter("pages", lambda p: p["start"] <= byte)
        return F.coalesce(F.get(inside, F.lit(0))["number"], F.get(before, F.size(before) - 1)["number"])

    return chunks.join(listed, "document_id", "left").withColumn("page_start", page(F.col("start_byte"))).withColumn("page_end", page(F.greatest(F.col("end_byte") - 1, F.col("start_byte")))).drop("pages")


# --- stored tables ----------------------------------------------------------------------------------------------


def upserted(stored: DataFrame, new: DataFrame, key: Sequence[str], order: Sequence[Column | str] = ()) -> DataFrame:
    """The stored rows with the new ones in place of those of the same key; of several new ones the first in order."""
    fresh = first_of(new, key, order) if order else new.dropDuplicates(list(key))
    return stored.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh.select(*stored.columns))


def latest_per_identity(rows: DataFrame, identity: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row of each identity that comes first in the order; rows without a whole identity all stay."""
    whole = F.lit(True)
    for c in identity:
        whole = whole & F.col(c).isNotNull()
    return first_of(rows.where(whole), identity, order).unionByName(rows.where(~whole))


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    return stored.unionByName(new.dropDuplicates(list(key)).join(stored.select(*key), list(key), "left_anti").select(*stored.columns))


def deleted(tables: dict[str, DataFrame], document_ids: DataFrame) -> dict[str, DataFrame]:
    """Documents and their chunks, gone; what is left of both tables."""
    ids = document_ids.select("document_id").distinct()
    return tables | {k: tables[k].join(ids, "document_id", "left_anti") for k in ("documents", "chunks")}


def cleared(tables: dict[str, DataFrame], collection: str) -> dict[str, DataFrame]:
    gone = tables["documents"].where(F.col("collection") == collection)
    return deleted(tables, gone)


def collections_upserted(stored: DataFrame, name: str, description: str | None) -> DataFrame:
    """With the collection: added if new; its description filled only where it was empty."""
    one = stored.sparkSession.createDataFrame([(name, description)], "name string, new string")
    both = stored.join(one, "name", "full_outer")
    return both.withColumn("description", F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("new"))).drop("new")


def resolved_collections(stored: DataFrame, names: Sequence[str] | None, strict: bool = False) -> list | None:
    """Ids of the names; None for no scope at all. Unknown names match nothing, or are an error if strict."""
    if names is None:
        return None
    rows = {r["name"]: r["id"] for r in stored.where(F.col("name").isin(*names)).select("name", "id").collect()} if names else {}
    if strict and (missing := [n for n in names if n not in rows]):
        raise ValueError(f"unknown collections: {missing}")
    return list(rows.values())


def embedded(chunks: DataFrame, embed: Callable[[Column], Column], *, on_error: str = "abort") -> tuple[DataFrame, DataFrame]:
    """(chunks with embedding, chunks without one). With abort, a missing embedding is an error when rows are read."""
    if on_error not in ("abort", "skip"):
        raise ValueError("on_error must be abort or skip")
    rows = chunks.withColumn("embedding", embed(F.col("text")))
    if on_error == "abort":
        rows = rows.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(F.lit("a chunk has no embedding")).cast("array<double>")).otherwise(F.col("embedding")))
    return rows.where(F.col("embedding").isNotNull()), rows.where(F.col("embedding").isNull())


def to_rechunk() -> Column:
    return (F.col("chunk_count") == 0) | (F.col("status") == "pending")


def duplicates(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once: what stands against a unique index."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def page_of(rows: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


def embed_missing(rows: DataFrame, embed: Callable[[Column], Column], text: Column, *, force: bool = False) -> DataFrame:
    """rows with an embedding where there was none, or everywhere with force: one pass, no paging."""
    new = embed(text)
    return rows.withColumn("embedding", new if force else F.coalesce(F.col("embedding"), new))


def upsert_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """rows (id, embedding) with the embeddings of vectors (id, embedding) in place of theirs."""
    fresh = vectors.dropDuplicates(["id"]).select("id", F.col("embedding").alias("__new"))
    return rows.join(fresh, "id", "left").withColumn("embedding", F.coalesce("__new", "embedding")).drop("__new")

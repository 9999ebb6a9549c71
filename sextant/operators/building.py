"""Knowledge graphs from chunks: extraction through callables that may fail, and building into a store."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import graph as G
from sextant.operators import retrieval as R
from sextant.plans.storage import cut

Entities = Callable[[str], list[dict[str, Any]]]
Relations = Callable[[str, list[dict[str, Any]]], list[dict[str, Any]]]

FOUND = "chunk_id long, entities array<struct<name:string,type:string,description:string>>, relations array<struct<source:string,target:string,type:string,description:string,strength:int>>, error string"


def extracted(chunks: DataFrame, entities: Entities, relations: Relations | None = None) -> DataFrame:
    """chunk_id, entities, relations, error of every chunk (id, text).

    A chunk whose entities can't be had has none, and the error; one whose relations can't be had keeps its entities. A
    relation between names that the chunk doesn't have goes.
    """
    def one(text: str) -> tuple[list, list, str | None]:
        try:
            found = [e for e in entities(text) if str(e.get("name") or "").strip()]
        except Exception as e:  # noqa: BLE001  the other chunks go on
            return [], [], f"entities: {e}"
        rows = [(str(e["name"]), e.get("type") or "other", e.get("description")) for e in found]
        try:
            said = relations(text, found) if relations and found else []
            names = {r[0] for r in rows}
            links = [(r["source"], r["target"], r.get("type") or "RELATED_TO", r.get("description"), r.get("strength")) for r in said if r.get("source") in names and r.get("target") in names]
        except Exception as e:  # noqa: BLE001
            return rows, [], f"relations: {e}"
        return rows, links, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *one(t or "")) for i, t in zip(frame["id"], frame["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["chunk_id", "entities", "relations", "error"])

    return chunks.select(F.col("id").cast("long").alias("id"), "text").mapInPandas(run, FOUND)


def tables_of(found: DataFrame) -> dict[str, DataFrame]:
    """entities (name, type, description, one a normalized name), mentions (name, chunk_id) and relations (source, target, ...)."""
    named = found.select("chunk_id", F.inline("entities"))
    return {
        "entities": G.distinct_entities(named, ["chunk_id", "name"]).select("name", "type", "description"),
        "mentions": named.select("name", "chunk_id").distinct(),
        "relations": R.first_of(found.select("chunk_id", F.inline("relations")), ["source", "target", "type"], ["chunk_id"]).drop("chunk_id"),
    }


def build(store: Any, collection: str, chunks: DataFrame, entities: Entities, relations: Relations | None = None, *, resume: bool = True) -> dict[str, int]:
    """Extract from the chunks and add to the store; with resume, chunks that a mention names already are left out.

    Gives the numbers of chunks read and of chunks that failed. Running it again after a failure goes on where it stopped.
    """
    todo = G.unprocessed(chunks, store.tables()["mentions"]) if resume else chunks
    found = cut(extracted(todo, entities, relations))  # extractors are asked once
    tables = tables_of(found)
    ids = cut(store.persist_entities(collection, tables["entities"]))
    store.persist_relationships(tables["relations"], ids)
    store.persist_mentions(tables["mentions"], ids)  # last: a chunk counts as processed when all of it is there
    counts = found.agg(F.count("*").alias("chunks"), F.count("error").alias("failed")).first()
    return {"chunks": counts["chunks"], "failed": counts["failed"]}

"""Plug points: what can be given as a callable, an object with a method, a (factory, options) pair, or left out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class Embedder(Protocol):
    """Text column to vector column."""

    dimensions: int

    def embed(self, text: Column) -> Column: ...


@runtime_checkable
class Chunker(Protocol):
    def chunk(self, documents: DataFrame) -> DataFrame: ...


@runtime_checkable
class Parser(Protocol):
    def parse(self, content: bytes) -> str: ...


@runtime_checkable
class Reranker(Protocol):
    def rerank(self, question: str, chunks: DataFrame) -> DataFrame: ...


@runtime_checkable
class EntityMatcher(Protocol):
    def match(self, question: str, entities: DataFrame) -> DataFrame: ...


@runtime_checkable
class CommunityDetector(Protocol):
    def detect(self, entities: DataFrame, relationships: DataFrame) -> DataFrame: ...


@runtime_checkable
class Grounder(Protocol):
    def ground(self, answer: str, chunks: DataFrame) -> DataFrame: ...


class VectorStore(Protocol):
    def store(self, chunks: DataFrame) -> None: ...

    def search(self, query: list[float], k: int, **options: Any) -> DataFrame: ...

    def search_text(self, query: str, k: int, **options: Any) -> DataFrame: ...

    def delete(self, ids: DataFrame) -> None: ...

    def clear(self, collection: str) -> None: ...


class GraphStore(Protocol):
    """What sources.graph_store.ParquetGraph offers; another store needs the same."""

    def persist_entities(self, collection: str, rows: DataFrame) -> DataFrame: ...

    def persist_relationships(self, rows: DataFrame, ids: DataFrame) -> None: ...

    def persist_mentions(self, rows: DataFrame, ids: DataFrame) -> None: ...

    def persist_communities(self, collection: str, rows: DataFrame) -> None: ...

    def search(self, names: list[str], depth: int) -> DataFrame: ...

    def search_by_embedding(self, query: list[float]) -> DataFrame: ...

    def related(self, start: DataFrame, depth: int) -> DataFrame: ...

    def delete_by_chunks(self, chunk_ids: DataFrame) -> None: ...

    def delete_by_collection(self, collection: str) -> None: ...

    def sweep(self, collection: str | None) -> None: ...


#: A language model: prompt to answer.
LanguageModel = Callable[[str], str]


@dataclass(frozen=True)
class Missing:
    """What a plug point without an implementation raises when it is used."""

    what: str

    def __call__(self, *args: Any, **options: Any) -> Any:
        raise RuntimeError(f"no {self.what} is configured")


def resolve(value: Any, method: str, default: Callable | None = None, shortcuts: dict[str, Callable] | None = None) -> Callable | None:
    """A callable from what was configured: None gives the default, False turns the plug point off, a name one of the
    shortcuts, a pair (factory, options) an object made with options, an object its method, a callable itself."""
    if value is False:
        return None
    if value is None:
        return default
    if isinstance(value, str):
        if not shortcuts or value not in shortcuts:
            raise ValueError(f"unknown name {value!r}; known: {sorted(shortcuts or {})}")
        return shortcuts[value]
    if isinstance(value, tuple):
        factory, options = value
        return resolve(factory(**options), method)
    if hasattr(value, method):
        return getattr(value, method)
    if callable(value):
        return value
    raise TypeError(f"{value!r} is neither callable nor has a method {method}")


def layered(*options: dict[str, Any] | None) -> dict[str, Any]:
    """Options from the weakest to the strongest; None doesn't override."""
    out: dict[str, Any] = {}
    for layer in options:
        out |= {k: v for k, v in (layer or {}).items() if v is not None}
    return out


def redacted(config: Any, secret: tuple[str, ...] = ("key", "token", "secret", "password")) -> Any:
    """A configuration for display, without the values of secret keys."""
    if isinstance(config, dict):
        return {k: "[redacted]" if any(s in str(k).lower() for s in secret) else redacted(v, secret) for k, v in config.items()}
    if isinstance(config, (list, tuple)):
        return type(config)(redacted(v, secret) for v in config)
    return config

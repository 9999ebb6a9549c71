"""Spans around operations: start, stop and exception events with durations, to a logger or to handlers."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Observation

log = logging.getLogger("sextant")
Handler = Callable[[str, dict[str, Any]], None]
_handlers: list[Handler] = []


def attach(handler: Handler) -> None:
    _handlers.append(handler)


def detach(handler: Handler) -> None:
    _handlers.remove(handler)


def _emit(event: str, data: dict[str, Any]) -> None:
    log.debug("%s %s", event, data)
    for handler in list(_handlers):
        try:
            handler(event, data)
        except Exception:  # noqa: BLE001  a broken handler doesn't break what it watches
            log.exception("a telemetry handler failed on %s", event)


@contextmanager
def span(name: str, **meta: Any) -> Iterator[dict[str, Any]]:
    """Measure a block; what is put into the yielded dict goes with its stop event."""
    began, result = time.monotonic(), {}
    _emit(f"{name}.start", dict(meta))
    try:
        yield result
    except Exception as e:
        _emit(f"{name}.exception", {**meta, "seconds": time.monotonic() - began, "error": repr(e)})
        raise
    _emit(f"{name}.stop", {**meta, **result, "seconds": time.monotonic() - began})


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df with aggregates that Spark gathers as the plan runs, at no extra pass."""
    observation = Observation()
    return df.observe(observation, *(c.alias(n) for n, c in metrics.items())), observation

"""Array functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, start: Column, advance: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str, block: int = 256) -> Column:
    """array<kind> of emit(state, item) for every item; advance(state, item) is the next item's state, start the first's.

    A fold that appends copies what it has so far for every item. Here items are folded in blocks, so that it costs n * block
    and (n / block)**2 copied references: next to nothing up to millions of items.
    """
    empty = F.array().cast(f"array<{kind}>")

    def add(state: Column, item: Column) -> Column:
        return F.struct(advance(state["at"], item).alias("at"), F.concat(state["out"], F.array(emit(state["at"], item).cast(kind))).alias("out"))

    def whole(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) - 1) / block)).cast("int")), lambda b: F.slice(x, b * block + 1, F.lit(block)))

        def across(blocks: Column) -> Column:
            states = F.aggregate(blocks, F.struct(start.alias("at"), F.slice(F.array(start), 2, 1).alias("out")), lambda s, own: F.struct(F.aggregate(own, s["at"], advance).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
            return F.flatten(F.zip_with(blocks, states, lambda own, at: F.aggregate(own, F.struct(at.alias("at"), empty.alias("out")), add, lambda s: s["out"])))

        return let(blocks, across)

    return let(items, whole)

"""Array expressions that take linear time in a row, however long its arrays are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is made once: a lambda's variable isn't computed anew at each mention."""
    return F.transform(F.array(value), use)[0]


def scan(items: Column, state: Column, step: Callable[[Column, Column], Column], out: str, kind: str, block: int = 256) -> Column:
    """The state after all items, as F.aggregate() gives it, where `step` returns the state's fields and what it emits, an
    array, as the field `out` (of SQL type `kind`). All that was emitted is the array `out` of the result.

    Growing an array copies it, so that a plain fold is quadratic in what it emits. Here items come in blocks: what a block
    emits is copied within the block only, and the blocks' arrays are put together once, at the end.
    """
    none = F.array().cast(kind)

    def of_block(z: Column, part: Column) -> Column:
        merged = lambda y, x: let(step(y["s"], x), lambda n: F.struct(n["s"].alias("s"), F.when(F.size(n[out]) > 0, F.concat(y[out], n[out])).otherwise(y[out]).alias(out)))
        return F.aggregate(part, F.struct(z["s"].alias("s"), none.alias(out)), merged)

    def blocks(items: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int")), lambda i: F.slice(items, i * block + 1, block))
        start = F.struct(state.alias("s"), F.array().cast(f"array<{kind}>").alias(out))
        joined = lambda z, part: let(of_block(z, part), lambda n: F.struct(n["s"].alias("s"), F.concat(z[out], F.array(n[out])).alias(out)))
        done = F.aggregate(parts, start, joined, lambda z: F.struct(z["s"].alias("s"), F.flatten(z[out]).alias(out)))
        return F.when(F.size(items) > 0, done).otherwise(F.struct(state.alias("s"), none.alias(out)))

    return let(items, blocks)

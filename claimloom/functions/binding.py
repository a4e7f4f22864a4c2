"""Values that an expression names more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pinned(number: Column) -> Column:
    """A whole number, computed in the projection that names it and nowhere else.

    Spark moves filters before a projection and writes the expression out in them, so that it is computed twice; it doesn't where the
    projection isn't deterministic by its form. The term added is zero: row ids are never negative.
    """
    return number + F.shiftright(F.monotonically_increasing_id(), 63).cast("int")


def lookup(table: dict, key: Column) -> Column:
    """The table's value for a key, null if it has none. The table is one literal once the plan is optimised."""
    pairs = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in table.items())), F.lit("\x01"), F.lit("\x02"))
    found = F.try_element_at(pairs, key)
    kind = type(next(iter(table.values())))
    return found if kind is str else found.cast("int" if kind is int else "double")

"""Column helpers: half-up rounding, dictionary lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds halves towards plus infinity, on the double as it is."""
    return F.floor(x * F.lit(float(10**digits)) + F.lit(0.5)) / F.lit(float(10**digits))


def lookup(key: Column, table: Mapping[str, object]) -> Column:
    """The table's value for a key, null for any other; one literal map that codegen evaluates."""
    if not table:
        return F.lit(None)
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def sum_in_order(order: str, value: Column) -> Column:
    """Aggregate: a double sum by rising ``order``, so that a total at a limit doesn't depend on how its rows met. Values aren't null."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["v"])

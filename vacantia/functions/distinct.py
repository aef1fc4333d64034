"""Work done once for each distinct value of a column, and joined back."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators.tables import stored

VALUE = "_value"


def by_value(rows: DataFrame, column: str, derive: Callable[[DataFrame], DataFrame], values: DataFrame | None = None) -> DataFrame:
    """`rows` with the columns that `derive` adds to a table of the distinct values of `column`, named VALUE.

    Values are aggregated before the shuffle, and what is derived of them is written: what stands behind `rows` is planned
    once for the values and once for the rows, however often results are joined on. The join is Spark's to choose: a small
    table is broadcast, as its size is known, a large one is joined by the value, where hot values are split. Null is a
    value too. `values`, if given, is a table whose only column holds all values that may occur.
    """
    source = rows.select(F.col(column).alias(VALUE)) if values is None else values.toDF(VALUE)
    return rows.join(stored(derive(source.distinct())), F.col(column).eqNullSafe(F.col(VALUE)), "left").drop(VALUE)


def by_values(rows: DataFrame, columns: list[str], derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same for distinct combinations of several columns: `derive` keeps them and adds to them.

    Combinations are written before they are read, as `derive` may read them several times.
    """
    made = stored(derive(stored(rows.select(*columns).distinct())))
    renamed = made.withColumnsRenamed({c: f"_of{c}" for c in columns})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in columns])
    return rows.join(renamed, same, "left").drop(*(f"_of{c}" for c in columns))

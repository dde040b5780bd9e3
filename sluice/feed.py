"""``Feed``: a DataFrame plus the ordering that the item list implies.

Items in the reference form an ordered list: limit keeps the first n,
dedupe keeps the first, sorts are stable and merge concatenates inputs in
connection order. DataFrames have no order, so a Feed carries an
``ordering`` -- a list of (hidden) sort columns -- that is only applied
where order is observable (limit, dedupe, single-document outputs). Every
sort prepends its key, which makes it stable for free; nothing is sorted
eagerly.

Hidden columns start with ``__`` and are dropped by ``items()``.
Non-object items (JSON scalars in a list) are flagged ``__obj = false``
and carry their value in ``__value``.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = "__"
OBJ = "__obj"
VALUE = "__value"

_counter = itertools.count()


def fresh(prefix: str) -> str:
    """A new hidden column name, unique within the process."""
    return f"{HIDDEN}{prefix}{next(_counter)}"


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


class FieldCaseError(ValueError):
    """Item fields that differ only by case need a case-sensitive session."""


def check_case(spark, names) -> None:
    """Field names are exact. Spark resolves columns without regard to case
    unless told otherwise; then two such fields would be mixed up, so this
    fails instead."""
    seen: dict[str, str] = {}
    for n in names:
        other = seen.setdefault(n.lower(), n)
        if other != n and spark.conf.get("spark.sql.caseSensitive", "false") != "true":
            raise FieldCaseError(f"fields {other!r} and {n!r} differ only by case: set spark.sql.caseSensitive=true")


@dataclass(frozen=True)
class OrderKey:
    name: str
    descending: bool = False
    nulls_first: bool = False

    def column(self) -> Column:
        c = col(self.name)
        if self.descending:
            return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()
        return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()


@dataclass
class Feed:
    df: DataFrame
    ordering: list[OrderKey] = field(default_factory=list)

    # -- structure -------------------------------------------------------
    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def item_columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    @property
    def hidden_columns(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(HIDDEN)]

    @property
    def has_non_objects(self) -> bool:
        return OBJ in self.df.columns

    def is_object(self) -> Column:
        return col(OBJ) if self.has_non_objects else F.lit(True)

    def order_columns(self) -> list[Column]:
        return [k.column() for k in self.ordering]

    def with_df(self, df: DataFrame, ordering: list[OrderKey] | None = None) -> "Feed":
        return Feed(df, list(self.ordering if ordering is None else ordering))

    # -- views -----------------------------------------------------------
    def items(self) -> DataFrame:
        """The visible item columns (unordered)."""
        return self.df.select(*[col(c) for c in self.item_columns])

    def ordered(self) -> DataFrame:
        """The full frame sorted by the ordering (a range-partitioned sort)."""
        return self.df.orderBy(*self.order_columns()) if self.ordering else self.df

    def positioned(self) -> "Feed":
        """A feed without an ordering has the order in which its partitions
        hold it; here that order is a column, which outlives shuffles and files."""
        if self.ordering:
            return self
        at = fresh("at")
        return Feed(self.df.withColumn(at, F.monotonically_increasing_id()), [OrderKey(at)])

    def persist(self) -> "Feed":
        return Feed(self.df.persist(), list(self.ordering))

    @staticmethod
    def from_table(df: DataFrame, order_by: list[str] | str | None = None,
                   descending: bool = False) -> "Feed":
        """Any DataFrame as a source; ``order_by`` names its item order.

        The order columns are copied to hidden columns so that later
        projections (Map with keep_original=false) keep the order.
        """
        if order_by is None:
            return Feed(df, [])
        names = [order_by] if isinstance(order_by, str) else list(order_by)
        keys, cols = [], {}
        for n in names:
            h = fresh("src")
            cols[h] = col(n)
            keys.append(OrderKey(h, descending))
        return Feed(df.withColumns(cols), keys)


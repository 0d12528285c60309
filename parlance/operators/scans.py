"""Ordered scans that stay parallel inside one hot key.

A plain window over ``partitionBy(key)`` puts every row of a key into one task.
Here the key is cut into chunks along its order (a time bucket, a block of
positions).  Rows are scanned inside ``(key, chunk)``, one summary row per chunk
is scanned inside the key, and the summary is joined back on ``(key, chunk)``.
The detail rows shuffle once, by ``(key, chunk)``; the part that sees a whole key
holds one row per chunk.

Keys and order columns must not be null, and a chunk must never decrease along
the order.  A scan reads its input twice (rows and summary); callers that chain
scans settle the steps between them, so that the work grows with the number of
scans and not with its power of two.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.session import settle

_CHUNK = "__chunk"
_UNBOUNDED = Window.unboundedPreceding


@dataclass(frozen=True)
class Scan:
    """A running fold: ``sum``, ``max``, ``min`` or ``last`` (non-null) value."""

    kind: str
    value: Column
    inclusive: bool = True

    def over(self, column: Column, frame) -> Column:
        if self.kind == "last":
            return F.last(column, ignorenulls=True).over(frame)
        return getattr(F, self.kind)(column).over(frame)

    def total(self, column: Column, order: Column) -> Column:
        if self.kind == "last":
            return F.max_by(column, F.when(column.isNotNull(), order))
        return getattr(F, self.kind)(column)

    def combine(self, carried: Column, local: Column) -> Column:
        if self.kind == "sum":
            zero = F.lit(0)
            return F.coalesce(carried, zero) + F.coalesce(local, zero)
        if self.kind == "max":
            return F.greatest(carried, local)
        if self.kind == "min":
            return F.least(carried, local)
        return F.coalesce(local, carried)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    scans: dict[str, Scan],
) -> DataFrame:
    """Add one running column per entry of ``scans``."""
    keys, order = list(keys), list(order)
    source = df.withColumn(_CHUNK, chunk)
    for name, scan in scans.items():
        source = source.withColumn(f"__v_{name}", scan.value)
    order_key = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    within = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(_UNBOUNDED, -1)

    local = source
    for name, scan in scans.items():
        frame = within.rowsBetween(_UNBOUNDED, 0 if scan.inclusive else -1)
        local = local.withColumn(f"__l_{name}", scan.over(F.col(f"__v_{name}"), frame))

    totals = source.groupBy(*keys, _CHUNK).agg(
        *[s.total(F.col(f"__v_{n}"), order_key).alias(f"__t_{n}") for n, s in scans.items()]
    )
    carried = totals.select(
        *keys, _CHUNK, *[s.over(F.col(f"__t_{n}"), across).alias(f"__c_{n}") for n, s in scans.items()]
    )
    joined = local.join(carried, [*keys, _CHUNK], "inner")
    return joined.select(
        *df.columns,
        *[s.combine(F.col(f"__c_{n}"), F.col(f"__l_{n}")).alias(n) for n, s in scans.items()],
    )


def island_ids(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    values: Sequence[str],
    opens: Callable[[Column, Column], Column],
    name: str = "island",
) -> DataFrame:
    """Number runs of rows per key, starting at 1.

    ``opens(previous, current)`` gets two structs of ``values`` of neighbouring rows
    and says whether the current row starts a new run.  Only one chunk summary is
    needed: it holds the first and last row of the chunk and its inner starts.
    """
    keys, order = list(keys), list(order)
    within = Window.partitionBy(*keys, _CHUNK).orderBy(*order)
    order_key = F.struct(*order)
    rows = df.withColumn(_CHUNK, chunk).withColumn("__cur", F.struct(*values))
    rows = rows.withColumn("__prev", F.lag("__cur").over(within)).withColumn(
        "__new",
        F.when(F.col("__prev").isNull(), 0).otherwise(opens(F.col("__prev"), F.col("__cur")).cast("int")),
    )
    summary = rows.groupBy(*keys, _CHUNK).agg(
        F.min_by("__cur", order_key).alias("__first"),
        F.max_by("__cur", order_key).alias("__last"),
        F.sum("__new").alias("__inner"),
    )
    across = Window.partitionBy(*keys).orderBy(_CHUNK)
    summary = summary.withColumn("__before", F.lag("__last").over(across)).withColumn(
        "__edge",
        F.when(F.col("__before").isNull(), 1).otherwise(opens(F.col("__before"), F.col("__first")).cast("int")),
    )
    base = F.coalesce(
        F.sum(F.col("__edge") + F.col("__inner")).over(across.rowsBetween(_UNBOUNDED, -1)), F.lit(0)
    ) + F.col("__edge")
    summary = summary.select(*keys, _CHUNK, base.alias("__base"))
    running = F.sum("__new").over(within.rowsBetween(_UNBOUNDED, 0))
    return (
        rows.withColumn("__n", running)
        .join(summary, [*keys, _CHUNK], "inner")
        .select(*df.columns, (F.col("__base") + F.col("__n")).cast("long").alias(name))
    )


def interval_islands(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    start: str,
    end: str,
    opens: Callable[[Column], Column],
    ties: Sequence[str] = (),
    name: str = "island",
) -> DataFrame:
    """Number islands of intervals by the furthest end seen so far.

    ``opens(gap)`` gets ``start - furthest earlier end`` and says whether the row
    starts a new island.
    """
    order = [start, end, *ties]
    reached = prefix_scan(df, keys, chunk, order, {"__reach": Scan("max", F.col(end), inclusive=False)})
    gap = F.col(start) - F.col("__reach")
    flagged = reached.withColumn(
        "__opens", F.when(F.col("__reach").isNull(), 1).otherwise(opens(gap).cast("int"))
    )
    flagged = settle(flagged.drop("__reach"), "islands")
    numbered = prefix_scan(flagged, keys, chunk, order, {name: Scan("sum", F.col("__opens"))})
    return numbered.select(*df.columns, F.col(name).cast("long").alias(name))

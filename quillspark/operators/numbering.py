"""Dense numbers in an order, as a prefix scan in two levels over a table that is written once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of a summary that may be broadcast; a longer one is joined by shuffle.
MOST = 100_000

_PLACE = 33  # bits of monotonically_increasing_id() that count within a partition


def _beside(ranged: DataFrame, sums: DataFrame, within: tuple[str, ...]) -> DataFrame:
    """Each row beside the sums of its range: a lookup of a row a range (and value of `within`), broadcast if it is short."""
    on = ranged["_range"] == sums["_range"]
    for c in within:
        on = on & ranged[f"`{c}`"].eqNullSafe(sums[f"`{c}`"])
    return ranged.join(F.broadcast(sums) if sums.limit(MOST + 1).count() <= MOST else sums, on)


def numbered(df: DataFrame, *by: str | Column, within: tuple[str, ...] = (), out: str = "number") -> DataFrame:
    """df with 0, 1, 2 ... in order of `by`, within equal values of the columns `within`.

    The ranges of the order are drawn, sorted and written once, each row with its range and its place there, so every later
    read, in whatever plan, sees the same ranges. Numbers are then sums over a summary that has a row for each range and value of
    `within`: no task takes in all rows, and a hot value is cut into ranges like all others, as long as `by` tells its rows apart.
    Rows that `by` does not tell apart are numbered one after the other in an order that is fixed by the written table. Nulls
    come first. An empty table stays empty."""
    names = [c for c in ("_at", "_range", "_first", "_n", "_base") if c in df.columns]
    if names:
        raise ValueError(f"columns {names} are used inside")
    order = [*[F.col(f"`{c}`") for c in within], *[F.col(f"`{c}`") if isinstance(c, str) else c for c in by]]
    rows = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    ranged = rows.withColumn("_range", F.shiftright("_at", _PLACE))
    sums = ranged.groupBy("_range", *within).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.withColumn("_base", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).drop("_first", "_n"), "numbered-sums")
    return _beside(ranged, sums, within).select(*[ranged[f"`{c}`"] for c in df.columns], (F.col("_at") + F.col("_base")).cast("long").alias(out))


def running(df: DataFrame, *by: str | Column, of: dict[str, str | Column], within: tuple[str, ...] = ()) -> DataFrame:
    """df with running sums in order of `by` within equal values of `within`, the row's own value included: of names each sum and
    what it adds up. The same two levels as numbered(): within ranges of one written table, then over the ranges."""
    order = [*[F.col(f"`{c}`") for c in within], *[F.col(f"`{c}`") if isinstance(c, str) else c for c in by]]
    parts = {k: F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0)) for k, v in of.items()}
    rows = written(df.withColumns(parts).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "running")
    ranged = rows.withColumn("_range", F.shiftright("_at", _PLACE))
    sums = ranged.groupBy("_range", *within).agg(*[F.sum(k).alias(k) for k in of])
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.select("_range", *within, *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in of]), "running-sums")
    own = Window.partitionBy("_range", *within).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumns({k: F.sum(k).over(own) for k in of})
    return _beside(ranged, sums, within).select(*[ranged[f"`{c}`"] for c in df.columns if c not in of], *[(ranged[k] + sums[f"_{k}"]).alias(k) for k in of])

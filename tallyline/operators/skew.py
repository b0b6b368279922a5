"""Numbering rows and handing out ids when one key may hold a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.session import stage

# A key with more rows than this is cut into slices; any other is sorted by one task.
HEAVY_ROWS = 10_000


def heavy_keys(rows: DataFrame, keys: Sequence[str], min_rows: int | None = None) -> DataFrame:
    """The ``keys`` with more than ``min_rows`` rows in ``rows``, however many there are.

    Rows are counted before the shuffle. The plan is the same at every size. The keys are
    written once: every step of a numbering reads them.
    """
    min_rows = HEAVY_ROWS if min_rows is None else min_rows
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > min_rows).drop("_rows")
    return stage(found, "heavy-keys")


def number_within(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    slices: Sequence[Column],
    name: str,
    heavy: DataFrame,
) -> DataFrame:
    """Number rows 1, 2, ... within ``keys`` in ``order``.

    Rows whose key (or part of it) is in ``heavy`` are cut into nested ``slices``
    (taken one after the other they never decrease along ``order``), numbered per
    innermost slice, and shifted by the rows of earlier slices. Each slice should
    have a limited number of values within the one before it. All other rows have
    one slice per key; the numbers are the same either way.

    Rows are shuffled once, by the columns of ``heavy``, unless they come so already; what
    groups or joins them by these columns afterwards needs no shuffle of its own.
    """
    names = [f"_s{i}" for i in range(len(slices))]
    marks = heavy.withColumn("_heavy", F.lit(True))

    def sliced(marked: DataFrame) -> DataFrame:
        # A struct keeps a NULL slice value apart from "not cut".
        return marked.withColumns({n: F.when(F.col("_heavy"), F.struct(s.alias("v"))) for n, s in zip(names, slices)})

    # A merge join leaves the rows dealt by their key; a broadcast would have the window deal them by slices.
    cut = sliced(rows.join(marks.hint("merge"), heavy.columns, "left").select(*rows.columns, "_heavy"))
    local = cut.withColumn("_local", F.row_number().over(W.partitionBy(*keys, *names).orderBy(*order)))

    # Of the rows of other keys nothing is shuffled here where the heavy keys are few.
    counts = sliced(rows.join(marks, heavy.columns)).groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    shifts = None
    for depth in range(len(names)):
        outer, level = [*keys, *names[:depth]], [*keys, *names[: depth + 1]]
        earlier = W.partitionBy(*outer).orderBy(names[depth]).rowsBetween(W.unboundedPreceding, -1)
        here = (
            counts.groupBy(*level)
            .agg(F.sum("_n").alias("_n"))
            .select(*level, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
        )
        if shifts is None:
            shifts = here.withColumnRenamed("_before", "_shift")
        else:
            shifts = here.join(shifts, outer).select(*level, (F.col("_before") + F.col("_shift")).alias("_shift"))
    number = (F.col("_local") + F.coalesce("_shift", F.lit(0))).cast("bigint")
    return local.join(shifts, [*keys, *names], "left").select(*rows.columns, number.alias(name))


def _sliced(rows: DataFrame, keys: Sequence[str], event: Column, name: str, width: int, order: str, later: bool) -> DataFrame:
    """``event_after`` or ``event_before``: the nearest event inside the slice, else that of the nearest slice with one."""
    outside = f"_{name}"
    cut = rows.withColumns({"_slice": F.floor(F.col(order) / width), "_event": event})
    way = [F.col(order).asc() if later else F.col(order).desc()]
    nearest = F.first("_event", ignorenulls=True)
    inside = nearest.over(W.partitionBy(*keys, "_slice").orderBy(*way).rowsBetween(1, W.unboundedFollowing))
    # One row per key and slice: its event that is nearest to the other slices.
    pick = (F.min_by if later else F.max_by)("_event", F.when(F.col("_event").isNotNull(), F.col(order)))
    ends = cut.groupBy(*keys, "_slice").agg(pick.alias("_event"))
    slices = [F.col("_slice").asc() if later else F.col("_slice").desc()]
    other = nearest.over(W.partitionBy(*keys).orderBy(*slices).rowsBetween(1, W.unboundedFollowing))
    ends = ends.select(*keys, "_slice", other.alias(outside))
    return (
        cut.withColumn(name, inside).join(ends, [*keys, "_slice"])
        .withColumn(name, F.coalesce(name, outside)).select(*rows.columns, name)
    )


def event_after(rows: DataFrame, keys: Sequence[str], event: Column, name: str, width: int, order: str = "pos") -> DataFrame:
    """Add ``name``: the first ``event`` (not NULL) of a later row with the same ``keys`` (not NULL), NULL if there is none.

    ``order`` is a whole number, unique within the keys. Rows are cut into slices of ``width``
    of its values, so a key with a third of all rows goes through many tasks.
    """
    return _sliced(rows, keys, event, name, width, order, later=True)


def event_before(rows: DataFrame, keys: Sequence[str], event: Column, name: str, width: int, order: str = "pos") -> DataFrame:
    """The last ``event`` of an earlier row, like ``event_after``."""
    return _sliced(rows, keys, event, name, width, order, later=False)


def allocate_ids(
    new: DataFrame, keys: Sequence[str], start: Column, name: str = "id", buckets: int | None = None
) -> DataFrame:
    """Give every row of ``new`` (unique on ``keys``) a dense id above ``start``.

    Rows are numbered inside hash buckets of their key, by default four for every
    shuffle partition of the session; only the bucket counts meet in one task. The
    ids depend on the contents and the buckets alone, so a repeated task gives the
    same ids.
    """
    if buckets is None:
        buckets = 4 * int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucketed = new.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy(*keys))
    local = bucketed.withColumn("_local", rank)
    earlier = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    # Counted on the numbered rows: both uses share one shuffle of `new`.
    shifts = (
        local.groupBy("_bucket")
        .agg(F.max("_local").alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift"))
    )
    # At most `buckets` rows of two numbers: safe to broadcast.
    return (
        local.join(F.broadcast(shifts), "_bucket")
        .withColumn(name, (start + F.col("_shift") + F.col("_local")).cast("bigint"))
        .drop("_bucket", "_local", "_shift")
    )

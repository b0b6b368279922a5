"""Numbering and ids with heavy keys, against the plain forms."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyline.operators.skew import allocate_ids, heavy_keys, number_within


def lopsided(spark):
    """Two thirds of the rows under one key, the rest spread."""
    return spark.range(6_000).select(
        F.when(F.col("id") % 3 != 0, 7).otherwise(F.col("id")).alias("k"),
        (F.col("id") * 37 % 101).alias("a"),
        F.when(F.col("id") % 5 != 0, F.col("id") * 13 % 1009).alias("b"),
        F.col("id").alias("c"),
    )


def test_heavy_keys_are_found(spark):
    rows = lopsided(spark)
    assert [r.k for r in heavy_keys(rows, ["k"], min_rows=1_000).collect()] == [7]
    assert heavy_keys(rows, ["k"], min_rows=5_000).count() == 0
    # No number of keys is too many.
    assert heavy_keys(rows, ["k"], min_rows=0).count() == rows.select("k").distinct().count()


def test_sliced_numbers_equal_plain_numbers(spark):
    rows = lopsided(spark)
    order = [F.col("a"), F.col("b"), F.col("c")]
    slices = [F.col("a"), F.floor(F.col("b") / 100)]
    plain = rows.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy(*order)).cast("bigint"))
    for least in (0, 1_000, 10_000):
        numbered = number_within(rows, ["k"], order, slices, "n", heavy_keys(rows, ["k"], min_rows=least))
        assert numbered.columns == plain.columns
        assert numbered.exceptAll(plain).count() == 0 and plain.exceptAll(numbered).count() == 0


def test_ids_are_dense_unique_and_repeatable(spark):
    new = spark.range(5_000).select(F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 7).alias("team_id"))
    first = allocate_ids(new, ["team_id", "name"], F.lit(100))
    again = allocate_ids(new.repartition(13).orderBy(F.rand()), ["team_id", "name"], F.lit(100))
    span = first.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert tuple(span) == (101, 5_100, 5_000)
    assert first.exceptAll(again.select(*first.columns)).count() == 0

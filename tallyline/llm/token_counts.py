"""Token counts of a corpus from its exact histogram of document lengths."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.llm.packing import encoder

#: Lengths summed as one block on the way to the suffix sums.
BLOCK = 1024


def lengths(
    docs: DataFrame, vocabulary: str, end: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_tokens): ids of each whole text, the end id included; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            counts = [len(x) // 4 + end for x in own.pack(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def histogram(counted: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) over all documents."""
    return counted.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def totals(lengths_seen: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length L of the histogram, what a context limit of L would mean.

    Columns: n_tokens (L), n_docs, docs_at_most and docs_longer (documents of up
    to and over L), tokens_at_most (tokens of the documents that fit),
    truncated_total (tokens left when every document is cut at L), quantile (share
    of documents that fit). A limit between two lengths takes the row below it and
    adds docs_longer for each further token: ``truncated_at``. Empty input: no rows.

    The sums run over blocks of lengths first and inside each block after, so no
    window holds the whole histogram, however long the texts are.
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    rows = lengths_seen.withColumn("__block", F.floor(F.col("n_tokens") / block)).withColumn("__tokens", tokens)
    blocks = rows.groupBy("__block").agg(F.sum("n_docs").alias("d"), F.sum("__tokens").alias("t"))
    after = Window.orderBy(F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("__block").desc()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    later = blocks.select(
        "__block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("__d"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("__t"),
        F.sum("d").over(everything).alias("__all_d"), F.sum("t").over(everything).alias("__all_t"),
    )
    longer = Window.partitionBy("__block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(later, "__block").select(
        "n_tokens", "n_docs", "__all_d", "__all_t",
        (F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("__d")).alias("docs_longer"),
        (F.coalesce(F.sum("__tokens").over(longer), F.lit(0)) + F.col("__t")).alias("__longer_t"),
    )
    fits = F.col("__all_t") - F.col("__longer_t")
    return out.select(
        "n_tokens", "n_docs",
        (F.col("__all_d") - F.col("docs_longer")).alias("docs_at_most"), "docs_longer",
        fits.alias("tokens_at_most"),
        (fits + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("__all_d") - F.col("docs_longer")) / F.col("__all_d")).alias("quantile"),
    )


def truncated_at(counted: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_longer, truncated_total) for any context limits, from the histogram alone."""
    spark = counted.sparkSession
    wanted = spark.createDataFrame([(x,) for x in limits], "limit long")
    cut = F.least(F.col("n_tokens"), F.col("limit")) * F.col("n_docs")
    per = counted.select("*", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])).alias("limit"))
    found = per.groupBy("limit").agg(
        F.sum(F.when(F.col("n_tokens") > F.col("limit"), F.col("n_docs")).otherwise(0)).alias("docs_longer"),
        F.sum(cut).alias("truncated_total"),
    )
    return wanted.join(found, "limit", "left").fillna(0)


def length_at(reached: DataFrame, share: float) -> DataFrame:
    """(n_tokens): the least length that at least ``share`` of all documents do not exceed."""
    return reached.filter(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))

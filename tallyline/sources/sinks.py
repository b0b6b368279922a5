"""Where results go: JSON documents and bucketed tables. Tables that grow by batches are in ``store``."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_documents(rows: DataFrame, path: str) -> None:
    """Nested results as JSON lines."""
    rows.write.mode("overwrite").json(path)


def save_bucketed(rows: DataFrame, table: str, key: str, buckets: int, path: str) -> None:
    """Save a table hashed on ``key`` at ``path``, so that later joins on it need no shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)

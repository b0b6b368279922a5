"""SimHash near-duplicates by covering locality-sensitive hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.shared import components, stage

BITS = 64
#: Shingles whose bits are counted at once, so that a long text needs no more memory.
CHUNK = 1 << 18


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of one text; zero without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        runs = iter([b" ".join(words)])
        total = 1
    else:
        runs = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
        total = len(words) - shingle + 1
    counts = np.zeros(BITS, dtype=np.int64)
    hashes = map(xxhash.xxh64_intdigest, runs, repeat(42))
    for start in range(0, total, CHUNK):
        part = np.fromiter(hashes, dtype=">u8", count=min(CHUNK, total - start))
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_fingerprint(x.as_py(), shingle) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """Masks such that any two values at most ``radius`` bits apart agree under one of them.

    Bit i is given a non-zero vector of radius + 1 bits, mask v keeps the bits
    whose vector has an odd product with v. The vectors of ``radius`` differing
    bits leave at least one v that is orthogonal to all of them, and this mask
    keeps none of the differing bits (Pagh, CoveringLSH).
    """
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(BITS)]
    return [
        sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, top)
    ]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def links(values: DataFrame, radius: int = 3, bucket: int = 512) -> DataFrame:
    """Links (a, b) between distinct values ``fp`` that connect all pairs at most ``radius`` bits apart.

    Two values share a component of the links exactly if a chain of such pairs
    joins them. Buckets of up to ``bucket`` values are compared within a task and
    give a link from every value to one it was found near. Larger buckets go
    through ``flip_links``, which needs no pairs, so no bucket is ever gathered whole.
    """
    masks = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
             for t, m in enumerate(covering_masks(radius))]
    tables = values.select("fp", F.explode(F.array(*masks)).alias("x")).select("fp", "x.t", "x.key")
    sizes = tables.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stage(tables.join(sizes, ["t", "key"]), "simhash-buckets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [_tree(np.array(x.as_py(), dtype=np.int64), radius) for x in batch.column(0)]
            ends = [np.concatenate([np.empty(0, np.int64), *side]) for side in zip(*pairs)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["a", "b"])

    small = shared.filter(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps"))
    found = small.select("fps").mapInArrow(compare, "a long, b long")
    crowded = shared.filter(F.col("n") > bucket).select("fp").distinct()
    return found.unionByName(flip_links(crowded, radius)).distinct()


def _tree(x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A link from each value to the first of its component among ``x``, where links are pairs within the radius."""
    u = x.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= radius
    root = np.argmax(near, axis=1)
    while True:
        least = np.where(near, root[None, :], len(x)).min(axis=1)
        least = least[least]
        if (least == root).all():
            moved = root != np.arange(len(x))
            return x[moved], x[root[moved]]
        root = least


def flip_links(values: DataFrame, radius: int) -> DataFrame:
    """The same links for any number of distinct values, without pairs.

    Two values at most ``radius`` bits apart have a value between them that is
    within half the radius of one and the other half of the other. So each value
    is listed under all keys it reaches by the larger half of the flips, and is
    linked to the smallest value that reaches the key by the smaller half. All of
    these are within the radius of that one, so no link is too far.
    """
    heads = _flipped(values, radius // 2).groupBy("key").agg(F.min("fp").alias("head"))
    reach = _flipped(values, radius - radius // 2)
    return reach.join(heads, "key").filter("fp <> head").select(F.col("fp").alias("a"), F.col("head").alias("b"))


def _flipped(values: DataFrame, flips: int) -> DataFrame:
    """(fp, key): every value that differs from ``fp`` in up to ``flips`` bits, once."""
    rows = values.select("fp", F.col("fp").alias("key"), F.lit(BITS + 1).alias("bit"))
    for _ in range(flips):
        # Bits in falling order; 0 stands for no further flip.
        rows = rows.select("fp", "key", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bit") - 1, F.lit(0)))).alias("bit"))
        flip = F.when(F.col("bit") > 0, F.expr("shiftleft(1L, bit - 1)")).otherwise(F.lit(0).cast("long"))
        rows = rows.select("fp", F.col("key").bitwiseXOR(flip).alias("key"), "bit")
    return rows.select("fp", "key")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, bucket: int = 512,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over fingerprints at most
    ``radius`` bits apart, the document itself included. Copies share one
    fingerprint, which takes part once. Texts that are null, empty or without
    words have fingerprint zero and are linked like any other. A repeated doc_id
    gives a row each time; a null doc_id is linked but names a component only
    where all its members are null. Other columns of ``docs`` are not read.
    """
    rows = stage(fingerprints(docs, shingle, id_col, text_col), "simhash-fingerprints")
    values = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-values")
    tree = components(links(values, radius, bucket))
    rooted = values.join(tree, values["fp"] == tree["node"], "left").select(
        values["fp"], "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # A text with very many copies is one skewed key, which the join splits.
    classes = rooted.join(named, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return rows.join(classes, rows["fp"] == classes["class_fp"]).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id names their component; rows without an id go only with a copy that has one."""
    kept = found.filter("doc_id <=> component_id").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("__kept")), "left_semi")

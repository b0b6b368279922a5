"""Long passages that repeat across documents, found by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.llm.shared import stage

#: Words of a window.
WINDOW = 50
#: A perfect difference set. Every difference modulo the period is one of two members.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
# Odd 64-bit multipliers of the rolling hashes.
_ANCHOR, _LEFT, _RIGHT = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
#: Anchors or windows that a task holds to settle among themselves.
HELD = 1_000_000


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def rolled(h: np.ndarray, size: int, factor: int) -> np.ndarray:
    """A hash of every run of ``size`` words: a polynomial over their hashes, mixed."""
    n = len(h) - size + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    # Runs of 1, 2, 4 ... words, put together to the wanted size.
    out, have, power = None, 0, np.uint64(factor)
    block, width, left = h, 1, size
    with np.errstate(over="ignore"):
        while True:
            if left & width:
                part = block[have:have + n]
                out = part.copy() if out is None else out * power + part
                have += width
            if 2 * width > left:
                break
            block = block[:len(block) - width] * power + block[width:]
            power = power * power
            width *= 2
    return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, sha256) of the words of every text, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [(x.as_py() or "").encode("utf-8", "surrogatepass").split() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(w) for w in split], pa.int64()),
                 pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split])],
                ["doc_id", "text_hash", "n_words", "sha256"],
            )

    return rows.select("doc_id", "text_hash", "text").mapInArrow(
        run, "doc_id long, text_hash long, n_words long, sha256 string"
    )


def anchors(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(known, h, text_hash, pos): hashes of the words after the cover positions of every text.

    An anchor has ``window - PERIOD + 1`` words. Wherever two texts agree on a
    whole window, some offset into it is a cover position in both, so both have
    the same anchor there. A task that sees an anchor in two texts knows that it
    is shared: their rows come out as ``known``, under a key of their own, and
    only one goes on to be held against other tasks. So no anchor has more rows
    to compare than there are tasks, besides repeats within one text.
    """
    size = window - PERIOD + 1
    cover = np.isin(np.arange(PERIOD), COVER)

    def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, text, pos = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((pos, text, h))
        h, text, pos = h[order], text[order], pos[order]
        own = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]) | (pos[1:] != pos[:-1])]
        h, text, pos = h[own], text[own], pos[own]
        first = np.r_[True, h[1:] != h[:-1]]
        group = np.cumsum(first) - 1
        last = np.r_[np.flatnonzero(first)[1:], len(h)] - 1
        known = (text[first] != text[last])[group]
        go = ~known | first
        key = np.concatenate([h[go], mixed(text[known].view(np.uint64) + pos[known].astype(np.uint64))])
        flag = np.r_[np.zeros(go.sum(), bool), np.ones(known.sum(), bool)]
        return pa.RecordBatch.from_arrays(
            [pa.array(flag), pa.array(key.view(np.int64)), pa.array(np.r_[text[go], text[known]]),
             pa.array(np.r_[pos[go], pos[known]])], ["known", "h", "text_hash", "pos"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = word_hashes(text.as_py())
                if len(words) < window:
                    continue
                runs = rolled(words, size, _ANCHOR)
                at = np.flatnonzero(np.resize(cover, len(runs)))
                parts.append((runs[at], np.full(len(at), text_hash, dtype=np.int64), at.astype(np.int32)))
                held += len(at)
                if held >= HELD:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)

    return rows.filter("doc_id IS NOT NULL").select("text_hash", "text").mapInArrow(
        run, "known boolean, h long, text_hash long, pos int"
    )


def windows(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(known, k1, k2, doc_id, i): 128-bit hashes of all windows around the anchors at ``at`` of every text.

    Where a task sees a window in several texts, all but those of the smallest
    doc_id are ``known`` to repeat, and only that one's go on to be held against
    other tasks.
    """
    before = PERIOD - 1

    def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        k1, k2, doc, pos = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((pos, doc, k2, k1))
        k1, k2, doc, pos = k1[order], k2[order], doc[order], pos[order]
        first = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])]
        known = doc > doc[first][np.cumsum(first) - 1]
        k1[known], k2[known] = mixed(doc[known].view(np.uint64) + pos[known].astype(np.uint64)), 0
        return pa.RecordBatch.from_arrays(
            [pa.array(known), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(doc), pa.array(pos)],
            ["known", "k1", "k2", "doc_id", "i"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for number, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                words = word_hashes(text.as_py())
                count = len(words) - window + 1
                if count < 1:
                    continue
                at = np.array(at.as_py(), dtype=np.int64)
                # Every window that starts up to a period before an anchor holds it.
                edge = np.zeros(count + 1, dtype=np.int64)
                np.add.at(edge, np.clip(at - before, 0, count), 1)
                np.add.at(edge, np.clip(at + 1, 0, count), -1)
                near = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                parts.append((
                    rolled(words, window, _LEFT)[near], rolled(words, window, _RIGHT)[near],
                    np.full(len(near), number, dtype=np.int64), near.astype(np.int32),
                ))
                held += len(near)
                if held >= HELD:
                    yield out(parts)
                    parts, held = [], 0
        if parts:
            yield out(parts)

    return texts.select("doc_id", "text", "at").mapInArrow(
        run, "known boolean, k1 long, k2 long, doc_id long, i int"
    )


def repeats(rows: DataFrame, seen: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(texts, starts): the texts with candidates and, per doc_id, the windows that a smaller doc_id has too.

    ``rows`` has doc_id, text_hash and text, ``seen`` their digests. Of texts with
    the same words only the smallest doc_id takes part; the others are settled by
    their digest. Anchors and windows are each shuffled once, after every task has
    settled what it can by itself, so that no key has many rows left.
    """
    same_anchor = Window.partitionBy("known", "h")
    shared = F.min("text_hash").over(same_anchor) != F.max("text_hash").over(same_anchor)
    spread = anchors(rows, window).withColumn("shared", F.col("known") | shared).filter("shared")
    at = spread.groupBy("text_hash").agg(F.collect_set("pos").alias("at"))
    alone = seen.filter("doc_id IS NOT NULL").groupBy("sha256").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("x")
    ).select("x.doc_id", "x.text_hash")
    texts = stage(
        rows.select("doc_id", "text").join(alone.join(at, "text_hash").select("doc_id", "at"), "doc_id"),
        "repeat-candidates",
    )
    same_window = Window.partitionBy("known", "k1", "k2")
    later = windows(texts, window).withColumn("lo", F.min("doc_id").over(same_window)).filter("known OR doc_id > lo")
    return texts, later.groupBy("doc_id").agg(F.collect_set("i").alias("starts"))


def _copies(seen: DataFrame) -> DataFrame:
    """The rows of ``seen`` whose words are those of a smaller doc_id."""
    least = seen.groupBy("sha256").agg(F.min("doc_id").alias("__first"), F.max("doc_id").alias("__last"))
    # Written, so that the join meets it on a shuffle of its own and can split a text with very many copies.
    least = stage(least.filter("__first < __last").select("sha256", "__first"), "repeat-copies")
    return seen.join(least, "sha256").filter("doc_id > __first").drop("__first")


def _covered(n_words: int, starts: list[int], window: int) -> np.ndarray:
    edge = np.zeros(n_words + 1, dtype=np.int64)
    starts = np.array(starts, dtype=np.int64)
    starts = starts[starts <= n_words - window]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def cut(text: str, starts: list[int], window: int = WINDOW) -> str:
    """The text without the words of the windows at ``starts``; what stays keeps its own white space."""
    if not len(starts):
        return text
    raw = text.encode("utf-8", "surrogatepass")
    inside = ~np.isin(np.frombuffer(raw, np.uint8), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
    turn = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    begins = turn[::2]
    gone = _covered(len(begins), starts, window)
    if not gone.any():
        return text
    # A removed word goes with the white space up to the next word.
    bounds = np.r_[begins, len(raw)]
    runs = np.flatnonzero(np.diff(np.concatenate([[1], gone.astype(np.int8), [1]])))
    kept = [raw[:bounds[0]]] if not gone[0] else []
    kept += [raw[bounds[a]:bounds[b]] for a, b in zip(runs[::2], runs[1::2])]
    return b"".join(kept).decode("utf-8", "surrogatepass").strip()


def deduplicated(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, starts) for every row of ``docs``.

    ``starts`` lists the windows that are removed, ``kept_sha256`` is of the words
    that stay, joined by one space. All windows are judged on the input. Null,
    empty and short texts have no window and lose nothing. Rows without a doc_id
    are neither removed nor a reason to remove. A repeated doc_id stands for
    repeated rows: they don't remove each other and lose the same words. Other
    columns are not read.
    """
    rows = _narrow(docs, id_col, text_col)
    seen = stage(digests(rows), "repeat-digests")
    texts, starts = repeats(rows, seen, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost, digest = [], []
            for text, at in zip(batch.column(1), batch.column(2)):
                words = np.array((text.as_py() or "").encode("utf-8", "surrogatepass").split(), dtype=object)
                gone = _covered(len(words), at.as_py(), window)
                lost.append(int(gone.sum()))
                digest.append(hashlib.sha256(b" ".join(words[~gone])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lost, pa.int64()), pa.array(digest), batch.column(2)],
                ["__id", "__lost", "__sha", "starts"],
            )

    changed = texts.select("doc_id", "text").dropDuplicates(["doc_id"]).join(starts, "doc_id").select(
        "doc_id", "text", "starts"
    ).mapInArrow(run, "__id long, __lost long, __sha string, starts array<int>")
    copies = _copies(seen).filter(F.col("n_words") >= window).select(F.col("doc_id").alias("__copy")).distinct()
    out = seen.drop("text_hash").join(changed, seen["doc_id"] == changed["__id"], "left").join(
        copies, F.col("doc_id") == F.col("__copy"), "left"
    )
    whole = F.col("__copy").isNotNull()
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("__lost", F.lit(0))).alias("n_removed"),
        F.when(whole, nothing).otherwise(F.coalesce("__sha", "sha256")).alias("kept_sha256"),
        F.when(whole, F.sequence(F.lit(0), (F.col("n_words") - window).cast("int"))).otherwise(F.col("starts")).alias("starts"),
    )


def without_repeats(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None
) -> DataFrame:
    """``docs`` with the repeated passages cut from their texts, all other columns as they are.

    Rows whose words all go are left out; all others stay, unchanged where nothing
    repeats. ``length_col`` names a column that holds the text's length, if there is one.
    """
    rows = _narrow(docs, id_col, text_col)
    seen = stage(digests(rows), "repeat-digests")
    _, starts = repeats(rows, seen, window)
    copies = _copies(seen).filter(F.col("n_words") >= window).select("doc_id").distinct()
    changes = starts.select(F.col("doc_id").alias("__id"), F.col("starts").alias("__starts")).unionByName(
        copies.select(F.col("doc_id").alias("__id"), F.lit(None).cast("array<int>").alias("__starts"))
    )

    @F.arrow_udf("string")
    def rest(texts: pa.Array, starts: pa.Array) -> pa.Array:
        return pa.array([cut(x.as_py(), y.as_py(), window) for x, y in zip(texts, starts)], pa.string())

    # Evaluated once, although a filter and the result both read it.
    rest = rest.asNondeterministic()
    joined = docs.join(changes, docs[id_col].cast("long") == F.col("__id"), "left")
    changed = F.col("__id").isNotNull()
    new = F.when(changed & F.col("__starts").isNotNull(), rest(F.col(text_col), F.coalesce("__starts", F.array().cast("array<int>"))))
    out = joined.withColumn("__text", F.when(~changed, F.col(text_col)).otherwise(F.coalesce(new, F.lit(""))))
    out = out.filter(~changed | (F.col("__text") != ""))
    length = F.when(changed, F.length("__text"))
    result = {text_col: F.col("__text")}
    if length_col in docs.columns:
        own = F.col(f"`{length_col}`")
        result[length_col] = F.coalesce(length.cast(docs.schema[length_col].dataType), own)
    return out.select(*[result.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])

"""Benchmark passages in a corpus, found by one Aho-Corasick automaton."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.shared import stage

#: Words of a window.
WINDOW = 10
#: Windows of one automaton, about 160 MB. Larger benchmarks are scanned in blocks of this size, a pass over the documents for each.
BLOCK_WINDOWS = 200_000
# Every byte as it counts: a-z and 0-9 and all of non-ASCII as they are, A-Z
# lowered, everything else a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256)
)

RESULT = (
    "doc_id long, n_words long, n_hit long, items array<string>, "
    "spans array<struct<first: int, last: int, start: int, end: int>>"
)


def folded(text: str | None) -> bytes:
    """The text's bytes, lowered, with a space for every byte that is in no word. Offsets stay."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """An item's windows, words joined by one space; a shorter item is one window."""
    words = folded(text).split()
    if not words:
        return []
    return list(dict.fromkeys(b" ".join(words[k:k + size]) for k in range(max(1, len(words) - size + 1))))


def automaton(items: list[tuple[str, str]], size: int = WINDOW):
    """One automaton over the windows of all items; a window's value is (its words, its items)."""
    import ahocorasick

    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for window in windows(text, size):
            owners.setdefault(window, set()).add(item)
    found = ahocorasick.Automaton()
    for window, ids in owners.items():
        # Spaces at both ends let whole words match only.
        found.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(sorted(ids))))
    if owners:
        found.make_automaton()
    return found


def hits(words: list[bytes], found) -> tuple[list[tuple[int, int]], set[str]]:
    """First and last words of one automaton's runs of hits in a folded text, and the items these are from."""
    if not words or not len(found):
        return [], set()
    matches = list(found.iter(f" {b' '.join(words).decode('latin-1')} "))
    if not matches:
        return [], set()
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    # Place of the space after each word in the joined line.
    ends = np.cumsum(sizes + 1)
    last = np.searchsorted(ends, np.fromiter((m[0] for m in matches), dtype=np.int64, count=len(matches)))
    first = last + 1 - np.fromiter((m[1][0] for m in matches), dtype=np.int64, count=len(matches))
    return _runs(len(words), first, last), {item for m in matches for item in m[1][1]}


def _runs(n: int, first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """The runs of covered words out of ``n``, as their first and last words."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, last + 1, -1)
    turn = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])))
    return [(int(a), int(b) - 1) for a, b in zip(turn[::2], turn[1::2])]


def united(
    text: str | None, n: int, runs: list[tuple[int, int]], items: set[str]
) -> tuple[int, int, list[str], list[tuple[int, int, int, int]]]:
    """(words, hit words, items, spans) of one text of ``n`` words from the runs of all automata."""
    if not runs:
        return n, 0, [], []
    runs = _runs(n, *np.array(runs, dtype=np.int64).T)
    starts, stops = _places(folded(text))
    # Back from bytes to code points: count the bytes that begin one.
    begins = np.cumsum((np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)
    spans = [(a, b, int(begins[starts[a]]) - 1, int(begins[stops[b] - 1])) for a, b in runs]
    return n, sum(b - a + 1 for a, b in runs), sorted(items), spans


def scan(text: str | None, automata: list) -> tuple[int, int, list[str], list[tuple[int, int, int, int]]]:
    """(words, hit words, items, spans) of one text.

    Spans are the runs of hit words: numbers of the first and last word, and the
    run's place in the original text in code points, end excluded.
    """
    words = folded(text).split()
    found = [hits(words, a) for a in automata]
    return united(text, len(words), [r for runs, _ in found for r in runs], {i for _, items in found for i in items})


def _places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of every word's start and end."""
    inside = np.frombuffer(raw, np.uint8) != 32
    turn = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return turn[::2], turn[1::2]


def items_of(benchmark: DataFrame, block: int, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(item, text) of a benchmark, and into how many blocks of about ``block`` windows its text is cut."""
    # Every window takes a word, every word at least two characters of text.
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).dropna()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    return items, max(1, -(-chars // (2 * block)))


def automaton_of(items: DataFrame, k: int, blocks: int, size: int) -> Broadcast:
    """The automaton of one block of the items, brought to the driver on its own and sent out."""
    part = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
    own = automaton([(r["item"], r["text"]) for r in part.toLocalIterator()], size)
    return items.sparkSession.sparkContext.broadcast(pickle.dumps(own))


def hits_by_block(rows: DataFrame, items: DataFrame, blocks: int, size: int) -> DataFrame:
    """(row, runs, items) of every block with hits in a text of ``rows`` (row, text): a pass per block, one automaton at a time."""
    run_kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    out = None
    for k in range(blocks):
        sent = automaton_of(items, k, blocks, size)

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(sent.value)
            for batch in batches:
                found = [(row, *hits(folded(text.as_py()).split(), own)) for row, text in zip(batch.column(0).to_pylist(), batch.column(1))]
                found = [f for f in found if f[1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()),
                     pa.array([[{"first": a, "last": b} for a, b in f[1]] for f in found], run_kind),
                     pa.array([sorted(f[2]) for f in found], pa.list_(pa.string()))], ["row", "runs", "items"],
                )

        part = rows.select("row", "text").mapInArrow(
            run, "row long, runs array<struct<first: int, last: int>>, items array<string>"
        )
        part = stage(part, "benchmark-hits")
        sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _result(ids: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "end")]))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([f[0] for f in found], pa.int64()),
         pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.list_(pa.string())),
         pa.array([[dict(zip(("first", "last", "start", "end"), s)) for s in f[3]] for f in found], kind)],
        ["doc_id", "n_words", "n_hit", "items", "spans"],
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block: int = BLOCK_WINDOWS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for every row of ``docs``.

    A null or empty text has no words and no hits. Items without an id or without
    words have no windows. Items that share a window are all named; items repeated
    under one id count as one. Other columns of either table are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items, blocks = items_of(benchmark, block, item_col, item_text_col)
    if blocks > 1:
        # Numbers of rows must be the same in every pass.
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "benchmark-rows")
        found = hits_by_block(rows, items, blocks, size).groupBy("row").agg(
            F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items")
        )

        def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _result(batch.column(0), [
                    united(
                        text.as_py(), len(folded(text.as_py()).split()),
                        [(r["first"], r["last"]) for r in runs.as_py() or ()], set(names.as_py() or ()),
                    )
                    for text, runs, names in zip(*(batch.column(k) for k in (1, 2, 3)))
                ])

        return rows.join(found, "row", "left").select("doc_id", "text", "runs", "items").mapInArrow(unite, RESULT)
    sent = automaton_of(items, 0, 1, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            yield _result(batch.column(0), [scan(x.as_py(), [own]) for x in batch.column(1)])

    return rows.mapInArrow(run, RESULT)


def clean_rows(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without a single hit word, all columns as they are."""
    items, blocks = items_of(benchmark, BLOCK_WINDOWS, "item_id", "text")
    if blocks > 1:
        rows = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "benchmark-rows")
        texts = rows.select(F.col("__row").alias("row"), F.col(text_col).alias("text"))
        found = hits_by_block(texts, items, blocks, WINDOW).select(F.col("row").alias("__row"))
        return rows.join(found, "__row", "left_anti").select(*docs.columns)
    sent = automaton_of(items, 0, 1, WINDOW)

    @F.arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = pickle.loads(sent.value)
        for texts in batches:
            yield pa.array([not (len(own) and _hits(x.as_py(), own)) for x in texts], pa.bool_())

    return docs.filter(clean(F.col(text_col)))


def _hits(text: str | None, found) -> bool:
    line = f" {b' '.join(folded(text).split()).decode('latin-1')} "
    return next(found.iter(line), None) is not None


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()

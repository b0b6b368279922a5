"""Lines that many documents share, dropped by per-document bitmaps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.shared import stage

#: Documents that make a line common, and the code points a line needs to be looked at.
MIN_DOCS, MIN_CHARS = 10, 1
# What a streamed row says: drop the line, a line of a key that another task may
# have too, the first of such a key's lines here.
_DROP, _OPEN, _LEAD = 0, 1, 2
_LINES = "high long, low long, doc long, row long, pos int"


def _row_key(doc: Column, text: Column) -> Column:
    """Tells rows apart that share an id but not a text; repeated rows get the same bitmap."""
    return F.xxhash64(F.coalesce(text, F.lit("")), doc.isNull())


def lines(rows: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(high, low, doc, row, pos): the 128-bit hash of every line's key, the line's document and place.

    ``rows`` are (doc, row, text). A key is the line without white space (ASCII) at
    its ends and with A-Z in lower case; keys of under ``min_chars`` code points give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes: list[bytes] = []
            places: list[int] = []
            many: list[int] = []
            for text in batch.column(2):
                before = len(places)
                for k, line in enumerate((text.as_py() or "").encode().lower().split(b"\n")):
                    line = line.strip()
                    if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode()) >= min_chars):
                        hashes.append(hashlib.blake2b(line, digest_size=16).digest())
                        places.append(k)
                many.append(len(places) - before)
            pairs = np.frombuffer(b"".join(hashes), dtype=np.int64).reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(len(many)), many))
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), batch.column(0).take(owner), batch.column(1).take(owner),
                 pa.array(places, pa.int32())],
                ["high", "low", "doc", "row", "pos"],
            )

    return rows.select("doc", "row", "text").mapInArrow(run, _LINES)


class _Key:
    """The lines of the key that a task is streaming: held until it is decided, then handed on as they come."""

    __slots__ = ("key", "docs", "last", "held", "first", "lead")

    def __init__(self, key: tuple[int, int], first: bool):
        self.key, self.first = key, first
        self.docs, self.last, self.lead = 0, object(), None
        self.held: list[tuple] = []


def _streamed(min_docs: int, keep_first: bool):
    """Reads lines sorted by key, document and place, and returns those of keys that enough documents have.

    At most ``min_docs`` - 1 documents' lines of one key are held. The first and the
    last key of a task may go on in other tasks; if too few documents have them
    here their lines are handed on as open, with a lead that counts the documents.
    """
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int8(), pa.int64()]
    names = ["high", "low", "doc", "row", "pos", "what", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Key | None = None
        out: list[tuple] = []

        def end(last: bool) -> None:
            """The key is over: its lead, and its lines if they are still open."""
            edge = now.first or last
            if edge:
                out.append((*now.key, *now.lead, _LEAD, now.docs))
                out.extend((*now.key, *x, _OPEN, None) for x in now.held)
            elif now.docs >= min_docs and not keep_first:
                out.append((*now.key, *now.lead, _DROP, None))

        for batch in batches:
            high, low = (batch.column(k).to_numpy() for k in (0, 1))
            turns = np.flatnonzero((high[1:] != high[:-1]) | (low[1:] != low[:-1])) + 1
            edges = [0, *turns.tolist(), len(high)]
            docs, rows, places = (batch.column(k).to_pylist() for k in (2, 3, 4))
            for a, b in zip(edges, edges[1:]):
                key = (int(high[a]), int(low[a]))
                if now is None or key != now.key:
                    if now is not None:
                        end(False)
                    now = _Key(key, now is None)
                for doc, row, pos in zip(docs[a:b], rows[a:b], places[a:b]):
                    line = (doc, row, pos)
                    if now.lead is None:
                        now.lead = line
                    if doc != now.last:
                        now.docs, now.last = now.docs + 1, doc
                        if now.docs == min_docs:
                            out.extend((*key, *x, _DROP, None) for x in now.held)
                            now.held = []
                    if line == now.lead:
                        continue
                    if now.docs >= min_docs:
                        out.append((*key, *line, _DROP, None))
                    else:
                        now.held.append(line)
            if len(out) >= 1 << 14:
                yield _batch(out, kinds, names)
                out.clear()
        if now is not None:
            end(True)
        yield _batch(out, kinds, names)

    return run


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def common_lines(found: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False) -> DataFrame:
    """(doc, row, pos) of the lines to drop, from a written table of ``lines``.

    Lines are dealt by ranges of (key, document) and sorted by place, so a key that
    a third of all lines have goes through many tasks. What these can't decide alone is settled by
    the leads, at most two rows a task.
    """
    dealt = found.repartitionByRange("high", "low", "doc").sortWithinPartitions("high", "low", "doc", "row", "pos")
    seen = stage(
        dealt.mapInArrow(_streamed(min_docs, keep_first), _LINES + ", what byte, docs long"), "line-verdicts"
    )
    where = F.struct("doc", "row", "pos")
    leads = seen.filter(F.col("what") == _LEAD).groupBy("high", "low").agg(
        F.sum("docs").alias("docs"), F.min(where).alias("first")
    )
    common = F.broadcast(leads.filter(F.col("docs") >= min_docs).select("high", "low", "first"))
    open_lines = seen.filter(F.col("what") != _DROP).join(common, ["high", "low"])
    if keep_first:
        open_lines = open_lines.filter(where != F.col("first"))
    return seen.filter(F.col("what") == _DROP).select("doc", "row", "pos").unionByName(open_lines.select("doc", "row", "pos"))


def bitmaps(dropped: DataFrame) -> DataFrame:
    """(doc, row, bits): one compressed bitmap for each row that loses lines.

    ``bits`` maps the number of a run of 64 lines to the bits of those that go; runs
    that lose nothing are left out.
    """
    word = dropped.groupBy("doc", "row", F.shiftright("pos", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("lost")
    )
    return word.groupBy("doc", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", "lost"))).alias("bits"))


def keep_bitmaps(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc, row, bits) as ``bitmaps`` has them, for ``documents`` of the same rows."""
    found = stage(lines(documents(docs, id_col, text_col), min_chars), "lines")
    return bitmaps(common_lines(found, min_docs, keep_first))


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, doc, row, text): ``doc`` says which rows are one document, ``row`` which of them are equal."""
    number, text = F.col(id_col).cast("long"), F.col(text_col)
    row = _row_key(number, text)
    return docs.select(number.alias("doc_id"), F.coalesce(number, row).alias("doc"), row.alias("row"), text.alias("text"))


def deduplicated(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep_first: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for every row of ``docs``: its text without the lines that many documents share.

    Lines end at line feeds. A line goes if its key (white space at its ends cut off,
    A-Z in lower case) has at least ``min_chars`` code points and comes in at least ``min_docs``
    documents; with ``keep_first`` the first one of each key stays, by document and
    place. Rows that share an id are one document for the count, as are rows without an id
    that have the same text; each keeps its own text, and repeated rows come out alike. Null
    and empty texts are one empty line. A text of nothing else than dropped lines
    becomes empty. Other columns are not read; no rows give no rows.
    """
    lost = keep_bitmaps(docs, min_docs, min_chars, keep_first, id_col, text_col)
    joined = documents(docs, id_col, text_col).join(lost, ["doc", "row"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, gone = [], [], []
            for text, bits in zip(batch.column(1), batch.column(2)):
                text, bits = text.as_py() or "", dict(bits.as_py() or ())
                sizes.append(text.count("\n") + 1)
                if not bits:
                    texts.append(text)
                    gone.append(0)
                    continue
                kept = [x for k, x in enumerate(text.split("\n")) if not bits.get(k >> 6, 0) >> (k & 63) & 1]
                texts.append("\n".join(kept))
                gone.append(sizes[-1] - len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.string())],
                ["doc_id", "n_lines", "n_dropped", "text"],
            )

    return joined.select("doc_id", "text", "bits").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text string")

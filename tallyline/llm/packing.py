"""Tokens of whole documents, and best-fit packing planned on the histogram of their lengths."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyline.llm.shared import WORD, partitions, stage

SEQUENCE = 4096
END = 1
#: Words and pieces of words whose ids a worker remembers, and the longest such word in characters.
REMEMBERED, LONGEST = 100_000, 64
# Words that only need lower case and a split before the merges: Latin letters
# up to U+017F are the same in composed form.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u017f]+").fullmatch
# Fixed value: the vocabulary's own split of a text into pieces.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
_MARKS = ".,;:!?|*#%$&"
_SEPARATORS = re.compile("[\x1c-\x1f]").search
_encoders: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes themselves, then from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: b for b in printable} | {b: 256 + k for k, b in enumerate(others)}


class Encoder(dict):
    """Ids of texts by a word-level BPE tokenizer, which never merges across white space.

    Such a tokenizer gives a text the ids of its words one after the other, so
    frequent words are encoded once and kept here. Plain words are split here and
    only their pieces go through the merges; all others go through the whole
    tokenizer. Ids come as packed little-endian 32-bit integers. The tests hold
    this against the tokenizer on whole texts.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.parts: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def __missing__(self, word: str) -> bytes:
        ids = self._word(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        found = self.parts.get(piece)
        if found is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            found = array("I", [x.id for x in self.merge(shown)]).tobytes()
            if len(piece) <= LONGEST:
                self.parts[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        if not _PLAIN(word) or "<|" in word:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
            return array("I", ids).tobytes()
        word = word.lower()
        if word.isalpha():
            return self._piece(word)
        stem = word.rstrip(_MARKS)
        if stem.isalpha():
            return self._piece(stem) + self._piece(word[len(stem):])
        return b"".join([self._piece(x) for x in _PIECES(word)])

    def pack(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        ids = self.__getitem__
        return [b"".join(map(ids, _words(x))) if x else b"" for x in texts]


def _words(text: str) -> list[str]:
    # Python takes these four for white space, the tokenizer doesn't.
    return re.findall(WORD, text) if _SEPARATORS(text) else text.split()


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(
    docs: DataFrame, vocabulary: str, length: int = SEQUENCE, end: int = END,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of every text and the end id, cut into pieces.

    ``ids`` is binary, little-endian 32-bit integers. Only documents of more than
    ``length`` ids are cut. A null text counts as empty: its piece is the end id.
    Repeated rows give their pieces again; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, width = encoder(vocabulary), np.uint32(end).tobytes(), 4 * length
        for batch in batches:
            ids, number, start, cut = [], [], [], []
            packed = own.pack(batch.column(1).to_pylist())
            for doc, text in zip(batch.column(0).to_pylist(), packed):
                text += last
                for k, at in enumerate(range(0, len(text), width)):
                    ids.append(doc)
                    number.append(k)
                    start.append(at // 4)
                    cut.append(text[at:at + width])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                 pa.array([len(x) // 4 for x in cut], pa.int64()), pa.array(cut, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan_slots(counts: dict[int, int], length: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram of lengths: rows (length, rank, n, each, sequence, offset).

    A row gives the ``n`` pieces of one length from ``rank`` on their places: the
    first ``each`` go one after the other into ``sequence`` from ``offset`` on, the
    next ``each`` into the following sequence, and so on. Sequences with the same
    room left are kept as runs of consecutive numbers, so the plan's size depends
    on the number of lengths, never on the number of pieces.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    # Runs (first sequence, number of sequences) by the room that is left in each.
    room: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]
    opened = 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        for free in range(size, length + 1):
            # Fits best into the least room; there it goes in as often as it fits.
            while left and room[free]:
                first, many = room[free].pop()
                each = free // size
                full = min(many, left // each)
                placed = full * each
                if full:
                    plan.append((size, rank, placed, each, first, length - free))
                    room[free - placed // full * size].append((first, full))
                    rank, left = rank + placed, left - placed
                if full < many and left:
                    # The last few fill one more sequence in part.
                    plan.append((size, rank, left, left, first + full, length - free))
                    room[free - left * size].append((first + full, 1))
                    full, left = full + 1, 0
                if full < many:
                    room[free].append((first + full, many - full))
            if not left:
                break
        if left:
            each = length // size
            full, over = divmod(left, each)
            if full:
                plan.append((size, rank, full * each, each, opened, 0))
                room[length - each * size].append((opened, full))
                rank, opened = rank + full * each, opened + full
            if over:
                plan.append((size, rank, over, over, opened, 0))
                room[length - over * size].append((opened, 1))
                opened += 1
    return plan


def place(cut: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """``cut`` (with doc_id, piece, length) with ``sequence_id`` and ``offset`` added to every row.

    The driver sees the histogram only, at most ``length`` rows. Pieces of one
    length are numbered in slices, so a length that a third of all pieces share is
    spread over all tasks. ``cut`` is read twice, so it should be a written table.
    """
    spark = cut.sparkSession
    slices = max(8, partitions(spark))
    rows = cut.withColumn("__slice", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(slices)).cast("int"))
    sizes = rows.groupBy("length", "__slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        F.col("length").alias("__l"), F.col("__slice").alias("__s"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__shift"),
    )
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(
        plan_slots(counts, length) or [(0, 0, 0, 1, 0, 0)],
        "__length long, __rank long, __n long, __each long, __sequence long, __offset long",
    )
    own = Window.partitionBy("length", "__slice").orderBy("doc_id", "piece")
    ranked = rows.withColumn("__own", F.row_number().over(own) - 1)
    ranked = ranked.join(
        shifts, (ranked["length"] == shifts["__l"]) & (ranked["__slice"] == shifts["__s"])
    ).withColumn("__at", F.col("__own") + F.col("__shift")).drop("__l", "__s", "__shift", "__own", "__slice")
    # The ranges of one length are sorted and cover its ranks without gaps. They
    # are few, and all of a length come as one array, searched by rank.
    entry = F.struct("__rank", "__n", "__each", "__sequence", "__offset")
    ranges = plan.groupBy("__length").agg(F.sort_array(F.collect_list(entry)).alias("__plan"))
    slotted = ranked.join(F.broadcast(ranges), F.col("length") == F.col("__length"))
    slotted = slotted.withColumn(
        "__slot", F.filter("__plan", lambda x: (x["__rank"] <= F.col("__at")) & (F.col("__at") < x["__rank"] + x["__n"]))[0]
    )
    step = F.col("__at") - F.col("__slot.__rank")
    return slotted.withColumn(
        "sequence_id", F.col("__slot.__sequence") + F.floor(step / F.col("__slot.__each"))
    ).withColumn(
        "offset", F.col("__slot.__offset") + step % F.col("__slot.__each") * F.col("length")
    ).drop("__at", "__slot", "__plan", "__length")


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, each at most one sequence long."""
    ids = cut.select("doc_id", "piece", "ids").join(
        placed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"]
    )
    parts = ids.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.concat_ws("", F.transform("p", lambda x: F.hex(x["ids"]))).alias("h")).select(
        "sequence_id", F.unhex("h").alias("ids")
    )


def pack(
    docs: DataFrame, vocabulary: str, length: int = SEQUENCE, end: int = END,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place.

    The ids themselves are checked by their CRC and need not be moved again; with
    ``pieces`` and ``sequences`` they can be written out.
    """
    cut = pieces(docs, vocabulary, length, end, id_col, text_col)
    narrow = stage(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return place(narrow, length)

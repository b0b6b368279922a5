"""Which tokens of two tokenizers cover the same bytes, and how often their ids go together in a corpus."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.shared import stage

#: Stretches of text whose tokens a worker remembers, and the longest of them in characters.
REMEMBERED, LONGEST = 800_000, 64
#: Stretches that go through the tokenizers together, in characters.
TOGETHER = 1 << 15
#: Links written out one by one in a group; larger groups are counted by their distinct ids.
WRITTEN_OUT = 1 << 12
#: Id pairs of documents that make a block.
BLOCK_PAIRS = 1 << 18

# A text may be cut before a blank or line feed between two other characters: both
# tokenizers begin a token there, whatever stands around it.
_CUT = re.compile(r"(?<=\S)[ \n](?=\S)")
_BLANK = "▁"
_aligners: dict[tuple[str, str], Aligner] = {}


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligner:
    """Groups of tokens that two tokenizers agree on, for whole texts.

    ``a`` is a byte-level BPE file, ``b`` a sentencepiece model that puts a blank
    before a text and has no piece with a blank after another character, or with a
    line feed. Then the tokens of a text are those of its stretches, and
    frequent stretches are encoded once. A stretch is kept as the groups' text,
    with ``+`` between the ids of A, and the codes of its links.
    """

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer, processors

        self.a = Tokenizer.from_file(a)
        # Their strings inside a text are ordinary text; offsets keep the blanks.
        self.a.encode_special_tokens = True
        self.a.post_processor = processors.ByteLevel(trim_offsets=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        byte = _bytes_of_letters()
        self.bytes_a = [self._letters(self.a.id_to_token(k), byte) for k in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace(_BLANK, " ").encode() for k, p in enumerate(pieces)
        ]
        self.parted = not any(_BLANK in p.lstrip(_BLANK) or "\n" in p for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.bytes_a, self.bytes_b))
        self.width = len(pieces)
        self.code = np.uint32 if len(self.bytes_a) * self.width < 1 << 32 else np.int64
        # Ids as they are written: followed by what separates them from the next one.
        self.written_a = [f"{k}{x}" for k in range(len(self.bytes_a)) for x in "+|"]
        self.written_b = [f"{k}{x}" for k in range(self.width) for x in ",;\n"]
        self.young: dict[str, tuple[str, bytes] | None] = {}
        self.old: dict[str, tuple[str, bytes] | None] = {}

    @staticmethod
    def _letters(token: str | None, byte: dict[str, int]) -> bytes:
        if token is None:
            return b""
        return bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of A and B over a text that begins with a blank or line feed, and the byte at which each token ends.

        None if the tokens' bytes are not those of the text. The tokenizers' own
        offsets give the ends; where several tokens share a character, or a piece is a
        single byte, the lengths of their bytes do.
        """
        whole = text.encode()
        found = self.a.encode(text, add_special_tokens=False)
        listed = found.ids
        ids_a = np.array(listed, dtype=np.int64)
        spans = np.fromiter(chain.from_iterable(found.offsets), dtype=np.int64, count=2 * len(listed)).reshape(-1, 2)
        led = text[0] == " "
        pieces = self.b.encode(text[1:] if led else text, return_type="proto", num_threads=1).pieces
        ids_b, ends_b = (np.array(x, dtype=np.int64) for x in ([p.id for p in pieces], [p.end for p in pieces]))
        if not led:
            # The blank that B puts before a text is a token of its own here.
            ids_b, ends_b = ids_b[1:], ends_b[1:]
        if b"".join(map(self.bytes_a.__getitem__, listed)) != whole:
            return None
        if b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) != whole:
            return None
        raw = np.frombuffer(whole, dtype=np.uint8)
        starts = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]
        sizes_a, sizes_b = self.size_a[ids_a], self.size_b[ids_b]
        ends_a = starts[spans[:, 1]]
        # Characters that two tokens share end with the second one.
        shared = np.r_[spans[1:, 0] < spans[:-1, 1], False]
        if shared.any():
            ends_a = np.where(shared, np.cumsum(sizes_a), ends_a)
        ends_b = ends_b + led
        single = sizes_b == 1
        if single.any():
            ends_b = np.where(single, np.cumsum(sizes_b), ends_b)
        return ids_a, ends_a, ids_b, ends_b

    def _written(self, ids_a, ids_b, many_a, many_b, closes) -> str:
        """The groups as text, with a line feed after each that ``closes`` a stretch."""
        group_a, group_b = np.repeat(np.arange(len(many_a)), many_a), np.repeat(np.arange(len(many_b)), many_b)
        end_a, end_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        end_a[np.cumsum(many_a) - 1] = 1
        end_b[np.cumsum(many_b) - 1] = 1 + closes
        # A's ids of a group, then B's.
        order = np.argsort(np.r_[group_a * 2, group_b * 2 + 1], kind="stable").tolist()
        shown = [
            *map(self.written_a.__getitem__, (ids_a * 2 + end_a).tolist()),
            *map(self.written_b.__getitem__, (ids_b * 3 + end_b).tolist()),
        ]
        return "".join(map(shown.__getitem__, order))

    def _links(self, ids_a, ids_b, many_a, many_b) -> np.ndarray:
        """A code for every link, group after group."""
        each = np.repeat(many_b, many_a)
        first = np.repeat(np.repeat(np.cumsum(many_b) - many_b, many_a), each)
        within = np.arange(len(first)) - np.repeat(np.cumsum(each) - each, each)
        return np.repeat(ids_a, each) * self.width + ids_b[first + within]

    def several(self, stretches: list[str]) -> list[tuple[str, bytes]] | None:
        """(groups, packed link codes) of short regular stretches that are encoded as one text."""
        text = "".join(stretches)
        found = self.tokens(text)
        if found is None:
            return None
        ids_a, ends_a, ids_b, ends_b = found
        both, many_a, many_b = _shared_ends(ends_a, ends_b)
        closes = np.isin(both, np.cumsum([len(x.encode()) for x in stretches]))
        texts = self._written(ids_a, ids_b, many_a, many_b, closes).split("\n")
        codes = self._links(ids_a, ids_b, many_a, many_b).astype(self.code)
        edges = (np.cumsum(many_a * many_b)[closes] * codes.itemsize).tolist()
        packed = codes.tobytes()
        return [(t, packed[a:b]) for t, a, b in zip(texts, [0, *edges], edges)]

    def one(self, stretch: str) -> tuple[str, np.ndarray, np.ndarray] | None:
        """(groups, distinct link codes, how often each comes) of any stretch, however large its groups are."""
        found = self.tokens(stretch)
        if found is None:
            return None
        ids_a, ends_a, ids_b, ends_b = found
        both, many_a, many_b = _shared_ends(ends_a, ends_b)
        text = self._written(ids_a, ids_b, many_a, many_b, np.zeros(len(both), dtype=bool))[:-1]
        large = many_a * many_b > WRITTEN_OUT
        in_a, in_b = np.repeat(~large, many_a), np.repeat(~large, many_b)
        code, n = np.unique(self._links(ids_a[in_a], ids_b[in_b], many_a[~large], many_b[~large]), return_counts=True)
        parts = [(code, n)]
        at_a, at_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        for g in np.flatnonzero(large):
            x, m = np.unique(ids_a[at_a[g]:at_a[g] + many_a[g]], return_counts=True)
            y, n = np.unique(ids_b[at_b[g]:at_b[g] + many_b[g]], return_counts=True)
            parts.append(((x[:, None] * self.width + y).ravel(), (m[:, None] * n).ravel()))
        return text, *_added(parts)

    def learn(self, keys: Iterable[str]) -> dict[str, tuple[str, bytes] | None]:
        """What is kept of stretches; None where the tokens' bytes are others."""
        out: dict[str, tuple[str, bytes] | None] = {}
        held: list[str] = []
        size = 0
        for key in keys:
            held.append(key)
            size += len(key)
            if size >= TOGETHER:
                self._together(held, out)
                held, size = [], 0
        if held:
            self._together(held, out)
        return out

    def _together(self, keys: list[str], out: dict[str, tuple[str, bytes] | None]) -> None:
        found = self.several([k if k[0] == "\n" else " " + k for k in keys])
        if found is not None:
            out.update(zip(keys, found))
        elif len(keys) == 1:
            out[keys[0]] = None
        else:
            half = len(keys) // 2
            self._together(keys[:half], out)
            self._together(keys[half:], out)

    def texts(self, texts: list[str | None]) -> list[tuple[str, np.ndarray, np.ndarray] | None]:
        """(groups with ``+`` between A's ids, distinct link codes, how often each comes) of every text.

        None for a null or empty text and for one whose tokens' bytes are others.
        """
        if len(self.young) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
        missing: set[str] = set()
        split = [self._split(x, missing) for x in texts]
        again = missing & self.old.keys()
        self.young.update((k, self.old[k]) for k in again)
        self.young.update(self.learn(missing - again))
        return [self._joined(parts) if parts else None for parts in split]

    def _split(self, text: str | None, missing: set[str]) -> list[str | tuple[str]]:
        """The stretches of a text: a string for one that is remembered, a tuple for one that is encoded for itself.

        Strings that are not remembered yet are added to ``missing``.
        """
        if not text:
            return []
        if not self.parted:
            return [(" " + text,)]
        keys = text.replace("\n", " \n").split(" ")
        new = set(keys).difference(self.young, missing)
        if all(map(_regular, new)):
            missing |= new
            return keys
        led = " " + text
        cuts = [0, *(m.start() for m in _CUT.finditer(led)), len(led)]
        chunks = (led[a:b] for a, b in zip(cuts, cuts[1:]))
        # A first stretch may begin with several blanks or line feeds.
        keyed = ((c, c if c[0] == "\n" else c[1:]) for c in chunks)
        parts = [k if _regular(k) and not c.startswith(" \n") else (c,) for c, k in keyed]
        missing |= {k for k in parts if type(k) is str}.difference(self.young)
        return parts

    def _joined(self, parts: list[str | tuple[str]]) -> tuple[str, np.ndarray, np.ndarray] | None:
        alone: list[tuple[str, np.ndarray, np.ndarray] | None] = []
        try:
            found = [self.young[p] for p in parts]
        except KeyError:
            # Some stretches are encoded for themselves.
            alone = [self.one(p[0]) for p in parts if type(p) is tuple]
            if None in alone:
                return None
            own = iter(alone)
            found = [(next(own)[0], b"") if type(p) is tuple else self.young[p] for p in parts]
        if None in found:
            return None
        shown, packed = zip(*found)
        codes, n = np.unique(np.frombuffer(b"".join(packed), dtype=self.code), return_counts=True)
        codes = codes.astype(np.int64)
        return (";".join(shown), *(_added([(codes, n), *(x[1:] for x in alone)]) if alone else (codes, n)))


def _regular(key: str) -> bool:
    """Whether a stretch without its leading blank can stand among others: short, and no white space at its ends."""
    first = key[1:2] if key[:1] == "\n" else key[:1]
    return bool(first) and not first.isspace() and not key[-1].isspace() and len(key) <= LONGEST and _BLANK not in key


def _shared_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes at which tokens of both end, and how many tokens of each lie between them."""
    both = np.intersect1d(ends_a, ends_b)
    last_a, last_b = np.searchsorted(ends_a, both, "right"), np.searchsorted(ends_b, both, "right")
    return both, np.diff(last_a, prepend=0), np.diff(last_b, prepend=0)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    n = np.zeros(len(code), dtype=np.int64)
    np.add.at(n, back, np.concatenate([n for _, n in parts]))
    return code, n


def aligner(a: str, b: str) -> Aligner:
    """The worker's aligner for two vocabulary files."""
    if (a, b) not in _aligners:
        _aligners[a, b] = Aligner(a, b)
    return _aligners[a, b]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a million characters each."""
    at = size = 0
    for k, x in enumerate(texts):
        size += len(x or "")
        if size >= 1 << 20:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def groups(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): which tokens of the vocabulary files ``a`` and ``b`` cover the same bytes.

    Groups are written ``a1,a2|b1;a3|b2,b3``: ids of ``a`` and ``b`` in their order. Empty
    for null and empty texts, and where a tokenizer doesn't give the text's bytes back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for start, stop in _slices(texts):
                found = [x[0].replace("+", ",") if x else "" for x in own.texts(texts[start:stop])]
                yield pa.RecordBatch.from_arrays([ids[start:stop], pa.array(found, pa.string())], ["doc_id", "groups"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, groups string")


BLOCK = (
    "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, size array<long>, at binary, n binary, pairs binary, docs binary"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def blocks(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Blocks of about BLOCK_PAIRS id pairs of documents: the block's different pairs, and for each document places in them.

    ``pairs`` and ``docs`` are the pairs' codes and in how many of the block's rows they
    come; ``at`` and ``n`` (in as few bytes as they need) give, document after document, the place of each of its ``size``
    pairs and how many links it has there.
    """
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 4]
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a, b)
        held: list[tuple] = []
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        size, block = 0, TaskContext.get().partitionId() << 32

        def whole() -> pa.RecordBatch:
            pairs, at, docs = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
            n = np.concatenate(counts).astype(np.int64)
            # As many bytes each as the largest needs.
            n = n.astype(np.min_scalar_type(int(n.max(initial=0))))
            row = (
                block, *map(list, zip(*held)), [len(x) for x in codes], at.astype(np.uint32).tobytes(),
                n.tobytes(), pairs.astype(np.int64).tobytes(), docs.astype(np.int64).tobytes(),
            )
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, stop in _slices(texts):
                for doc, found in zip(ids[start:stop], own.texts(texts[start:stop])):
                    if found is None:
                        held.append((doc, 0, 0, 0, 0, ""))
                        codes.append(np.zeros(0, dtype=np.int64))
                        counts.append(np.zeros(0, dtype=np.int64))
                        continue
                    shown, code, n = found
                    many = shown.count("|")
                    digest = hashlib.sha256(shown.replace("+", ",").encode()).hexdigest()
                    held.append((doc, shown.count("+") + many, shown.count(",") + many, many, int(n.sum()), digest))
                    codes.append(code)
                    counts.append(n)
                    size += len(code)
                    if size >= BLOCK_PAIRS:
                        yield whole()
                        held, codes, counts, size, block = [], [], [], 0, block + 1
        if held:
            yield whole()

    return rows.select("doc_id", "text").mapInArrow(run, BLOCK)


def _pairs(held: DataFrame) -> DataFrame:
    """(block, at, pair, docs): the different id pairs of every block by their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, docs in zip(*(batch.column(k) for k in range(3))):
                code, n = (np.frombuffer(x.as_py(), dtype=np.int64) for x in (pairs, docs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), block.as_py())), pa.array(np.arange(len(code))), pa.array(code), pa.array(n)],
                    ["block", "at", "pair", "docs"],
                )

    return held.select("block", "pairs", "docs").mapInArrow(run, "block long, at long, pair long, docs long")


def pair_counts(each: DataFrame, width: int) -> DataFrame:
    """(pair, count, best): in how many documents an id pair is linked, and whether no pair of its id of A is in more.

    A pair's code is its id of A times ``width`` (the ids of B) plus its id of B. The
    highest counts are one row per id of A, so at most a vocabulary.
    """
    counts = each.groupBy("pair").agg(F.sum("docs").alias("count")).withColumn("a", F.floor(F.col("pair") / width))
    counts = stage(counts, "align-counts")
    highest = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(F.broadcast(highest), "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def aligned(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of ``docs``.

    ``a`` is a byte-level BPE file and gets a blank before each text, ``b`` a sentencepiece
    model that adds it. Bytes at which tokens of both end cut them into groups
    (``groups`` gives these as text); each A and B token of one group are a link. The
    count of an id pair is the number of rows that hold it linked; ``n_best`` are the links
    whose count is the highest of their A id, ``count_sum`` is over all links. Null
    and empty texts, and those whose bytes a tokenizer doesn't give back, have zeros
    and an empty digest. Repeated rows and rows without an id are documents of their
    own. Other columns are not read; no rows give no rows.

    Each block of documents adds up its own pairs first. Only different pairs of
    blocks are shuffled, never links.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # Few rows, and large ones: they are written as they come.
    held = stage(blocks(rows, a, b), "align-blocks", {"parquet.block.size": 8 << 20})
    each = _pairs(held)
    width = aligner(a, b).width
    known = pair_counts(each, width)
    answers = each.join(known, "pair").select("block", "at", "count", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        order = np.argsort(right.column("at").to_numpy())
        count = right.column("count").to_numpy()[order]
        best = right.column("best").to_numpy()[order]
        at = np.frombuffer(row["at"], dtype=np.uint32)
        n = np.frombuffer(row["n"], dtype=f"u{len(row['n']) // max(len(at), 1) or 1}").astype(np.int64)
        owner = np.repeat(np.arange(len(row["size"])), row["size"])
        n_best, total = (np.zeros(len(row["size"]), dtype=np.int64) for _ in range(2))
        np.add.at(n_best, owner, n * best[at])
        np.add.at(total, owner, n * count[at])
        return pa.table({
            **{c: pa.array(row[c], pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
            "n_best": n_best, "count_sum": total, "groups_sha256": pa.array(row["groups_sha256"], pa.string()),
        })

    kept = held.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "size", "at", "n")
    return kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, RESULT)

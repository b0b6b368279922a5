"""Scoring texts by a backoff n-gram automaton trained on the corpus itself."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.shared import partitions, stage

#: Order of the model.
ORDER = 3
#: Words need this share of all training tokens to be part of n-grams: none, every word is.
WORD_SHARE = 0.0
#: N-grams need this share to be states and arcs: none, one occurrence is enough at every size.
NGRAM_SHARE = 0.0
#: What is taken from every count of a longer n-gram and handed down to shorter ones.
DISCOUNT = 0.75
#: Added to every unigram count.
ALPHA = 0.5
#: The document remainder (crc32 of the id modulo FOLDS) that is held out.
FOLDS, HELD_OUT = 5, 1
#: Different words that a task adds up before it hands them on.
GATHERED = 400_000
#: Tokens of a block of documents, and of all blocks whose n-grams meet in one part.
BLOCK_TOKENS, PART_TOKENS = 1 << 18, 1 << 20
#: Tokens of a stretch of a text that the automaton reads at one go, beside other stretches.
STRETCH = 1024
#: Bits of a word's hash that tell the followers of one bigram apart, and the bit that tells these from numbers of common words.
FOLLOWER, RARE = np.uint64((1 << 48) - 1), np.uint64(1 << 48)
#: Words that are sent as a number of two bytes, and the blocks that tell which these are.
COMMON, DRAWN = (1 << 16) - 2, 32
#: Lets Spark remove the shuffle files of a write when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
END = b""


def tokens(text: str | None) -> list[bytes]:
    """The words in lower case (A-Z only) and the end of the text."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


class Automaton:
    """Weighted backoff automaton: a state per history, arcs for seen n-grams, one failure arc per state.

    State 0 has no history, state 1 + k the word number k of ``width`` words, and
    longer histories follow. ``keys`` are the arcs in order, each as state * width +
    word, with their log10 ``weights`` and the state each leads ``to``. The failure arc
    of a state leads to the state of the next shorter history, ``fail``, at the log10 weight
    ``cost``. State 0 has no failure arc: there every word has an arc, of weight
    ``base[word]`` to ``first[word]``, and words without a state lead back to 0.
    """

    def __init__(
        self, base: np.ndarray, first: np.ndarray, fail: np.ndarray, cost: np.ndarray, keys: np.ndarray, weights: np.ndarray,
        to: np.ndarray,
    ):
        self.base, self.first, self.fail, self.cost, self.width = base, first, fail, cost, len(base)
        order = np.argsort(keys)
        # The last key is that of no arc.
        self.keys = np.r_[keys[order], np.iinfo(np.int64).max]
        self.weights, self.to = np.r_[weights[order], 0.0], np.r_[to[order], 0]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of a word after each state, and the state it leads to."""
        passed, reached = self.base[word], self.first[word]
        on = np.flatnonzero(state)
        at, read, spent = state[on], word[on], np.zeros(len(on))
        while len(on):
            key = at * self.width + read
            arc = np.searchsorted(self.keys, key)
            found = self.keys[arc] == key
            passed[on[found]] = spent[found] + self.weights[arc[found]]
            reached[on[found]] = self.to[arc[found]]
            lost = ~found
            on, at, read = on[lost], at[lost], read[lost]
            spent, at = spent[lost] + self.cost[at], self.fail[at]
            over = at == 0
            passed[on[over]] += spent[over]
            on, at, read, spent = on[~over], at[~over], read[~over], spent[~over]
        return passed, reached

    def scores(self, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
        """log10 probability of every text, each read once from left to right with its state carried along.

        Texts are read beside each other, a word of each at a time. Long ones are read in
        stretches: a state knows ``order`` - 1 words, so that many words before
        a stretch, read without adding them up, lead to the state it begins in.
        """
        pieces = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), pieces)
        inner = (np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * STRETCH
        lead = np.minimum(inner, order - 1)
        begin, size = starts[text] + inner - lead, np.minimum(sizes[text] - inner, STRETCH) + lead
        longest = np.argsort(-size, kind="stable")
        text, lead, begin, size = text[longest], lead[longest], begin[longest], size[longest]
        state, total, shrink = np.zeros(len(text), dtype=np.int64), np.zeros(len(text)), -size
        for k in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(shrink, -k))
            weight, state[:live] = self.step(state[:live], words[begin[:live] + k])
            total[:live] += np.where(lead[:live] > k, 0.0, weight) if k < order - 1 else weight
        return np.bincount(text, weights=total, minlength=len(sizes))


def unigram(count: int, total: int, distinct: int) -> float:
    return (count + ALPHA) / (total + ALPHA * (distinct + 1))


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, count) over all tokens of the texts, added up in every task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                if len(held) >= GATHERED:
                    yield _counted(held)
                    held = Counter()
        yield _counted(held)

    return rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("count"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"]
    )


def _packed(x: np.ndarray) -> bytes:
    """Non-negative numbers, byte by byte of equal weight, compressed; the first byte tells how many bytes a number has."""
    kind = x.dtype if x.dtype == np.uint64 else np.min_scalar_type(int(x.max()) if len(x) else 0)
    planes = x.astype(kind, copy=False).view(np.uint8).reshape(-1, kind.itemsize).T
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(x: pa.Buffer, kind: type = np.int64) -> np.ndarray:
    x = memoryview(x)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x[1:]), dtype=np.uint8).reshape(x[0], -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"u{x[0]}").astype(kind, copy=False)


def _rising(keys: np.ndarray) -> bytes:
    """Hashes in order as the steps from one to the next, whose upper bytes are zero. In another order they come back too."""
    return _packed(np.r_[keys[:1], np.diff(keys)])


def _risen(x: pa.Buffer) -> np.ndarray:
    return np.cumsum(_unpacked(x, np.uint64), dtype=np.uint64)


def _rows(found: pa.Table | pa.RecordBatch) -> list[dict]:
    """The rows, their binary columns as views of the Arrow buffers."""
    return [
        {n: c[k].as_buffer() if pa.types.is_binary(c.type) else c[k].as_py() for n, c in zip(found.schema.names, found.columns)}
        for k in range(found.num_rows)
    ]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of two hashes in their order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each of ``parts`` equal ranges of hashes begins and ends in sorted ``keys``."""
    edges = np.array([(k << 64) // parts for k in range(1, parts)], dtype=np.uint64)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


BLOCK = (
    "block long, doc_id array<long>, held_out array<boolean>, size array<long>, train long, ids binary, words binary, "
    "usable binary"
)
REQUEST = (
    "part long, block long, keys binary, n binary, sizes binary, next binary, rare binary, next_n binary, own binary, "
    "passed binary"
)
ANSWER = "block long, part long, count binary, arcs binary, lost binary, first binary, next binary, total long"


def blocks(rows: DataFrame, vocabulary: frozenset[bytes] | None = None) -> DataFrame:
    """Documents in blocks of about BLOCK_TOKENS tokens: their words by number, and the hash of each number's word.

    Words are numbered by how often the block has them, and by their hashes where that is the same. ``rows`` are (doc_id, text, held_out). A word is usable in n-grams if it is
    in the vocabulary, without one always.
    """
    sent = rows.sparkSession.sparkContext.broadcast(vocabulary)
    names = [x.split()[0] for x in BLOCK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        docs: list[tuple[int | None, bool]] = []
        ids: list[np.ndarray] = []
        size, block = 0, TaskContext.get().partitionId() << 32

        def whole() -> pa.RecordBatch:
            sizes = [len(x) for x in ids]
            found = np.concatenate(ids)
            hashes = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in number), dtype="<u8")
            sort = np.lexsort((hashes, -np.bincount(found)))
            place = np.empty(len(sort), dtype=np.int64)
            place[sort] = np.arange(len(sort))
            usable = np.array([known is None or w in known for w in number])[sort].tobytes()
            row = (
                block, [d[0] for d in docs], [d[1] for d in docs], sizes,
                sum(n for n, d in zip(sizes, docs) if not d[1]), _packed(place[found]), _rising(hashes[sort]), usable,
            )
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        for batch in batches:
            for doc, text, held in zip(*(batch.column(k) for k in range(3))):
                split = tokens(text.as_py())
                ids.append(np.fromiter(map(number.__getitem__, split), dtype=np.int32, count=len(split)))
                docs.append((doc.as_py(), held.as_py()))
                size += len(split)
                if size >= BLOCK_TOKENS:
                    yield whole()
                    number.clear()
                    docs, ids, size, block = [], [], 0, block + 1
        if docs:
            yield whole()

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, BLOCK)


class Block:
    """The n-grams of a block: word numbers, bigrams (usable words only) and what follows each of them.

    ``pairs`` are the bigrams' two words, in the order of the bigrams' hashes ``keys``. An
    entry is a bigram (``entry_past``), a usable word after it (``entry_word``) and the bigram
    these end with (``entry_last``). An entry without a usable word, or at the end
    of a text, has word -1: the bigram was there and no arc leaves it. ``longer`` leaves the entries out.
    """

    def __init__(self, row: dict, order: int, longer: bool = True):
        self.ids = t = _unpacked(row["ids"])
        self.words = _risen(row["words"])
        self.usable = usable = np.frombuffer(row["usable"], dtype=np.uint8) > 0
        self.doc_id, self.held_out, self.size = row["doc_id"], row["held_out"], np.array(row["size"], dtype=np.int64)
        width, n = len(self.words), len(t)
        self.starts = np.cumsum(self.size) - self.size
        self.counts = np.repeat(~np.array(self.held_out, dtype=bool), self.size).astype(np.int64)
        # Words in the order of their hashes.
        self.sorted = np.argsort(self.words)
        ends = np.zeros(n, dtype=bool)
        ends[self.starts + self.size - 1] = True
        # Whether a token has a word before it to lead to it.
        led = np.r_[False, ~ends[:-1] & usable[t[:-1]]] if order > 1 else np.zeros(n, dtype=bool)
        bigram = np.full(n, -1)
        at = np.flatnonzero(led & usable[t])
        code, back = np.unique(t[at - 1] * width + t[at], return_inverse=True)
        a, b = code // width, code % width
        hashed = _mixed(self.words[a], self.words[b])
        sort = np.argsort(hashed)
        place = np.empty(len(sort), dtype=np.int64)
        place[sort] = np.arange(len(sort))
        bigram[at] = place[back]
        self.pairs, self.keys = (a[sort], b[sort]), hashed[sort]
        if not longer:
            return
        past = np.where(led, np.r_[-1, bigram[:-1]], -1)
        follows = np.flatnonzero(past >= 0)
        last = np.flatnonzero(ends & (bigram >= 0))
        # Word 0 stands for no arc.
        word = np.where(usable[t[follows]], t[follows] + 1, 0) if order > 2 else np.zeros(len(follows), dtype=np.int64)
        code, one, back = np.unique(
            np.r_[past[follows], bigram[last]] * (width + 1) + np.r_[word, np.zeros(len(last), dtype=np.int64)],
            return_index=True, return_inverse=True,
        )
        self.entry_n = np.bincount(back, weights=np.r_[self.counts[follows], self.counts[last]], minlength=len(code)).astype(np.int64)
        self.entry_past, self.entry_word = code // (width + 1), code % (width + 1) - 1
        self.entry_last = np.where(self.entry_word >= 0, np.r_[bigram[follows], bigram[last]][one], -1)
        self.entries = np.bincount(self.entry_past, minlength=len(self.keys))


def _request(parts: int, cuts: np.ndarray, block: int, columns: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple]:
    """A row for each part: of every column its slice, by the cuts given with it. The first column is that of the hashes."""
    out = []
    for part in np.flatnonzero(np.diff(cuts)).tolist():
        keys, *row = (x[c[part]:c[part + 1]] for x, c in columns)
        out.append((part, block, _rising(keys), *map(_packed, row)))
    return out


def _table(rows: list[tuple], kinds: str) -> pa.Table:
    names, types = zip(*(x.split() for x in kinds.split(", ")))
    return pa.table(
        [pa.array([r[k] for r in rows], pa.int64() if t == "long" else pa.binary()) for k, t in enumerate(types)], names=list(names),
    )


def _staged(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` from the written table. What was shuffled for it is read by nothing else and goes when it is written."""
    conf = rows.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return stage(rows, label)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def frequent(held: DataFrame, many: int) -> np.ndarray:
    """Hashes of the words found most often in about DRAWN of the ``many`` blocks, the most frequent first.

    They only make the followers shorter. Words that are not among them are sent by their hash,
    and all words of all blocks are counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                words = _risen(row["words"])
                n = np.bincount(_unpacked(row["ids"]), minlength=len(words))
                often = n > 1
                yield pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(n[often])], ["word", "n"])

    drawn = held.filter(F.pmod(F.xxhash64("block"), F.lit(max(many, 1))) < DRAWN).select("ids", "words")
    counted = drawn.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = _staged(counted.orderBy(F.desc("n"), "word").limit(COMMON), "lm-common").toArrow()
    word, n = (best[c].to_numpy() for c in ("word", "n"))
    return word[np.lexsort((word, -n))].view(np.uint64)


def _numbered(words: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The number of every word, from 2 on in the order of ``common``; 1 for words that are not there."""
    if not len(common):
        return np.ones(len(words), dtype=np.int64)
    order = np.argsort(common)
    at = order[np.minimum(np.searchsorted(common, words, sorter=order), len(common) - 1)]
    return np.where(common[at] == words, at + 2, 1)


def bigram_requests(held: DataFrame, order: int, parts: int, common: np.ndarray | None = None) -> DataFrame:
    """Every block's bigrams and their followers with their training counts, by ranges of the bigrams' hashes.

    Followers among the ``common`` words are sent by their numbers there, others by their hashes.
    """
    sent = held.sparkSession.sparkContext.broadcast(np.zeros(0, dtype=np.uint64) if common is None else common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                b = Block(row, order)
                cuts = _cuts(b.keys, parts)
                inner = np.r_[0, np.cumsum(b.entries)][cuts]
                none = np.zeros(0, dtype=np.int64), np.zeros(parts + 1, dtype=np.int64)
                # Inside one bigram a part of its hash tells a rare word (1); 0 is no word.
                follower = np.where(b.entry_word < 0, 0, _numbered(b.words, sent.value)[b.entry_word])
                rare = follower == 1
                hashes = b.words[b.entry_word[rare]] & FOLLOWER
                rows = _request(parts, cuts, row["block"], [
                    (b.keys, cuts), none, (b.entries, cuts), (follower, inner), (hashes, np.r_[0, np.cumsum(rare)][inner]),
                    (b.entry_n, inner), none, none,
                ])
                yield from _table(rows, REQUEST).to_batches()

    return held.mapInArrow(run, REQUEST)


def bigram_answers(requests: DataFrame, least: float) -> DataFrame:
    """What all blocks together hold: counts of bigrams, their arcs and what these leave, counts of the arcs.

    ``first`` marks, for each bigram, one block that has it in its training texts.
    """

    def run(found: pa.Table) -> pa.Table:
        rows = sorted(_rows(found), key=lambda r: r["block"])
        keys = [_risen(r["keys"]) for r in rows]
        sizes = np.concatenate([_unpacked(r["sizes"]) for r in rows])
        word = np.concatenate([_unpacked(r["next"], np.uint64) for r in rows])
        word[word == 1] = np.concatenate([_unpacked(r["rare"], np.uint64) for r in rows]) | RARE
        n = np.concatenate([_unpacked(r["next_n"]) for r in rows])
        distinct, group = np.unique(np.concatenate(keys), return_inverse=True)
        owner = np.repeat(group, sizes)
        code, one, back = np.unique(
            word + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True, return_inverse=True
        )
        total = np.bincount(back, weights=n, minlength=len(code)).astype(np.int64)
        count = np.bincount(owner, weights=n, minlength=len(distinct)).astype(np.int64)
        arc = (total >= max(least, 1)) & (word[one] != 0)
        arcs = np.bincount(owner[one][arc], minlength=len(distinct))
        kept = np.bincount(owner[one][arc], weights=total[arc], minlength=len(distinct)).astype(np.int64)
        trained = np.flatnonzero(np.add.reduceat(n, np.cumsum(sizes) - sizes) > 0)
        first = np.zeros(len(group), dtype=np.int64)
        first[trained[np.unique(group[trained], return_index=True)[1]]] = 1
        following = np.where(arc, total, 0)[back]
        out, at, inner = [], 0, 0
        for r, k in zip(rows, keys):
            g, end = group[at:at + len(k)], inner + int(sizes[at:at + len(k)].sum())
            out.append((
                r["block"], r["part"], _packed(count[g]), _packed(arcs[g]), _packed((count - kept)[g]),
                _packed(first[at:at + len(k)]), _packed(following[inner:end]), 0,
            ))
            at, inner = at + len(k), end
        return _table(out, ANSWER)

    return requests.groupBy("part").applyInArrow(run, ANSWER)


def _joined(answers: list[dict], column: str) -> np.ndarray:
    """One block's answers in the order of its hashes."""
    return np.concatenate([np.zeros(0, dtype=np.int64), *(_unpacked(r[column]) for r in answers)])


def word_requests(held: DataFrame, answers: DataFrame, order: int, least: float, parts: int) -> DataFrame:
    """Every block's words with their training counts, and the arcs that its own first bigrams are."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = _rows(left)[0]
        b = Block(row, order, longer=False)
        found = sorted(_rows(right), key=lambda r: r["part"])
        count = _joined(found, "count")
        arc = (_joined(found, "first") > 0) & (count >= max(least, 1))
        width = len(b.words)
        own = np.bincount(b.pairs[0][arc], minlength=width)
        passed = np.bincount(b.pairs[0][arc], weights=count[arc], minlength=width).astype(np.int64)
        n = np.bincount(b.ids, weights=b.counts, minlength=width).astype(np.int64)
        keys = b.words[b.sorted]
        cuts = _cuts(keys, parts)
        none = np.zeros(0, dtype=np.int64), np.zeros(parts + 1, dtype=np.int64)
        return _table(_request(parts, cuts, row["block"], [
            (keys, cuts), (n[b.sorted], cuts), none, none, none, none, (own[b.sorted], cuts), (passed[b.sorted], cuts),
        ]), REQUEST)

    # Counts of arcs, most of the answers, stay out of this shuffle.
    needed = answers.select("block", "part", "count", "first")
    return held.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(run, REQUEST)


def word_answers(requests: DataFrame) -> DataFrame:
    """Counts of words, their arcs and what these leave; ``total`` of block -1 is a part's number of different words."""

    def run(found: pa.Table) -> pa.Table:
        rows = sorted(_rows(found), key=lambda r: r["block"])
        keys = [_risen(r["keys"]) for r in rows]
        distinct, group = np.unique(np.concatenate(keys), return_inverse=True)
        count, arcs, kept = (
            np.bincount(group, weights=np.concatenate([_unpacked(r[c]) for r in rows]), minlength=len(distinct)).astype(np.int64)
            for c in ("n", "own", "passed")
        )
        none = _packed(np.zeros(0, dtype=np.int64))
        out, at = [(-1, rows[0]["part"], none, none, none, none, none, int((count > 0).sum()))], 0
        for r, k in zip(rows, keys):
            g = group[at:at + len(k)]
            # Parts of words come before those of bigrams.
            out.append((r["block"], -1 - r["part"], _packed(count[g]), _packed(arcs[g]), _packed((count - kept)[g]), none, none, 0))
            at += len(k)
        return _table(out, ANSWER)

    return requests.groupBy("part").applyInArrow(run, ANSWER)


def automaton(b: Block, words: list[dict], bigrams: list[dict], total: int, distinct: int, least: float) -> tuple[Automaton, np.ndarray]:
    """The states and arcs that a block's texts can reach, and the training counts of its words.

    What the arcs of a state take less than it was seen, and what pruned followers
    had, is the weight of its failure arc; an arc has its own share and that of its word in the
    shorter history.
    """
    width, pairs = len(b.words), len(b.keys)
    count, arcs, lost = (np.empty(width, dtype=np.int64) for _ in range(3))
    for into, column in ((count, "count"), (arcs, "arcs"), (lost, "lost")):
        into[b.sorted] = _joined(words, column)
    single = (count + ALPHA) / (total + ALPHA * (distinct + 1))
    c2, arcs2, lost2, c3 = (_joined(bigrams, x) for x in ("count", "arcs", "lost", "next"))
    one, two = 1 + np.arange(width), 1 + width + np.arange(pairs)
    seen = count > 0
    fail, left = np.zeros(1 + width + pairs, dtype=np.int64), np.ones(1 + width + pairs)
    left[one[seen]] = (lost + DISCOUNT * arcs)[seen] / count[seen]
    there = c2 > 0
    left[two[there]] = (lost2 + DISCOUNT * arcs2)[there] / c2[there]
    past, last = b.pairs
    fail[two] = one[last]

    def taken(n: np.ndarray) -> np.ndarray:
        return np.where(n >= max(least, 1), n - DISCOUNT, 0.0)

    after = left[one[past]] * single[last] + taken(c2) / np.maximum(count[past], 1)
    short = np.flatnonzero(c2 >= max(least, 1))
    long = np.flatnonzero((b.entry_word >= 0) & (c3 >= max(least, 1)))
    state, ends = b.entry_past[long], b.entry_last[long]
    weight = left[two[state]] * after[ends] + taken(c3[long]) / c2[state]
    made = Automaton(
        np.log10(single), np.where(seen & b.usable, one, 0), fail, np.log10(left),
        np.r_[one[past[short]] * width + last[short], two[state] * width + b.entry_word[long]],
        np.log10(np.r_[after[short], weight]), np.r_[two[short], two[ends]],
    )
    return made, count


def scored(
    docs: DataFrame, order: int = ORDER, word_share: float = WORD_SHARE, ngram_share: float = NGRAM_SHARE,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``score`` is the model's log10 probability of the text, ``base_score`` that of
    single tokens. Null and empty texts are the end token alone. Rows with a null
    doc_id take part in the training. Repeated rows count as often as they come.
    Nothing is learned from a table without training rows: all counts are zero.
    Other columns are not read. ``order`` is 1, 2 or 3.

    The model is never in one place. Each block of documents adds up its n-grams,
    counts are settled by ranges of hashes, and every block gets back the
    counts of its own n-grams: the states and arcs of the automaton its texts are read by.
    Shares above 0 make a smaller model.
    """
    number = F.col(id_col).cast("long")
    rows = docs.select(
        number.alias("doc_id"), F.col(text_col).alias("text"),
        F.coalesce(F.crc32(number.cast("string")) % FOLDS == HELD_OUT, F.lit(False)).alias("held_out"),
    )
    vocabulary = None
    if word_share > 0:
        totals = _staged(word_counts(rows.filter("NOT held_out")), "lm-words")
        least = word_share * (totals.agg(F.sum("count")).first()[0] or 0)
        # At most 1 / share.
        vocabulary = frozenset(bytes(r["word"]) for r in totals.filter(F.col("count") >= least).collect())
    held = _staged(blocks(rows, vocabulary), "lm-blocks")
    size, total, many = held.agg(
        F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x)), F.sum("train"), F.count("*")
    ).first()
    size, total = size or 0, total or 0
    least = ngram_share * total
    parts = max(partitions(docs.sparkSession), -(-size // PART_TOKENS))
    # A block has far fewer words than n-grams.
    few = max(1, parts // 16)
    bigrams = _staged(bigram_answers(bigram_requests(held, order, parts, frequent(held, many)), least), "lm-bigrams")
    words = _staged(word_answers(word_requests(held, bigrams, order, least, few)), "lm-words")
    distinct = words.filter("block = -1").agg(F.sum("total")).first()[0] or 0
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(_rows(left)[0], order)
        found = sorted(_rows(right), key=lambda r: r["part"])
        single = [r for r in found if r["part"] < 0][::-1]
        made, count = automaton(b, single, [r for r in found if r["part"] >= 0], total, distinct, least)
        known = np.add.reduceat((count[b.ids] > 0).astype(np.int64), b.starts)
        base, score = np.add.reduceat(made.base[b.ids], b.starts), made.scores(b.ids, b.starts, b.size, order)
        return pa.table({
            "doc_id": pa.array(b.doc_id, pa.int64()), "held_out": pa.array(b.held_out, pa.bool_()), "n_tokens": b.size,
            "n_known": known, "train_tokens": pa.array([total] * len(known), pa.int64()), "base_score": base, "score": score,
        })

    answers = bigrams.unionByName(words.filter("block >= 0")).drop("first", "total")
    return held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, kind)

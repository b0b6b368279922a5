"""Conversations put back into the order system, user, assistant, user, assistant at the least cost.

A conversation is a string of symbols, one for each row: the role's first letter and
what is wrong with the row. Costs of repair go backwards over the runs of equal symbols; a
run of n rows is one product with the n-th min-plus power of its symbol's
matrix, made of cached binary powers. The edits themselves are then read off forwards.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.shared import stage

#: Costs of the edits, and what a truncated row costs that is not deleted.
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
# What the repaired roles can be so far: nothing, a system row, a user row last, an assistant row last.
_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
# The letter that may come next and where it leads; a system row only before all others.
_NEXT = {_NONE: ("u", _USER), _SYSTEM: ("u", _USER), _USER: ("a", _ASSISTANT), _ASSISTANT: ("u", _USER)}
_ROLE = {"u": "user", "a": "assistant"}
# Faults of a row; rows with one of the first two must go.
FAULTS = _BLANK, _DUPLICATE, _CUT, _FINE = tuple("bdtf")
# Role letters by number; all others share the last one.
LETTERS = "sua?"
#: Rows and runs whose costs are worked out at once.
BLOCK = 4096
Vector = tuple[int, int, int, int]
#: What it costs to end the conversation after each state.
END: Vector = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 40


def symbol(letter: str, fault: str) -> int:
    """The number of a row's role letter (s, u, a, or another) and fault."""
    return LETTERS.index(letter if letter in ("s", "u", "a") else "?") * 4 + FAULTS.index(fault)


def _parts(number: int) -> tuple[str, str]:
    return LETTERS[number >> 2], FAULTS[number & 3]


def _choices(number: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) for a row of a symbol in a state, in the order of the edits' initials; inserting leaves the row undone."""
    letter, fault = _parts(number)
    follower, after = _NEXT[state]
    extra = TRUNCATED if fault == _CUT else 0
    out = [("D", DELETE, state), ("I", INSERT, after)]
    if fault in (_CUT, _FINE):
        if letter == follower:
            out.append(("K", extra, after))
        elif letter == "s" and state == _NONE:
            out.append(("K", extra, _SYSTEM))
        out.append(("R", REROLE + extra, after))
    return out


@lru_cache(maxsize=None)
def _matrix(number: int) -> tuple[Vector, ...]:
    """The least cost from each state before a row to each state after it, with rows inserted before the row."""
    out = []
    for start in range(4):
        row, state, paid = [_FAR] * 4, start, 0
        for _ in range(4):
            for edit, cost, after in _choices(number, state):
                if edit != "I":
                    row[after] = min(row[after], paid + cost)
            state, paid = _NEXT[state][1], paid + INSERT
        out.append(tuple(row))
    return tuple(out)


@lru_cache(maxsize=None)
def _binary_power(number: int, k: int) -> tuple[Vector, ...]:
    """The min-plus power 2^k of a symbol's matrix."""
    if k == 0:
        return _matrix(number)
    half = _binary_power(number, k - 1)
    return tuple(tuple(min(a[j] + half[j][i] for j in range(4)) for i in range(4)) for a in half)


@lru_cache(maxsize=1 << 16)
def _before(number: int, n: int, after: Vector) -> Vector:
    """The costs before a run of ``n`` rows from those after it."""
    k = 0
    while n:
        if n & 1:
            power = _binary_power(number, k)
            after = tuple(min(x + y for x, y in zip(row, after)) for row in power)
        n, k = n >> 1, k + 1
    return after


def _advance(number: int, n: int, after: Vector) -> Vector:
    # Costs relative to the least one are few different vectors, which the cache holds.
    least = min(after)
    return tuple(least + x for x in _before(number, n, tuple(x - least for x in after)))


@lru_cache(maxsize=1 << 16)
def _step(number: int, state: int, after: Vector) -> tuple[str, int]:
    """The first of the cheapest edits at a row, rows inserted before it included, and the state after it."""
    before = _before(number, 1, after)
    done = ""
    while not done or done[-1] == "I":
        left = before[state]
        edit, state = next(
            (e, to) for e, cost, to in _choices(number, state) if left == cost + (before if e == "I" else after)[to]
        )
        done += edit
    return done, state


def repair(numbers: Sequence[int], sizes: Sequence[int]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of runs of symbols, the least audit in ASCII order among equal costs.

    Costs are kept at every BLOCK-th run, and inside a run at every BLOCK-th row, and are
    worked out again in between, so little more than the runs and the audit is held.
    """
    marks: dict[int, Vector] = {}
    costs = END
    for k in range(len(numbers) - 1, -1, -1):
        if (k + 1) % BLOCK == 0 or k == len(numbers) - 1:
            marks[k + 1] = costs
        costs = _advance(numbers[k], sizes[k], costs)
    total, state, audit = costs[_NONE], _NONE, []
    for start in range(0, len(numbers), BLOCK):
        stop = min(start + BLOCK, len(numbers))
        # The costs after each of these runs.
        after = [marks[stop]]
        for k in range(stop - 1, start, -1):
            after.append(_advance(numbers[k], sizes[k], after[-1]))
        edits: list[str] = []
        for k in range(start, stop):
            state = _unrolled(numbers[k], sizes[k], state, after.pop(), edits)
        audit.append("".join(edits))
    return total, "".join(audit) + "I" * (END[state] // INSERT)


def _unrolled(number: int, n: int, state: int, after: Vector, audit: list[str]) -> int:
    """Appends the edits of a run of ``n`` rows; the state after it."""
    left = n
    while left:
        size = min(BLOCK, left)
        # The costs after each of these rows.
        inner = [_advance(number, left - size, after)]
        for _ in range(size - 1):
            inner.append(_advance(number, 1, inner[-1]))
        for costs in reversed(inner):
            least = min(costs)
            edits, state = _step(number, state, tuple(x - least for x in costs))
            audit.append(edits)
        left -= size
    return state


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows of ``conversations`` after a damage that their ids decide.

    Nulls in role and text, and in the ids' hash, are one space. By crc32 of ``conv_id:turn`` modulo 20
    rows are dropped (0), emptied (1), lose their ``.!?`` (2), come twice (3) or are the user's (4).
    """
    blank = F.lit(" ")
    place = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    fate = F.crc32(place) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    return rows.filter(fate != 0).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fate == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _cut(text: Column) -> Column:
    """Whether the last character that is not white space doesn't end a sentence."""
    return ~F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")).rlike(r"[.!?]\z")


_ORDER = ("turn", "role", "digest")
_RUNS = "conv_id long, part int, at long, symbols binary, sizes binary"
_FIELDS = [pa.field(n, k) for n, k in zip(("conv_id", "part", "at", "symbols", "sizes"), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))]


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, letter, fault): one row for equal rows of a turn, with the fault of the first of them.

    ``rows`` are (conv_id, turn, role, text, copies). A row is a duplicate if its conversation has the
    role and text at an earlier turn; the further ones of equal rows are too. Texts are compared by SHA-256.
    """
    text = F.col("text")
    told = rows.select(
        F.struct("conv_id").alias("conv"), "turn", "role", F.sha2("text", 256).alias("digest"), "copies",
        F.when(_blank(text), _BLANK).when(_cut(text), _CUT).otherwise(_FINE).alias("fault"),
    )
    equal = told.groupBy("conv", *_ORDER, "fault").agg(F.sum("copies").alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    several = equal.groupBy("conv", "role", "digest").agg(F.min(turn).alias("earliest"), F.count("*").alias("turns"))
    several = several.filter("turns > 1").drop("turns")
    known = equal.join(several, ["conv", "role", "digest"], "left")
    again = F.col("earliest").isNotNull() & (F.col("earliest") != turn)
    return known.select(
        "conv.conv_id", *_ORDER, "n", F.substring("role", 1, 1).alias("letter"),
        F.when((F.col("fault") != _BLANK) & again, _DUPLICATE).otherwise(F.col("fault")).alias("fault"),
    )


def runs(told: DataFrame) -> DataFrame:
    """(conv_id, pieces): every conversation's symbols in the order of its turns, as runs in pieces (part, at, symbols, sizes).

    Rows are dealt by ranges of (conversation, turn), so a conversation with a third of all rows
    goes through many tasks; only its runs, a few bytes each, are put together.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "digest"]
    dealt = told.repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        now, numbers, sizes = object(), array("B"), array("q")

        def whole() -> pa.RecordBatch:
            row = (now, part, at, numbers.tobytes(), sizes.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _FIELDS)], [f.name for f in _FIELDS])

        for batch in batches:
            for conv, n, letter, fault in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if conv != now:
                    if numbers:
                        yield whole()
                    now, numbers, sizes, at = conv, array("B"), array("q"), at + 1
                first = symbol(letter, fault)
                again = symbol(letter, fault if fault == _BLANK else _DUPLICATE)
                for number, size in ((first, 1), (again, n - 1)):
                    if size and numbers and numbers[-1] == number:
                        sizes[-1] += size
                    elif size:
                        numbers.append(number)
                        sizes.append(size)
        if numbers:
            yield whole()

    pieces = dealt.select("conv_id", "n", "letter", "fault").mapInArrow(run, _RUNS)
    return pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "at", "symbols", "sizes"))).alias("pieces"))


_REPAIRED = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repaired(told: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) for every conversation of ``runs``."""

    kinds = [*[pa.int64()] * 6, pa.string()]
    names = [x.split()[0] for x in _REPAIRED.split(", ")]
    # Whether the letters of two rows may follow each other, by 4 times the one's number plus the other's.
    legal = np.array([a + b in ("su", "ua", "au") for a in LETTERS for b in LETTERS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for conv, pieces in zip(batch.column(0).to_pylist(), batch.column(1)):
                pieces = pieces.as_py()
                numbers = b"".join(p["symbols"] for p in pieces)
                sizes = array("q", b"".join(p["sizes"] for p in pieces))
                kind, n = np.frombuffer(numbers, dtype=np.uint8), np.frombuffer(sizes, dtype=np.int64)
                blank, duplicate, truncated = (int(n[kind & 3 == k].sum()) for k in range(3))
                letter = kind >> 2
                # Two rows of one role never stand well next to each other.
                illegal = int((n - 1).sum() + (~legal[letter[:-1] * 4 + letter[1:]]).sum())
                out.append((conv, blank, duplicate, truncated, illegal, *repair(numbers, sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return told.mapInArrow(run, _REPAIRED)


def messages(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, at, role, text) of the repaired conversations, from the rows that were judged and ``repaired``.

    A conversation's audit comes first and its rows follow in their order, so a task holds one
    audit and one row at a time.
    """
    return _replayed(rows, found).mapInArrow(_replay(digest=False), "conv_id long, at long, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the SHA-256 of each repaired conversation, ``role:text`` joined by line feeds."""
    return _replayed(rows, found).mapInArrow(_replay(digest=True), "conv_id long, repaired_sha256 string")


def _replayed(rows: DataFrame, found: DataFrame) -> DataFrame:
    told = rows.select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", F.sha2("text", 256).alias("digest"), "text", "copies",
    )
    heads = found.select(
        "conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"),
        F.lit("").alias("digest"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("copies"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "digest"]
    sorted_rows = told.unionByName(heads).repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "kind", *order)
    return sorted_rows.select("conv_id", "kind", "role", "text", "copies")


def _replay(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Told | None = None
        out: list[tuple] = []
        for batch in batches:
            for conv, kind, role, text, copies in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if kind:
                    for _ in range(copies):
                        out += now.row(role, text)
                    continue
                if now is not None:
                    out += now.over()
                now = _Told(conv, text, digest)
            if out:
                yield _table(out, digest)
                out = []
        if now is not None:
            out += now.over()
        yield _table(out, digest)

    return run


def _table(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    names = ["conv_id", "repaired_sha256"] if digest else ["conv_id", "at", "role", "text"]
    kinds = [pa.int64(), pa.string()] if digest else [pa.int64(), pa.int64(), pa.string(), pa.string()]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


class _Told:
    """One conversation told again with its edits."""

    def __init__(self, conv: int | None, audit: str, digest: bool):
        self.conv, self.audit = conv, audit
        self.place, self.state, self.many = 0, _NONE, 0
        self.hash = hashlib.sha256() if digest else None

    def _said(self, role: str, text: str) -> list[tuple]:
        at, self.many = self.many, self.many + 1
        if self.hash is None:
            return [(self.conv, at, role, text)]
        self.hash.update(("\n" * (at > 0) + f"{role}:{text}").encode())
        return []

    def _inserted(self) -> list[tuple]:
        out = []
        while self.audit[self.place:self.place + 1] == "I":
            letter, self.state = _NEXT[self.state]
            out += self._said(_ROLE[letter], "")
            self.place += 1
        return out

    def row(self, role: str, text: str) -> list[tuple]:
        out = self._inserted()
        edit = self.audit[self.place]
        self.place += 1
        if edit == "D":
            return out
        if edit == "K" and role[:1] == "s":
            self.state = _SYSTEM
            return out + self._said(role, text)
        letter, self.state = _NEXT[self.state]
        return out + self._said(role if edit == "K" else _ROLE[letter], text)

    def over(self) -> list[tuple]:
        out = self._inserted()
        return out if self.hash is None else [(self.conv, self.hash.hexdigest())]


def judged(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of damaged conversations.

    ``rows`` are (conv_id, turn, role, text, copies). Order is by turn, nulls first; rows of one
    turn go by role and the SHA-256 of their text. Rows without a conv_id are one conversation. A
    role counts by its first letter; a row whose letter is none of s, u and a is never kept as
    it is. ``gaps`` are the turns missing between the least and the greatest one, null turns
    aside (null if there are over 2^63). A conversation's audit is one string and its
    digest is taken in one task, which holds an audit and a row at a time.
    """
    found = stage(repaired(runs(symbols(rows))), "audits")
    wide = F.col("high").cast("decimal(38,0)") - F.col("low").cast("decimal(38,0)") + 1 - F.col("turns")
    # Turns are counted once each before they meet.
    turns = rows.select("conv_id", "turn").distinct().groupBy("conv_id").agg(
        F.max("turn").alias("high"), F.min("turn").alias("low"), F.count("turn").alias("turns")
    ).select(
        F.col("conv_id").alias("__conv"), F.when(F.col("turns") == 0, F.lit(0)).otherwise(wide.try_cast("long")).cast("long").alias("gaps")
    )
    hashed = digests(rows, found).withColumnRenamed("conv_id", "__told")
    same = lambda a: F.col("conv_id").eqNullSafe(F.col(a))
    return found.join(turns, same("__conv")).join(hashed, same("__told")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"
    )


def restored(conversations: DataFrame) -> DataFrame:
    """``judged`` for every conv_id of ``conversations`` (conv_id, turn, role, text) after ``damaged``.

    A conversation that loses all its rows has zeros, an empty audit and the digest of the empty string. No
    rows give no rows; other columns are not read.
    """
    rows = damaged(conversations)
    found = judged(rows).withColumnRenamed("conv_id", "__conv")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    none = F.col("audit").isNull()
    return out.select(
        "conv_id", *[F.when(none, F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in zeros],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )

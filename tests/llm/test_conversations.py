import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyline.llm import conversations as C

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
COLUMNS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit) of rows (letter, fault) by a search over all edits, the least audit first among equal costs."""
    def follow(sofar, letter):
        new = sofar + letter
        return new if re.fullmatch(r"s?(ua)*u?", new) else None

    def short(sofar):
        return "s" if sofar == "s" else sofar[-1:]

    queue, seen = [(0, "", 0, "")], set()
    while queue:
        cost, audit, k, sofar = heapq.heappop(queue)
        if (k, sofar) in seen:
            continue
        seen.add((k, sofar))
        if k == len(rows) and sofar in ("", "a"):
            return cost, audit
        def go(more, edit, at, new):
            heapq.heappush(queue, (cost + more, audit + edit, at, short(new)))
        whole = {"": "", "s": "s", "u": "u", "a": "ua"}[sofar]
        for letter in "ua":
            if follow(whole, letter):
                go(2, "I", k, follow(whole, letter))
        if k < len(rows):
            letter, fault = rows[k]
            go(3, "D", k + 1, whole)
            if fault not in "bd":
                extra = fault == "t"
                if letter in "sua" and letter and follow(whole, letter):
                    go(extra, "K", k + 1, follow(whole, letter))
                for other in "ua":
                    if follow(whole, other):
                        go(2 + extra, "R", k + 1, follow(whole, other))


def plain(rows):
    """The rows of ``restored`` straight from its definition."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv]
        role, text = " " if role is None else role, " " if text is None else text
        show = [" " if x is None else str(x) for x in (conv, turn)]
        fate = zlib.crc32(":".join(show).encode()) % 20
        if fate == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        role = "user" if fate == 4 else role
        held[conv] += [(turn, role, text)] * (1 + (fate == 3))
    out = []
    for conv, said in held.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, told = set(), []
        for turn, role, text in said:
            bare = text.strip(SPACE)
            fault = "b" if not bare else "d" if (role, text) in seen else "f" if bare[-1] in ".!?" else "t"
            seen.add((role, text))
            told.append((role[:1], fault))
        turns = [t for t, _, _ in said if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        letters = [a for a, _ in told]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(letters, letters[1:]))
        cost, audit = cheapest(told)
        text, last, at = [], "", iter(said)
        for edit in audit:
            following = "assistant" if last == "u" else "user"
            if edit == "I":
                text.append(f"{following}:")
                last = following[0]
                continue
            _, role, words = next(at)
            if edit == "K":
                text.append(f"{role}:{words}")
                last = role[0]
            elif edit == "R":
                text.append(f"{following}:{words}")
                last = following[0]
        count = lambda f: sum(x == f for _, x in told)
        out.append((conv, gaps, count("b"), count("d"), count("t"), illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, parts=3):
    frame = spark.createDataFrame(rows, COLUMNS).repartition(parts).withColumn("audit", F.lit("mine")).withColumn("copies", F.lit(9)).withColumn("n", F.lit("x"))
    return sorted((tuple(r) for r in C.restored(frame).collect()), key=str)


def drawn(seed, convs=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Well?", "cut off", "  ", "", None, "Bonjour à tous.", "trailing blank. \n", "two\nlines!", "...", "\x1c"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "unknown", "Assistant"]
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(1, 9)):
            at = rng.choice([turn, turn, turn, turn + 3, None, 0, -2])
            rows.append((conv, at, rng.choice(roles), rng.choice(texts)))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_follows_the_definition(spark, make, seed):
    rows = drawn(seed)
    assert found(spark, rows) == plain(rows)


def test_every_short_string_is_repaired_at_the_least_cost():
    kinds = [("s", "f"), ("u", "f"), ("a", "f"), ("u", "t"), ("a", "t"), ("?", "f"), ("u", "b"), ("s", "t")]
    for n in range(5):
        for rows in itertools.product(kinds, repeat=n):
            runs = [(k, len(list(g))) for k, g in itertools.groupby(C.symbol(*r) for r in rows)]
            assert C.repair([k for k, _ in runs], [n for _, n in runs]) == cheapest(rows), rows


def test_long_runs_in_blocks(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(C, "BLOCK", 7)
    for _ in range(40):
        rows = []
        while len(rows) < 60:
            rows += [(rng.choice("suaa?"), rng.choice("bdtfff"))] * rng.choice([1, 1, 2, 17, 30])
        runs = [(k, len(list(g))) for k, g in itertools.groupby(C.symbol(*r) for r in rows)]
        assert C.repair([k for k, _ in runs], [n for _, n in runs]) == cheapest(rows)


def test_a_run_of_a_million_rows():
    cost, audit = C.repair([C.symbol("u", "f")], [1_000_001])
    # Every second row becomes the assistant's, and the last one gets an answer.
    assert cost == 1_000_002
    assert audit.count("K") + audit.count("R") + audit.count("D") == 1_000_001
    assert C.repair([C.symbol("u", "d")], [1 << 20]) == (3 << 20, "D" * (1 << 20))


def test_one_conversation_over_many_tasks(spark, make):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant"]), f"text {t % 50}.") for t in range(900)] + [(8, 0, "user", "Hello.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(spark, rows, 6) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_all_rows_dropped_and_no_rows(spark, make):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    none = (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found(spark, [(lost, 0, "user", "Hi.")]) == [none] == plain([(lost, 0, "user", "Hi.")])
    assert found(spark, []) == []


def test_turns_far_apart(spark, make):
    rows = [(1, -(1 << 63), "user", "Hi."), (1, (1 << 63) - 1, "assistant", "Hi there.")]
    (got,) = found(spark, rows)
    assert got[1] is None and got[7]


def test_messages_are_those_of_the_digest(spark, make):
    rows = drawn(4, 20)
    frame = C.damaged(spark.createDataFrame(rows, COLUMNS))
    verdicts = C.stage(C.repaired(C.runs(C.symbols(frame))), "audits")
    told = defaultdict(list)
    for r in sorted(C.messages(frame, verdicts).collect(), key=lambda r: (str(r["conv_id"]), r["at"])):
        told[r["conv_id"]].append((r["role"], r["text"]))
    want = {r[0]: r for r in plain(rows)}
    for conv, said in told.items():
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in said).encode()).hexdigest() == want[conv][8]
        assert re.fullmatch("(s?(ua)+)?", "".join(a[:1] for a, _ in said))

import random
import re
from collections import Counter

import pytest
from pyspark import SparkContext
from pyspark.broadcast import Broadcast
from pyspark.sql import functions as F

from tallyline.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, items, size=10):
    def words(t):
        return WORD.findall((t or "").translate(LOWER))

    owners = {}
    for item, text in items:
        w = words(text)
        if item is not None and w:
            for k in range(max(1, len(w) - size + 1)):
                owners.setdefault(tuple(w[k:k + size]), set()).add(item)
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in owners}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in owners:
                    hit |= set(range(k, k + n))
                    found |= owners[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def bench(spark):
    def build(items):
        rows = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
        return rows
    return build


def drawn(seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gam-ma", "é", "x9", "don't", "É"]
    items = [(f"q{k}", " ".join(rng.choices(words, k=rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(14)]
    items += [("q3", "another text of the same item"), (None, "alpha beta"), ("empty", None), ("same", items[5][1]), ("ab", "beta,beta")]
    rows = []
    for i in range(60):
        parts = rng.choices(words, k=rng.randint(0, 30))
        if rng.random() < 0.5:
            parts += [rng.choice(items)[1] or ""] + rng.choices(words, k=3)
        rows.append((i, rng.choice([" ", " - ", "\n"]).join(parts).upper() if rng.random() < 0.5 else ", ".join(parts)))
    return rows + [(70, None), (71, ""), (72, "?!"), (3, "beta beta"), (3, "beta beta"), (None, "beta beta"), (73, "beta " * 4000)], items


@pytest.mark.parametrize(("seed", "block"), [(1, 1_000_000), (2, 1_000_000), (3, 20)])
def test_hits(make, bench, seed, block):
    rows, items = drawn(seed)
    docs = make(rows).withColumn("items", F.lit("mine")).withColumn("item_id", F.lit("q1")).withColumn("n_hit", F.lit(0))
    found = decontaminate.contamination(docs, bench(items), block=block)
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in found.collect()), key=str)
    assert got == plain(rows, items)
    clean = decontaminate.clean_rows(docs, bench(items))
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((i for i, _, n, _ in plain(rows, items) if not n), key=str)


def test_spans_lie_in_the_original_text():
    own = decontaminate.automaton([("a", "One two-three FOUR"), ("b", "é ü")])
    text = "ünï — ONE (two) Three, four! and É ü é-ü."
    # The dash is no ASCII character and so a word.
    n, hit, items, spans = decontaminate.scan(text, [own])
    assert (n, hit, items) == (11, 6, ["a", "b"])
    assert [text[s:e] for _, _, s, e in spans] == ["ONE (two) Three, four", "é-ü"]
    assert [(a, b) for a, b, _, _ in spans] == [(2, 5), (9, 10)]


def test_whole_words_only():
    own = decontaminate.automaton([("a", "cat sat")])
    assert decontaminate.scan("concat sat, cat sate, cat", [own])[1] == 0
    assert decontaminate.scan("cat sat", [own])[1] == 2


def test_empty_tables(make, bench):
    rows, items = drawn(1)
    assert decontaminate.contamination(make([], 1), bench(items)).count() == 0
    got = decontaminate.contamination(make(rows), bench([])).collect()
    assert len(got) == len(rows) and not any(r["n_hit"] or r["items"] for r in got)
    assert decontaminate.clean_rows(make(rows), bench([])).count() == len(rows)


def test_one_block_in_memory_at_a_time(make, bench, monkeypatch):
    rows, items = drawn(3)
    held, most = set(), []
    send, destroy = SparkContext.broadcast, Broadcast.destroy

    def sending(self, value):
        out = send(self, value)
        held.add(id(out))
        most.append(len(held))
        return out

    def destroying(self, *args):
        held.discard(id(self))
        destroy(self, *args)

    monkeypatch.setattr(SparkContext, "broadcast", sending)
    monkeypatch.setattr(Broadcast, "destroy", destroying)
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 100)
    want = plain(rows, items)
    found = decontaminate.contamination(make(rows), bench(items), block=100).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], sorted(r["items"])) for r in found), key=str) == want
    whole = decontaminate.automaton([x for x in items if None not in x])
    texts = Counter((i, str(decontaminate.scan(t, [whole])[3])) for i, t in rows)
    assert Counter((r["doc_id"], str([tuple(s) for s in r["spans"]])) for r in found) == texts
    clean = decontaminate.clean_rows(make(rows), bench(items))
    assert sorted((r["doc_id"] for r in clean.collect()), key=str) == sorted((i for i, _, n, _ in want if not n), key=str)
    assert len(most) > 4 and max(most) == 1

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import quality


def plain(words, least):
    n = len(words)

    def starts(size):
        seen = Counter(tuple(words[k:k + size]) for k in range(n - size + 1))
        return [k for k in range(n - size + 1) if seen[tuple(words[k:k + size])] > 1]

    def covered(size):
        return len({k + j for k in starts(size) for j in range(size)})

    return covered(3), covered(least), max((s for s in range(1, n) if starts(s)), default=0)


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_drawn_texts(seed):
    rng = random.Random(seed)
    docs = [rng.choices([b"a", b"b", b"c"][:rng.randint(1, 3)], k=rng.choice([0, 1, 2, 3, 10, 40])) for _ in range(40)]
    docs += [[b"x"] * 25, [b"a", b"b"] * 12, []]
    for least in (1, 4):
        got = quality.repetition(docs, least)
        assert [tuple(int(x[k]) for x in got) for k in range(len(docs))] == [plain(d, least) for d in docs]


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_is_sorted(seed):
    rng = np.random.default_rng(seed)
    doc = np.sort(rng.integers(0, 4, 80))
    words = rng.integers(0, 3, 80)
    order, lcp = quality.suffix_array(words, doc)

    def suffix(k):
        end = int(np.searchsorted(doc, doc[k], side="right"))
        return (int(doc[k]), *words[k:end].tolist())

    found = [suffix(k) for k in order]
    assert found == sorted(found)
    for a, b, n in zip(found, found[1:], lcp[1:]):
        same = 0
        if a[0] == b[0]:
            while same + 1 < min(len(a), len(b)) and a[same + 1] == b[same + 1]:
                same += 1
        assert same == n


def test_no_words_to_sort():
    assert [x.tolist() for x in quality.repetition([[], []])] == [[0, 0]] * 3


def test_counts_of_texts(monkeypatch):
    texts = [None, "", " \n\t", "a b c a b c", "é# x\n\n \né# x\né# x \n", "#*$%&|<>", "one\x0btwo\x0cthree", "w " * 900]
    want_chars = [0, 0, 0, 6, 9, 8, 11, 900]
    for chunk in (1, 100_000):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        m = quality.measure(texts)
        assert m["n_words"].tolist() == [0, 0, 0, 6, 6, 1, 3, 900]
        assert m["word_chars"].tolist() == want_chars
        assert m["n_symbols"].tolist() == [0, 0, 0, 0, 3, 8, 0, 0]
        assert m["n_dup_lines"].tolist() == [0, 0, 0, 0, 1, 0, 0, 0]
        assert m["n_repeat_words"].tolist() == [0, 0, 0, 6, 6, 0, 0, 900]


def texts():
    rng = random.Random(1)
    clean = " ".join(f"w{rng.randrange(10_000)}" for _ in range(600))
    line = "this line is here twice and is ten words long ."
    block = " ".join(f"v{k}" for k in range(120))
    return clean, f"{clean}\n{line}\n{clean[::-1]}\n{line}", f"{clean} {block} {clean[::-1]} {block}"


def test_verdicts(make):
    clean, line, block = texts()
    rows = [
        (1, clean), (2, line), (3, block), (4, "too short"), (5, None), (6, ""), (7, "again and again " * 60), (1, clean), (None, clean),
    ]
    docs = make(rows).withColumn("kept", F.lit("mine")).withColumn("n_words", F.lit(0))
    got = sorted(((r["doc_id"], r["base_failed"], r["kept"]) for r in quality.judged(docs).collect()), key=str)
    want = [(1, False, True), (1, False, True), (2, False, True), (3, False, False), (4, True, False), (5, True, False), (6, True, False), (7, True, False), (None, False, True)]
    assert got == sorted(want, key=str)
    kept = quality.kept_rows(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, _, k in want if k), key=str)


def test_each_limit_decides_alone(make):
    fresh = iter(range(100_000))

    def words(n):
        return " ".join(f"u{next(fresh)}" for _ in range(n))

    passages = [words(12) for _ in range(20)]
    covered = " ".join(f"{p} {words(15)} {p} {words(15)}" for p in passages)
    quote, line = words(80), words(13)
    long = f"{quote} {words(900)} {quote}"
    clean = [words(300), f"{line}\n{words(90)}\n{line}", f"{(p := words(40))} {words(300)} {p}"]
    rows = list(enumerate([covered, long, *clean]))
    m = quality.measure([t for _, t in rows])
    share = m["n_covered_words"] / m["n_words"]
    assert 0.4 < share[0] < 0.5 and m["longest_repeat"][0] == 12
    assert share[1] < 0.2 and m["longest_repeat"][1] == 80
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.judged(make(rows)).collect()}
    assert got == {0: (False, False), 1: (False, False), 2: (False, True), 3: (False, True), 4: (False, True)}
    assert {r["doc_id"] for r in quality.kept_rows(make(rows)).collect()} == {2, 3, 4}


def test_no_documents(make):
    assert quality.judged(make([], 1)).count() == 0
    assert quality.kept_rows(make([], 1)).count() == 0


@pytest.mark.parametrize("step", [1, 3, 1 << 18])
def test_common_prefixes_of_repetitive_texts(monkeypatch, step):
    monkeypatch.setattr(quality, "STEP", step)
    rng = random.Random(step)
    for _ in range(150):
        texts = [[rng.randrange(rng.choice((1, 2, 4))) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 4))]
        order, lcp, start = [], [], 0
        for words in texts:
            suffixes = sorted(range(len(words)), key=lambda k: words[k:])
            for before, k in zip([None, *suffixes], suffixes):
                order.append(start + k)
                lcp.append(0 if before is None else next((d for d, (a, b) in enumerate(zip(words[before:], words[k:])) if a != b), min(len(words) - before, len(words) - k)))
            start += len(words)
        found = quality.suffix_array(np.array(sum(texts, [])), np.repeat(np.arange(len(texts)), [len(x) for x in texts]))
        assert [x.tolist() for x in found] == [order, lcp]


def test_memory_of_a_long_repetitive_text():
    import tracemalloc

    tracemalloc.start()
    found = quality.measure(["word " * 400_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["longest_repeat"].tolist() == [399_999] and found["n_covered_words"].tolist() == [400_000]
    assert peak < 100 << 20

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyline.llm import substring_dedup


def plain(rows, window=50):
    """{doc_id: (n_words, n_removed, kept_sha256)} by comparing all windows."""
    split = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(k for k in split if k is not None):
        for k in range(len(split[i]) - window + 1):
            first.setdefault(tuple(split[i][k:k + window]), i)
    out = {}
    for i, words in split.items():
        gone = [False] * len(words)
        for k in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[i] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def drawn_rows(seed):
    rng = random.Random(seed)

    def words(n):
        return [f"w{rng.randrange(300)}" for _ in range(n)]

    passages = [words(rng.choice([49, 50, 51, 60, 95, 200])) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += words(rng.randint(0, 70))
            if rng.random() < 0.6:
                p = list(rng.choice(passages))
                if rng.random() < 0.3:
                    p[rng.randrange(len(p))] = "changed"
                parts += p
        rows.append((i * 7 % 61, rng.choice([" ", "\n", "  "]).join(parts)))
    copy = " ".join(words(130))
    rows += [(200 + k, copy) for k in range(9)] + [(300, copy + " more"), (301, "short copy"), (302, "short copy")]
    # A text that repeats itself, and shares that with others.
    loop = " ".join(words(25) * 6)
    return rows + [(310, loop), (311, loop + " end"), (312, "start " + loop), (320, None), (321, ""), (322, " \n")]


def test_cover_has_every_difference():
    cover, period = substring_dedup.COVER, substring_dedup.PERIOD
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


def test_rolled_hashes_tell_runs_apart():
    h = substring_dedup.word_hashes(" ".join(random.Random(1).choices(["a", "b"], k=400)))
    words = h.tolist()
    for size in (1, 2, 3, 20, 50):
        got = substring_dedup.rolled(h, size, 0x9E3779B97F4A7C15).tolist()
        runs = [tuple(words[k:k + size]) for k in range(len(words) - size + 1)]
        assert len(got) == len(runs) and len(set(zip(got, runs))) == len(set(got)) == len(set(runs))
    assert len(substring_dedup.rolled(h, 401, 3)) == 0


@pytest.mark.parametrize("seed", range(3))
def test_removed_words(make, seed):
    rows = drawn_rows(seed)
    docs = make(rows).withColumn("h", F.lit(0)).withColumn("pos", F.lit(0)).withColumn("starts", F.lit("x")).withColumn("sha256", F.lit("y"))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicated(docs).collect()}
    want = plain(rows)
    assert got == want
    assert sum(x[1] for x in want.values()) > 1000
    left = substring_dedup.without_repeats(docs, length_col="n_chars")
    assert left.columns == docs.columns
    texts = {r["doc_id"]: r for r in left.collect()}
    assert set(texts) == {i for i, x in want.items() if x[0] == 0 or x[1] < x[0]}
    given = dict(rows)
    for i, r in texts.items():
        assert hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest() == want[i][2]
        if want[i][1] == 0:
            assert r["text"] == given[i]
        if r["text"] is not None:
            assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("parts", [1, 16])
def test_any_spread_over_tasks(make, parts):
    rows = drawn_rows(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicated(make(rows, parts)).collect()}
    assert got == plain(rows)


def test_other_window(make):
    rows = drawn_rows(7)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.deduplicated(make(rows), window=35).collect()}
    assert got == plain(rows, 35)


def test_repeated_rows_and_missing_ids(make):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(5, text), (5, text), (9, "x " + text), (None, text), (None, "y " + text)]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.deduplicated(make(rows)).collect()), key=str)
    assert got == sorted([(5, 80, 0), (5, 80, 0), (9, 81, 80), (None, 80, 0), (None, 81, 0)], key=str)
    assert substring_dedup.without_repeats(make(rows)).count() == 5


def test_cut_keeps_the_rest_as_it_is():
    text = "  a b\n c\t d e  f "
    assert substring_dedup.cut(text, [], 2) == text
    assert substring_dedup.cut(text, [1], 2) == "a d e  f"
    assert substring_dedup.cut(text, [0], 2) == "c\t d e  f"
    assert substring_dedup.cut(text, [0, 2, 4], 2) == ""
    assert substring_dedup.cut("é ö ü", [0], 2) == "ü"


def test_no_documents(make):
    assert substring_dedup.deduplicated(make([], 1)).count() == 0
    assert substring_dedup.without_repeats(make([], 1)).count() == 0

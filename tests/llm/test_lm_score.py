import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import lm_score


def plain(rows, word_share, ngram_share, order):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base, score)} straight from the definition."""
    split = [(i, lm_score.tokens(t)) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in split]
    training = [t for (_, t), h in zip(split, held) if not h]
    one = Counter(w for t in training for w in t)
    total = sum(one.values())
    grams = [None, {(w,): c for w, c in one.items() if c >= max(word_share, ngram_share) * total}]
    for n in range(2, order + 1):
        seen = Counter(g for t in training for g in zip(*(t[k:] for k in range(n))))
        grams.append({g: c for g, c in seen.items() if c >= ngram_share * total and g[:-1] in grams[-1] and g[1:] in grams[-1]})
    follow = {}
    for n in range(2, order + 1):
        for g, c in grams[n].items():
            follow.setdefault(g[:-1], {})[g[-1]] = c

    def p(past, word):
        if not past:
            return lm_score.unigram(one[word], total, len(one))
        if past not in follow:
            return p(past[1:], word)
        seen = grams[len(past)][past]
        left = 1 - sum(c - lm_score.DISCOUNT for c in follow[past].values()) / seen
        arc = follow[past].get(word)
        return (arc - lm_score.DISCOUNT if arc else 0) / seen + left * p(past[1:], word)

    out = []
    for (i, t), h in zip(split, held):
        score = 0.0
        for k, w in enumerate(t):
            past = tuple(t[max(0, k - order + 1):k])
            while past and past not in grams[len(past)]:
                past = past[1:]
            score += math.log10(p(past, w))
        base = sum(math.log10(lm_score.unigram(one[w], total, len(one))) for w in t)
        out.append((i, h, len(t), sum(one[w] > 0 for w in t), total, base, score))
    return out


def drawn_rows(seed, many):
    rng = random.Random(seed)
    words = ["the", "of", "And", "it's", "é", "RARE", *(f"w{k}" for k in range(60))]
    weights = [30, 20, 10, 5, 5, 1] + [1] * 60
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(many)]


@pytest.mark.parametrize(("word_share", "ngram_share", "order"), [(1e-9, 1e-9, 3), (0.01, 0.004, 3), (0.05, 0.05, 2), (1e-9, 1.0, 3), (2.0, 2.0, 3), (1e-9, 1e-3, 1)])
def test_scores_follow_the_definition(make, word_share, ngram_share, order):
    rows = drawn_rows(1, 120) + [(500, None), (501, ""), (502, "  \n"), (7, "repeated row"), (7, "repeated row"), (None, "no id at all"), (503, "unseen " * 400 + "x" * 5000)]
    docs = make(rows).withColumn("score", F.lit("mine")).withColumn("row", F.lit(0)).withColumn("word", F.lit(0)).withColumn("held_out", F.lit(1))
    found = lm_score.scored(docs, order, word_share, ngram_share)
    got = sorted((tuple(r) for r in found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    want = sorted(plain(rows, word_share, ngram_share, order), key=str)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_counts_are_the_same_when_handed_on_early(make, monkeypatch):
    docs = make(drawn_rows(2, 60))
    want = sorted(tuple(r) for r in lm_score.word_counts(docs).collect())
    monkeypatch.setattr(lm_score, "GATHERED", 5)
    early = docs.withColumn("text", F.col("text"))
    assert sorted(tuple(r) for r in lm_score.word_counts(early).collect()) == want


def one_block(make, rows):
    """The automaton the query builds for the only block of ``rows``, the block, and its words' counts."""
    docs = make(rows, 1).withColumn("held_out", F.expr("crc32(cast(doc_id as string)) % 5 = 1"))
    held = lm_score.blocks(docs)
    row = lm_score._rows(held.toArrow())[0]
    b = lm_score.Block(row, 3)
    bigrams = lm_score.bigram_answers(lm_score.bigram_requests(held, 3, 2), 0.0)
    words = lm_score.word_answers(lm_score.word_requests(held, bigrams, 3, 0.0, 1)).filter("block >= 0")
    by_part = lambda x: sorted(lm_score._rows(x.toArrow()), key=lambda r: r["part"])
    total = int(b.counts.sum())
    distinct = len(np.unique(b.ids[b.counts > 0]))
    return (b, *lm_score.automaton(b, by_part(words), by_part(bigrams), total, distinct, 0.0))


def test_arcs_of_a_state_sum_to_one(make):
    """Of every state the texts reach: all words together, and one that nobody has seen, have probability one."""
    b, own, count = one_block(make, [r for r in drawn_rows(3, 40) if zlib.crc32(str(r[0]).encode()) % 5 != 1])
    states = np.unique(np.r_[0, own.first, own.to])
    assert len(states) > 200
    unseen = lm_score.ALPHA / (b.counts.sum() + lm_score.ALPHA * (len(count) + 1))
    for state in states.tolist():
        weight, _ = own.step(np.full(own.width, state), np.arange(own.width))
        left = unseen
        at = state
        while at:
            left *= 10 ** own.cost[at]
            at = int(own.fail[at])
        # All words of this block are trained and its arcs are all there are.
        assert (10 ** weight).sum() + left == pytest.approx(1)


def test_a_text_is_read_alike_in_any_stretches(make, monkeypatch):
    b, own, _ = one_block(make, [*drawn_rows(6, 50), (900, " ".join(t for _, t in drawn_rows(8, 200)))])
    got = []
    for stretch in (1, 2, 7, 1 << 30):
        monkeypatch.setattr(lm_score, "STRETCH", stretch)
        got.append(own.scores(b.ids, b.starts, b.size, 3))
    state, total = np.zeros(1, dtype=np.int64), 0.0
    start = int(b.starts[np.argmax(b.size)])
    for word in b.ids[start:start + b.size.max()]:
        weight, state = own.step(state, np.array([word]))
        total += weight[0]
    for scores in got:
        assert scores == pytest.approx(got[-1], rel=1e-9)
        assert scores[np.argmax(b.size)] == pytest.approx(total, rel=1e-9)


def test_packed_numbers_come_back():
    for x in ([], [0], [1, 255], [3, 70000, 2], [1 << 40, 0]):
        assert lm_score._unpacked(lm_score._packed(np.array(x, dtype=np.int64))).tolist() == x
    hashes = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 500, dtype=np.uint64))
    for k in (0, 1, 500):
        assert (lm_score._risen(lm_score._rising(hashes[:k])) == hashes[:k]).all()


def test_model_beats_single_tokens_on_held_out_documents(make):
    rng = random.Random(9)
    phrases = ["one two three four five", "six seven eight nine ten", "red green blue"]
    rows = [(i, " ".join(rng.choices(phrases, k=20))) for i in range(80)]
    got = [r for r in lm_score.scored(make(rows)).collect() if r["held_out"]]
    assert got and all(r["score"] > 0.6 * r["base_score"] for r in got)


def test_no_documents(make):
    assert lm_score.scored(make([], 1)).count() == 0


def test_rare_ngrams_stay_in_a_large_corpus(make):
    """N-grams seen once are arcs, though one is under 1e-5 of 190,000 training tokens."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(1000))) for i in range(240)]
    spare = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 != 1)
    held = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows += [(spare, "alpha beta gamma"), (held, "alpha beta gamma")]
    got = {r["doc_id"]: r for r in lm_score.scored(make(rows)).collect()}
    want = {r[0]: r for r in plain(rows, 0.0, 0.0, 3)}
    assert got[held]["score"] == pytest.approx(want[held][6], rel=1e-9)
    assert got[held]["score"] > 0.5 * got[held]["base_score"]
    assert max(abs(got[i]["score"] / want[i][6] - 1) for i in got) < 1e-9


def test_blocks_and_parts_do_not_change_scores(make, monkeypatch):
    docs = make(drawn_rows(5, 90))
    want = sorted(tuple(r) for r in lm_score.scored(docs).collect())
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 50)
    monkeypatch.setattr(lm_score, "PART_TOKENS", 100)
    got = sorted(tuple(r) for r in lm_score.scored(docs).collect())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5:] for r in got] == [pytest.approx(r[5:], rel=1e-9) for r in want]


def zipf_rows(seed, many):
    """Texts of common words and of some that come once."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(5000)]
    weights = [1 / (k + 1) for k in range(5000)]
    return [
        (i, " ".join(w if rng.random() > 0.1 else f"once{i}x{n}" for n, w in enumerate(rng.choices(words, weights, k=500))))
        for i in range(many)
    ]


def test_common_followers_are_sent_in_few_bytes(make):
    docs = make(zipf_rows(11, 200), 2).withColumn("held_out", F.lit(False))
    held = lm_score.blocks(docs)
    entries = sum(len(lm_score.Block(lm_score._rows(x)[0], 3).entry_n) for x in held.toArrow().to_batches(1) if x.num_rows)
    common = lm_score.frequent(held, held.count())
    assert len(common) == len(set(common.tolist())) and 3000 < len(common) <= lm_score.COMMON
    sent = lm_score.bigram_requests(held, 3, 4, common).toArrow()
    # Six bytes each by hash alone.
    assert sum(len(r["next"]) + len(r["rare"]) for r in sent.to_pylist()) < 3.5 * entries


def test_scores_are_the_same_whichever_words_are_common(make, monkeypatch):
    docs = make(zipf_rows(12, 60))
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 2000)
    monkeypatch.setattr(lm_score, "PART_TOKENS", 5000)
    want = sorted(plain(zipf_rows(12, 60), 0.0, 0.0, 3))
    for common, drawn in ((lm_score.COMMON, 32), (7, 3), (0, 32), (5, 0)):
        monkeypatch.setattr(lm_score, "COMMON", common)
        monkeypatch.setattr(lm_score, "DRAWN", drawn)
        got = sorted(tuple(r) for r in lm_score.scored(docs).collect())
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert [r[5:] for r in got] == [pytest.approx(r[5:], rel=1e-9) for r in want]


def test_shuffles_go_when_their_table_is_written(make, spark):
    """What a table was shuffled for is off the disk when the table is there; the session's own setting stays."""
    disk = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()

    def shuffled():
        files = disk()
        return {files.apply(k).getName(): files.apply(k).length() for k in range(files.size())}

    docs = make(zipf_rows(13, 200))
    docs.count()
    before, setting = shuffled(), spark.conf.get(lm_score.CLEANUP, None)
    lm_score.scored(docs)
    for _ in range(50):
        new = sum(n for name, n in shuffled().items() if name not in before)
        if new < 100_000:
            break
        time.sleep(0.1)
    assert new < 100_000
    assert spark.conf.get(lm_score.CLEANUP, None) == setting

"""Every stage and the whole pipeline against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyline.llm import quality
from tallyline.llm.shared import stage
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_packing import check_pieces, tokenizer  # noqa: F401
from tests.llm.test_quality import plain as plain_repeats
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_substring_dedup import plain as plain_removed


def drawn_documents():
    rng = random.Random(11)

    def words(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    passage, item = words(70), " ".join(words(14))
    rows = []
    for i in range(60):
        body = words(rng.randint(55, 300))
        if i % 7 == 0:
            body[20:20] = passage
        if i % 11 == 0:
            body[30:30] = item.split()
        rows.append((i, "\n".join(" ".join(body[k:k + 12]) for k in range(0, len(body), 12))))
    for k in range(8):
        copy = rows[k][1].split(" ")
        copy[len(copy) // 2] = "other"
        rows.append((100 + k, " ".join(copy)))
        rows.append((200 + k, rows[k][1]))
    rows += [(300, " ".join(passage)), (301, "short text"), (302, None), (303, ""), (304, "again and again " * 50)]
    rows += [(305, " ".join(words(120) * 2)), (3, rows[3][1]), (None, " ".join(words(90))), (400, " ".join(words(9000)))]
    return rows, [("a", item), ("b", "never in any text of these"), ("c", None)]


def passes(text):
    split = (text or "").encode().split()
    base, covered, longest = plain_repeats(split, quality.MIN_REPEAT) if len(split) < 400 else (0, 0, 0)
    failed = len(split) < 50 or 100 * base > 50 * len(split)
    return not failed and covered <= quality.MAX_COVERED * len(split) and longest <= quality.MAX_LONGEST


def after_copies(rows):
    """The rows that stay when every group of near-duplicates keeps its smallest id."""
    prints = {t: plain_fingerprint(t) for _, t in rows}
    groups = plain_components(set(prints.values()), 3)
    ids = {}
    for i, t in rows:
        ids.setdefault(min(groups[prints[t]]), set()).add(i)
    named = {k: min(v - {None}, default=None) for k, v in ids.items()}
    return [(i, t) for i, t in rows if i == named[min(groups[prints[t]])]]


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    rows, items = drawn_documents()
    at = str(tmp_path_factory.mktemp("corpus"))
    make(rows).withColumn("kept", F.lit("mine")).withColumn("starts", F.lit(1)).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages_hand_on_the_columns_of_documents(spark, folder, tokenizer):  # noqa: F811
    rows, items = drawn_documents()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, folder)
        assert docs.columns == columns
        docs = stage(docs, name)
        seen[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
    passed = [(i, t) for i, t in rows if passes(t)]
    assert Counter(seen["quality_rules"]) == Counter(passed)
    single = after_copies(passed)
    assert Counter(seen["near_duplicates"]) == Counter(single)
    removed = plain_removed(single)
    kept = [(i, t) for i, t in single if not removed[i][0] or removed[i][1] < removed[i][0]]
    assert sorted((i for i, _ in seen["repeated_passages"]), key=str) == sorted((i for i, _ in kept), key=str)
    texts = dict(seen["repeated_passages"])
    for i, t in kept:
        n, gone, _ = removed[i]
        assert len(texts[i].split()) == n - gone
        assert gone or texts[i] == t
    clean = [i for i, _, n, _ in plain_hits(seen["repeated_passages"], items) if not n]
    assert sorted((i for i, _ in seen["benchmark_passages"]), key=str) == sorted(clean, key=str)
    assert len(clean) < len(kept) < len(single) < len(passed) < len(rows)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check_pieces(tokenizer, seen["benchmark_passages"], final, 4096)
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, whole)) == Counter(map(key, final))


def test_stages_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, folder)
        assert docs.count() == 0

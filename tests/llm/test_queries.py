"""The registered queries over a whole small folder against brute force."""

import hashlib
import math
from collections import Counter

import pytest

import __spark_entry__ as contract
from tallyline.llm import queries, quality
from tests.compare import database, difference
from tests.llm.test_decontaminate import plain as plain_hits
from tests.llm.test_lm_score import plain as plain_scores
from tests.llm.test_packing import check_pieces, tokenizer  # noqa: F401
from tests.llm.test_token_align import plain as plain_alignment
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.llm.test_url_filter import plain as plain_rule

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark, make):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, name):
    return contract.queries()[name](spark, FOLDER)


def test_all_are_registered():
    names = contract.queries()
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{k}" for k in range(1, 14)]
    assert set(queries.queries()) | {"pipeline"} <= set(names)


@pytest.mark.parametrize("name", [
    "op6_substring_dedup", "op7_html_extraction", "op10_decontaminate", "op11_conversation_repair", "op12_line_dedup",
])
def test_matches_sql(spark, make, name):
    assert difference(spark, database(FOLDER), FOLDER, name) is None


def test_op1(spark, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in run(spark, "op1_simhash").collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    groups = plain_components(set(prints.values()), 3)
    first = {}
    for i, x in prints.items():
        key = min(groups[x])
        first[key] = min(first.get(key, i), i)
    assert got == {i: (f"{x:016x}", first[min(groups[x])]) for i, x in prints.items()}


def test_op4(spark, rows):
    found = run(spark, "op4_lm_scoring")
    assert dict(found.dtypes)["train_tokens"] == "bigint"
    got = sorted(tuple(r) for r in found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect())
    want = sorted(plain_scores(rows, queries.lm_score.WORD_SHARE, queries.lm_score.NGRAM_SHARE, queries.lm_score.ORDER))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
        assert math.isfinite(g[6])


def test_op5(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    got = run(spark, "op5_url_filter").collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got} == {i: plain_rule(u)[:3] for i, u in urls.items()}
    assert all(r["verdict"] == (plain_rule(urls[r["page_id"]])[3] or r["verdict"]) for r in got)
    assert {r["verdict"] for r in got} == {"allow", "block"}


def test_op8(spark, rows):
    got = {r["doc_id"]: r for r in run(spark, "op8_quality").collect()}
    assert set(got) == {i for i, _ in rows}
    for i, t in rows:
        words = t.encode().split()
        seen = Counter(zip(words, words[1:], words[2:]))
        again = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if seen[w] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(words), sum(len(w.decode()) for w in words), len(again))
        assert r["n_symbols"] == sum(t.count(c) for c in "#*$%&|<>") and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(again) > 50 * len(words))
        assert r["kept"] == (not r["base_failed"] and r["n_covered_words"] <= quality.MAX_COVERED * len(words) and r["longest_repeat"] <= quality.MAX_LONGEST)


def test_op9(spark, rows, tokenizer):  # noqa: F811
    found = run(spark, "op9_best_fit_packing")
    spans = check_pieces(tokenizer, rows, found.collect(), 4096)
    total = sum(size for s in spans.values() for _, size in s)
    assert len(spans) <= -(-total // 4096) * 1.02 + 1


def test_op10(spark, rows):
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in run(spark, "op10_decontaminate").collect())
    assert got == sorted(
        (i, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0) for i, n, hit, ids in plain_hits(rows, items)
    )


def test_op3(spark, rows, tokenizer):  # noqa: F811
    sizes = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows]
    got = run(spark, "op3_token_counts").collect()
    assert {r["n_tokens"]: r["n_docs"] for r in got} == Counter(sizes)
    assert all(r["truncated_total"] == sum(min(s, r["n_tokens"]) for s in sizes) for r in got)


def test_op2(spark, rows):
    got = run(spark, "op2_license_scan").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    marked = {i for i, t in rows if any(x in t for x in ("MIT License.", "CC BY-NC 4.0.", "Apache License, Version 2.0.", "General Public License, version 3."))}
    assert {r["doc_id"] for r in got if r["own"]} == marked


def test_op13(spark, rows):
    got = {r["doc_id"]: tuple(r) for r in run(spark, "op13_token_alignment").collect()}
    assert got == {r[0]: r for r in plain_alignment(rows)}

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyline.llm import simhash
from tallyline.llm.shared import components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius):
    """{value: set of the values it is linked to, over any number of steps}"""
    out, left = {}, set(values)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            todo += near
        for x in group:
            out[x] = group
    return out


def test_fingerprint_of_texts():
    texts = [None, "", " \n", "One", "a b", "The the THE the", "ünï Ünï x", "a\x0bb\x0cc d", "x y z " * 500]
    for t in texts:
        assert simhash.text_fingerprint(t) == plain_fingerprint(t)
    assert simhash.text_fingerprint(None) == simhash.text_fingerprint(" ") == 0


def test_long_text_is_counted_in_parts(monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "b", "c", "d"], k=5000))
    whole = simhash.text_fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.text_fingerprint(text) == whole == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_difference(radius):
    masks = simhash.covering_masks(radius)
    rng = random.Random(radius)
    for _ in range(3000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius)))
        assert any(not difference & m for m in masks)


def drawn_values(seed, many, flips):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = set(centres)
    while len(out) < many:
        x = rng.choice(sorted(out))
        for b in rng.sample(range(64), rng.randint(1, flips)):
            x ^= 1 << b
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize(("radius", "bucket", "flips"), [(3, 512, 5), (3, 4, 5), (3, 1, 4), (2, 3, 4), (1, 2, 3)])
def test_links_connect_what_brute_force_connects(spark, make, radius, bucket, flips):
    values = drawn_values(radius * 100 + bucket, 120, flips)
    signed = [int(np.uint64(v).view(np.int64)) for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.links(frame, radius, bucket).collect()]
    unsigned = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in links]
    assert all(a != b and (a ^ b).bit_count() <= 2 * radius for a, b in unsigned)
    want = plain_components(values, radius)
    assert all(b in want[a] for a, b in unsigned)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()} if links else {}
    got = {}
    for v, s in zip(values, signed):
        got.setdefault(found.get(s, s), set()).add(v)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values()}


def test_components_of_a_chain_a_star_and_a_pair(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(-5, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, **{k: 100 for k in range(100, 140)}, -5: -5, 200: -5}


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_with_nulls_copies_and_clashing_columns(make):
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near = base[:200] + ["changed"] + base[201:]
    rows = [
        (7, " ".join(base)), (3, " ".join(base).upper()), (9, " ".join(near)), (4, None), (2, ""), (5, " \t"),
        (6, "something else entirely here"), (6, "something else entirely here"), (None, " ".join(base)),
    ]
    docs = make(rows).withColumn("fp", F.lit("mine")).withColumn("component_id", F.lit(-1)).withColumn("key", F.lit(0))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    near_too = (simhash.text_fingerprint(rows[0][1]) ^ simhash.text_fingerprint(rows[2][1])).bit_count() <= 3
    want = [(7, 3), (3, 3), (9, 3 if near_too else 9), (4, 2), (2, 2), (5, 2), (6, 6), (6, 6), (None, 3)]
    assert got == sorted(want, key=str)
    kept = simhash.one_of_each(docs, simhash.near_duplicates(docs))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, c in want if i == c)


def test_no_documents(make):
    assert simhash.near_duplicates(make([], 1)).count() == 0

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyline.llm import license_scan

MIT = "Released under the MIT License."
APACHE = "Licensed under the Apache License, Version 2.0."


def plain(rows, least=license_scan.COSINE):
    """{path: (licence, cosine)} by comparing every line and text with every template."""
    df, lines = Counter(), 0
    known = {t for _, x in license_scan.TEMPLATES for t in license_scan.terms(x)}
    for _, _, text in rows:
        for line in (text or "").split("\n"):
            words = set(license_scan.terms(line))
            lines += bool(words)
            df.update(words & known)
    idf = {t: math.log((lines + 1) / (n + 1)) + 1 for t, n in df.items()}
    rare = math.log((lines + 1) / 2) + 1

    def vector(text):
        v = {t: n * idf.get(t, rare) for t, n in license_scan.terms(text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()} if size else {}

    out = {}
    for path, _, text in rows:
        best = (0.0, None)
        for unit in {text or "", *(text or "").split("\n")}:
            v = vector(unit)
            for name, template in license_scan.TEMPLATES:
                cosine = sum(x * v.get(t, 0.0) for t, x in vector(template).items())
                if cosine >= least - 1e-9 and (-cosine, name) < (-best[0], best[1] or "~"):
                    best = (cosine, name)
        out[path] = best
    return out


ROWS = [
    ("a/LICENSE", 1, MIT), ("a/b/c/x.py", 2, "code\nmore code"), ("a/b/COPYING.txt", 3, APACHE), ("a/b/y.py", 4, f"# {MIT}\ncode"),
    ("a/b/c/d/z.py", 5, None), ("q/w.py", 6, ""), ("top.py", 7, "the license of the work under version"), ("a/bb/v.py", 8, "text"),
    ("e/LICENSE", 9, MIT), ("e/LICENSE-2", 10, APACHE), ("e/f.py", 11, "text"), ("e/f.py", 11, "text"), (None, 12, "text"),
    ("a/long.txt", 13, "word " * 20_000 + "\n" + APACHE + "\n" + "word " * 20_000), ("a/b/notes.txt", 14, "see the MIT people"),
]


@pytest.fixture(scope="module")
def found(spark, make):
    files = spark.createDataFrame(ROWS, "path string, doc_id long, text string").withColumn("own", F.lit("mine")).withColumn("licence", F.lit(1))
    return license_scan.scanned(files.repartition(3)).collect()


def test_cosines_follow_the_definition(found):
    want = plain(ROWS)
    for r in found:
        cosine, name = want[r["path"]]
        assert r["own"] == name
        assert (r["cosine"] or 0.0) == pytest.approx(cosine)
    assert len(found) == len(ROWS)


def test_nearest_directory_gives_its_licence(found):
    got = {r["doc_id"]: (r["licence"], r["inherited"], r["source_path"]) for r in found}
    assert got[2] == got[5] == ("Apache-2.0", True, "a/b/COPYING.txt")
    assert got[14] == ("Apache-2.0", True, "a/b/COPYING.txt")
    assert got[4] == ("MIT", False, "a/b/y.py")
    assert got[8] == ("MIT", True, "a/LICENSE")
    assert got[13] == ("Apache-2.0", False, "a/long.txt")
    assert got[11][1] and got[11][2] in ("e/LICENSE", "e/LICENSE-2")
    assert got[6] == got[7] == got[12] == (None, False, None)


def test_root_licence_reaches_everything(spark, make):
    rows = [("LICENSE", 1, MIT), ("deep/down/x", 2, "t"), ("y", 3, "t")]
    got = license_scan.scanned(spark.createDataFrame(rows, "path string, doc_id long, text string")).collect()
    assert {r["licence"] for r in got} == {"MIT"}


def test_no_files(spark, make):
    assert license_scan.scanned(spark.createDataFrame([], "path string, doc_id long, text string")).count() == 0


GPL = """#!/usr/bin/env python
# thing - does things. Copyright (C) 2019 Some One
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
BSD = """/* Redistribution and use in source and binary forms,
 * with or without modification, are permitted provided
 * that the following conditions are met:
 */
"""
CODE = "\n".join(f"value_{k} = compute(input_{k}, {k})" for k in range(80))


def test_notices_over_lines_and_inside_lines(spark, make):
    rows = [
        ("g.py", 1, GPL + CODE), ("b.c", 2, BSD + CODE), ("p.txt", 3, f"Some words about the thing and its use. {MIT} More words follow here, and more.\n{CODE}"),
        ("x.py", 4, CODE), ("t/COPYING", 5, "My project\n\n" + "\n".join(license_scan.TEMPLATES[11][1][k:k + 60] for k in range(0, 1200, 60))),
        ("t/deep/y.py", 6, CODE), ("g2.py", 7, GPL.replace("version 3", "version 2") + CODE),
        ("l/LICENSE", 8, "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n"
         "Everyone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n" + "the preamble of it " * 300),
    ]
    rows += [(f"f{k}", 100 + k, "\n".join(f"the plain text of {k} and {j}" for j in range(300))) for k in range(10)]
    got = {r["doc_id"]: r["licence"] for r in license_scan.scanned(spark.createDataFrame(rows, "path string, doc_id long, text string")).collect()}
    assert {k: got[k] for k in range(1, 9)} == {
        1: "GPL-3.0", 2: "BSD-3-Clause", 3: "MIT", 4: None, 5: "MIT", 6: "MIT", 7: "GPL-2.0", 8: "GPL-3.0",
    }
    assert not any(got[k] for k in range(100, 110))

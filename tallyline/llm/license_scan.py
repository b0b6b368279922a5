"""Licences of files: TF-IDF cosine of their lines, passages and whole texts to templates, and inheritance from directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.shared import stage

#: The least cosine that names a licence.
COSINE = 0.75
#: File names that make a file the licence of its directory.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|copyright)([.\-_].*)?$"
_GNU_HEADER = (
    "is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as "
    "published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
)
_GNU_OPENING = (
    "GNU {0}GENERAL PUBLIC LICENSE Version {1} Copyright (C) {2} Free Software Foundation, Inc. Everyone is permitted to "
    "copy and distribute verbatim copies of this license document, but changing it is not allowed."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# The notices by which files are put under a licence, by licence identifier. Short licences
# are here whole, long ones with their standard header and the opening of their text.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("MIT", _MIT_GRANT + _MIT_WARRANTY),
    ("BSD-2-Clause", _BSD_GRANT + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_NAMES + _BSD_WARRANTY),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
                   "OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
                   "and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, "
                   "REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
                "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that "
                "creates, contributes to the creation of, or owns Covered Software."),
    ("GPL-2.0", _GNU_HEADER.format("", 2)),
    ("GPL-3.0", _GNU_HEADER.format("", 3)),
    ("LGPL-2.1", _GNU_HEADER.format("Lesser ", "2.1")),
    ("LGPL-3.0", _GNU_HEADER.format("Lesser ", 3)),
    ("AGPL-3.0", _GNU_HEADER.format("Affero ", 3)),
    ("GPL-2.0", _GNU_OPENING.format("", "2, June 1991", "1989, 1991")),
    ("GPL-3.0", _GNU_OPENING.format("", "3, 29 June 2007", "2007")),
    ("LGPL-2.1", _GNU_OPENING.format("LESSER ", "2.1, February 1999", "1991, 1999")),
    ("LGPL-3.0", _GNU_OPENING.format("LESSER ", "3, 29 June 2007", "2007")),
    ("AGPL-3.0", _GNU_OPENING.format("AFFERO ", "3, 19 November 2007", "2007")),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
_TERM = re.compile(r"[^\W_]+(?:\.\d+)*")


def sequence(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def terms(text: str) -> Counter[str]:
    return Counter(sequence(text))


class Matcher:
    """The templates as unit TF-IDF vectors, found through an inverted index of their heaviest terms.

    ``frequency`` gives the lines of the corpus that hold each template term, out of
    ``lines``. A term that no template has weighs like one of a single line: no
    table of all words is needed. A vector with a cosine of ``least`` must share
    one of the heaviest terms of its template, those without which the rest of
    the template is shorter than ``least``; other lines are not looked at.
    """

    def __init__(self, templates, frequency: dict[str, int], lines: int, least: float = COSINE):
        self.least = least
        self.rare = math.log((lines + 1) / 2) + 1
        self.idf = {t: math.log((lines + 1) / (n + 1)) + 1 for t, n in frequency.items()}
        self.vectors: list[tuple[str, dict[str, float]]] = []
        self.sizes: list[int] = []
        self.heavy: dict[str, list[int]] = {}
        for k, (name, text) in enumerate(templates):
            found = terms(text)
            raw = {t: n * self.idf.get(t, self.rare) for t, n in found.items()}
            size = math.sqrt(sum(x * x for x in raw.values())) or 1.0
            vector = {t: x / size for t, x in raw.items()}
            self.vectors.append((name, vector))
            self.sizes.append(sum(found.values()))
            rest = 1.0
            for term, weight in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
                if rest < least * least - 1e-9:
                    break
                self.heavy.setdefault(term, []).append(k)
                rest -= weight * weight

    def best(self, text: str) -> tuple[float, str] | None:
        """The highest cosine of at least ``least`` and its licence; the first name of equals."""
        found = terms(text)
        near = {k for t in found for k in self.heavy.get(t, ())}
        if not near:
            return None
        weights = {t: n * self.idf.get(t, self.rare) for t, n in found.items()}
        size = math.sqrt(sum(x * x for x in weights.values()))
        out = None
        for k in sorted(near):
            name, vector = self.vectors[k]
            cosine = sum(w * weights.get(t, 0.0) for t, w in vector.items()) / size
            if cosine >= self.least - 1e-9 and (out is None or (-cosine, name) < (-out[0], out[1])):
                out = (cosine, name)
        return out

    def passage(self, found: list[str], k: int) -> float:
        """The highest cosine of template ``k`` to any run of as many terms as it has, wherever lines end."""
        vector, size = self.vectors[k][1], self.sizes[k]
        idf, rare = self.idf, self.rare
        held: dict[str, int] = {}
        dot = norm = top = 0.0
        for at, term in enumerate(found):
            w, n = idf.get(term, rare), held.get(term, 0)
            held[term] = n + 1
            norm += w * w * (2 * n + 1)
            dot += w * vector.get(term, 0.0)
            if at >= size:
                term = found[at - size]
                w, n = idf.get(term, rare), held[term]
                held[term] = n - 1
                norm -= w * w * (2 * n - 1)
                dot -= w * vector.get(term, 0.0)
            if at >= size - 1 and dot > 0 and dot * dot > top * norm:
                top = dot * dot / norm
        return math.sqrt(top)

    def of_text(self, text: str | None) -> tuple[float, str] | None:
        """The best of the whole text, of all its lines and of its passages."""
        text = text or ""
        found = sequence(text)
        words = set(found)
        # No part of a text comes nearer to a template than the terms they share allow.
        near = sorted(
            k for k in {k for t in words for k in self.heavy.get(t, ())}
            if sum(w * w for t, w in self.vectors[k][1].items() if t in words) >= self.least * self.least - 1e-9
        )
        if not near:
            return None
        best = [x for x in map(self.best, {text, *text.split("\n")}) if x]
        for k in near:
            cosine = self.passage(found, k)
            if cosine >= self.least - 1e-9:
                # Sums carried along a text are rounded: what is next to 1 counts as 1.
                best.append((1.0 if cosine > 1 - 1e-9 else cosine, self.vectors[k][0]))
        return min(best, key=lambda x: (-round(x[0], 9), x[1])) if best else None


def line_frequencies(rows: DataFrame, templates) -> tuple[dict[str, int], int]:
    """Lines of all texts that hold each template term, and the number of lines with a word."""
    known = frozenset(t for _, text in templates for t in terms(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in (text or "").lower().split("\n"):
                    words = set(_TERM.findall(line))
                    if words:
                        held[""] += 1
                        held.update(words & known)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"]
        )

    counted = rows.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # As many rows as the templates have terms.
    found = {r["term"]: r["n"] for r in counted.collect()}
    return found, found.pop("", 0)


def own_licences(files: DataFrame, templates=TEMPLATES, least: float = COSINE) -> DataFrame:
    """(path, doc_id, own, cosine) for every row of ``files`` (path, doc_id, text); null where no template is near."""
    frequency, lines = line_frequencies(files, templates)
    sent = files.sparkSession.sparkContext.broadcast(Matcher(templates, frequency, lines, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.of_text(x) or (None, None) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[1] for x in found], pa.string()),
                 pa.array([x[0] for x in found], pa.float64())], ["path", "doc_id", "own", "cosine"],
            )

    rows = files.select("path", "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"path string, doc_id {kind}, own string, cosine double")


def inherited(found: DataFrame, licence_file: str = LICENCE_FILE) -> DataFrame:
    """``found`` with ``licence``, ``inherited`` and ``source_path``, the file it comes from.

    A file with a licence of its own keeps it. Any other takes that of the nearest
    directory above it that has a licence file: the one with the highest cosine,
    then the first path. Directories are joined with their ancestors, a row for
    each level; files are only joined with their own directory.
    """
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    rows = found.withColumn("__dir", F.when(F.col("path").isNotNull(), directory))
    licensed = rows.filter(F.col("own").isNotNull() & name.rlike(licence_file)).groupBy("__dir").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "path", "own")).alias("x")
    ).select(F.col("__dir").alias("__at"), F.col("x.own").alias("__own"), F.col("x.path").alias("__from"))
    parts = F.split("__dir", "/")
    # From the root, which has the empty name, down to the directory itself.
    above = F.transform(
        F.sequence(F.lit(0), F.when(F.col("__dir") == "", 0).otherwise(F.size(parts))),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("at")),
    )
    folders = rows.select("__dir").dropna().distinct().select("__dir", F.explode(above).alias("up"))
    nearest = folders.join(licensed, F.col("up.at") == F.col("__at")).groupBy("__dir").agg(
        F.max_by(F.struct("__own", "__from"), F.col("up.depth")).alias("__given")
    )
    out = rows.join(nearest, "__dir", "left")
    own = F.col("own").isNotNull()
    return out.select(
        "path", "doc_id", "own", "cosine",
        F.coalesce("own", "__given.__own").alias("licence"),
        (~own & F.col("__given").isNotNull()).alias("inherited"),
        F.when(own, F.col("path")).otherwise(F.col("__given.__from")).alias("source_path"),
    )


def scanned(
    files: DataFrame, templates=TEMPLATES, least: float = COSINE, path_col: str = "path", id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(path, doc_id, own, cosine, licence, inherited, source_path) for every row of ``files``.

    Null and empty texts have no licence of their own. A file without a path
    inherits nothing. Repeated rows come out each time; other columns are not read.
    """
    rows = files.select(F.col(path_col).alias("path"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return inherited(stage(own_licences(rows, templates, least), "licences"))

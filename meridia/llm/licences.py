"""Licence scans: TF-IDF cosine to templates, then inheritance down directories.

Every line of every file is held against short header lines; every line, every block of lines (a header
comment, a licence's title, a paragraph) and, of licence files, the whole text is held against the notices
and texts of licences: sparse TF-IDF vectors, with the document frequencies of the templates' terms counted
over all files; any other term weighs as one that a single file has. A template can be as near as the
threshold only where one of its heaviest terms (anchors) occurs, so most lines are passed by unweighed.
A file without a licence of its own takes that of the nearest directory above it, or its own, that holds a
licence file; each directory is resolved once, by joins of paths, and files join their directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import join_bounded, stored

# Identifiers and usual header lines of licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license, 3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
# The notice of the GNU licences, by their names and versions, and the text of the BSD licences, with and without its third condition.
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by
the Free Software Foundation, either version {1} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details.
You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_GNU_LICENCES = (
    ("GPL-3.0", "General Public License", "3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("GPL-2.0", "General Public License", "2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc."),
    ("LGPL-3.0", "Lesser General Public License", "3", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-2.1", "Lesser General Public License", "2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("AGPL-3.0", "Affero General Public License", "3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
)
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
{0}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission.
"""
# Notices, titles and texts of licences, as they stand in files.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    *((name, f"SPDX-License-Identifier: {name}{more}") for name, *_ in _GNU_LICENCES for more in ("-or-later", "-only", "")),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    *((name, title) for name, _, _, title in _GNU_LICENCES),
    *((name, _GNU.format(full, version)) for name, full, version, _ in _GNU_LICENCES),
    ("BSD-3-Clause", _BSD.format(_THIRD)),
    ("BSD-2-Clause", _BSD.format("")),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "MPL-2.0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
)
THRESHOLD = 0.6
#: By how much the best licence must be nearer than the next, and what a text is called that is like a licence, but not clearly one of those known.
MARGIN, UNKNOWN = 0.01, "unknown"
#: Words that tell relatives apart; a template and a text that don't share them are not of one licence.
TELLING = frozenset("lesser library affero nc nd sa by-nc by-nd by-sa by-nc-sa by-nc-nd".split())
_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)"
_LICENCE_FILE = re.compile(LICENCE_FILE)


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def versions_of(words: list[str]) -> frozenset[str]:
    """The numbers behind 'version' or 'v', whole ones without '.0'."""
    return frozenset(b.removesuffix(".0") for a, b in pairwise(words) if a in ("version", "v") and b[0].isdigit())


def vocabulary(*lists: tuple[tuple[str, str], ...]) -> frozenset[str]:
    """The terms of templates."""
    return frozenset(t for templates in lists for _, text in templates for t in terms(text))


class Scanner:
    """Templates weighed by the document frequencies of their terms."""

    def __init__(self, frequency: dict[str, int], files: int, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = THRESHOLD) -> None:
        self.least = least
        self.other = math.log((1 + files) / 2) + 1
        self.idf = {t: math.log((1 + files) / (1 + frequency.get(t, 0))) + 1 for t in vocabulary(templates)}
        self.names: list[str] = []
        self.telling: list[frozenset[str]] = []
        self.versions: list[frozenset[str]] = []
        #: By term, the templates that it weighs in, and its weight there.
        self.holds: dict[str, list[tuple[int, float]]] = {}
        anchors = set()
        for i, (name, text) in enumerate(templates):
            self.names.append(name)
            self.telling.append(TELLING.intersection(terms(text)))
            self.versions.append(versions_of(terms(text)))
            w = {t: n * self.idf[t] for t, n in Counter(terms(text)).items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            rest = 1.0
            for t, x in sorted(w.items(), key=lambda p: (-p[1], p[0])):
                self.holds.setdefault(t, []).append((i, x / norm))
                # Without any of the terms so far, what is left is too light for the threshold.
                if rest >= (least - 1e-9) ** 2:
                    anchors.add(t)
                rest -= (x / norm) ** 2
        self.anchors = frozenset(anchors)

    def cosines(self, words: list[str]) -> list[float]:
        """The cosine of words to each template; none where they hold no anchor."""
        if self.anchors.isdisjoint(words):
            return []
        norm, dots = 0.0, [0.0] * len(self.names)
        for t, n in Counter(words).items():
            x = n * self.idf.get(t, self.other)
            norm += x * x
            for i, w in self.holds.get(t, ()):
                dots[i] += x * w
        return [round(d / math.sqrt(norm), 9) for d in dots]

    def best(self, words: list[str]) -> tuple[float, int]:
        """The best cosine of words to a template, and the first template that has it; (0, -1) below the threshold."""
        found = self.cosines(words)
        top = max(found, default=0.0)
        return (top, found.index(top)) if found and top >= self.least else (0.0, -1)

    def told(self, words: list[str]) -> tuple[float, int, str | None]:
        """Cosine, template and licence of words: of the templates within the threshold that share telling words and versions with them the best, unknown where there
        is none or another licence is as near within MARGIN; (0, -1, None) below the threshold."""
        found = self.cosines(words)
        near = [i for i, c in enumerate(found) if c >= self.least]
        if not near:
            return 0.0, -1, None
        telling, versions = TELLING.intersection(words), versions_of(words)
        fit = [i for i in near if self.telling[i] == telling and not (versions and self.versions[i] and versions.isdisjoint(self.versions[i]))]
        top = min(fit or near, key=lambda i: (-found[i], i))
        clear = fit and not any(self.names[i] != self.names[top] and found[i] > found[top] - MARGIN for i in fit)
        return found[top], top, self.names[top] if clear else UNKNOWN


#: What of a file was found to be like a template, in the order in which equals count.
KINDS = ("line", "notice", "block", "file")


class Scan:
    """The two template lists over the lines, blocks and whole texts of files."""

    def __init__(self, frequency: dict[str, int], files: int, least: float = THRESHOLD, lines: tuple[tuple[str, str], ...] = TEMPLATES, notices: tuple[tuple[str, str], ...] = NOTICES) -> None:
        self.lines, self.notices = Scanner(frequency, files, lines, least), Scanner(frequency, files, notices, least)

    def text(self, text: str, licence_file: bool) -> tuple[str | None, float, int | None, str | None]:
        """Licence, cosine, number of the (first) line and kind of what is most like a template; of equals the first kind, then the first template, then the first line. A licence that is told counts before one that isn't."""
        best: tuple | None = None
        block, began, whole = [], 0, []
        lines = text.split("\n")

        def offer(scanner: Scanner, words: list[str], kind: int, at: int) -> None:
            nonlocal best
            cosine, i, name = scanner.told(words)
            if name and (best is None or (name == UNKNOWN, -cosine, kind, i, at) < best[:5]):
                best = (name == UNKNOWN, -cosine, kind, i, at, name)

        for n, line in enumerate(lines):
            words = terms(line)
            if words:
                offer(self.lines, words, 0, n)
                offer(self.notices, words, 1, n)
                began = began if block else n
                block += words
                if licence_file:
                    whole += words
            if block and (not words or n + 1 == len(lines)):
                if began < n - (not words):  # one line alone has been looked at
                    offer(self.notices, block, 2, began)
                block = []
        if licence_file and whole:
            offer(self.notices, whole, 3, 0)
        return (best[5], -best[1], best[4], KINDS[best[2]]) if best else (None, 0.0, None, None)


def _frequencies(known: frozenset[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        files = 0
        for batch in batches:
            for text in batch.column("text"):
                found.update(known.intersection(terms(text.as_py())))
                files += 1
        rows = [*found.items(), ("", files)]  # no term is empty
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], ["term", "files"])

    return count


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan: Scan = shared.value
        for batch in batches:
            named = [bool(_LICENCE_FILE.match(p.as_py().rpartition("/")[2])) for p in batch.column("path")]
            got = [scan.text(t.as_py(), f) for t, f in zip(batch.column("text"), named, strict=True)]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array(np.array([g[1] for g in got], float)), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), *cols], ["doc_id", "path", "own_license", "similarity", "line", "matched"])

    return run


def directory(path: Column) -> Column:
    """The directory of a path; '' for none."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """A directory and those above it, '' last, nearest first."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))


def scan(files: DataFrame, least: float = THRESHOLD, lines: tuple[tuple[str, str], ...] = TEMPLATES, notices: tuple[tuple[str, str], ...] = NOTICES) -> DataFrame:
    """One row per file of files(doc_id, path, text): doc_id, path, own_license, similarity, line, matched (KINDS), license, inherited_from.

    A licence is 'unknown' where a text is like one, but has words or a version that tell it apart from all that are near, or is as near to another.
    inherited_from is the directory that a licence comes from, null where it is the
    file's own or there is none. Of several licence files in one directory the most similar
    counts, then the first path. Null texts are empty, null paths ''; rows that
    repeat are scanned each; an empty table gives no rows; other columns aren't looked at.
    """
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = vocabulary(lines, notices)  # the bound of what is collected
    counts = {r["term"]: r["n"] for r in files.select("text").mapInArrow(_frequencies(known), "term string, files long").groupBy("term").agg(F.sum("files").alias("n")).collect()}
    n = counts.pop("", 0)
    shared = files.sparkSession.sparkContext.broadcast(Scan(counts, n, least, lines, notices))
    rows = files.mapInArrow(_scan(shared), "doc_id long, path string, own_license string, similarity double, line long, matched string")
    rows = stored(rows.withColumn("folder", directory(F.col("path"))), "licences")
    name = F.regexp_extract("path", r"[^/]*$", 0)
    held = rows.where(F.col("own_license").isNotNull() & name.rlike(LICENCE_FILE)).groupBy("folder").agg(F.min_by("own_license", F.struct(-F.col("similarity"), "path")).alias("given"))
    held = stored(held.select(F.col("folder").alias("above"), "given"), "folders")
    folders = rows.select("folder").distinct().select("folder", F.posexplode(ancestors(F.col("folder"))).alias("up", "above"))
    nearest = stored(join_bounded(folders, held, ["above"], "inner").groupBy("folder").agg(F.min_by(F.struct("above", "given"), "up").alias("from")), "nearest")
    lone = F.col("own_license").isNull()
    return join_bounded(rows, nearest, ["folder"]).select("doc_id", "path", "own_license", "similarity", "line", "matched", F.coalesce("own_license", "from.given").alias("license"), F.when(lone, F.col("from.above")).alias("inherited_from"))


def bound_paths(docs: DataFrame) -> DataFrame:
    """files(doc_id, path, text) of the documents table, which has no paths: folders by source and ranges of doc_id; texts under 300 characters are named as licence files."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.concat(F.when(F.length(text) < 300, "LICENSE-").otherwise("file-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    parts = [F.coalesce("source", F.lit("")), F.expr("concat('b', coalesce(doc_id div 2000, 0))"), F.expr("concat('a', coalesce(doc_id div 100, 0))"), name]
    return docs.select("doc_id", F.concat_ws("/", *parts).alias("path"), text.alias("text"))

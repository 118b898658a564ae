"""License scan: TF-IDF cosine of headers and licence files to templates, and inheritance by directory.

A text is looked at line by line, paragraph by paragraph and whole, as sparse vectors over the terms
of the templates; terms that no template has count only towards a vector's length. Document
frequencies of the templates' terms come from all texts. A notice speaks for its own file alone.
Files without one take the licence of the nearest directory above them which holds a licence file, one
named so or made of a whole licence, found by joining the few directories that hold one with the
different directories there are, not with the files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import per_row, table
from tessera.plans.scratch import Scratch

#: Least cosine of a match; a file of which at least this share of the words lies in parts that match a whole licence is a licence file.
COSINE, WHOLE = 0.7, 0.8

#: Terms that a text and its template both have or both lack.
DECISIVE = frozenset("affero lesser noncommercial nc sharealike sa noderivatives noderivs nd not never".split())

#: The wording that each licence's steward publishes for its notice and, where it is short, for its whole text.
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,"
    " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is"
    " furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
    " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,"
    " OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TWO = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the"
    " above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
    " following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY"
    " AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR"
    " CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY"
    " OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF"
    " SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE"
    " AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,"
    " NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
    " http://www.apache.org/licenses/LICENSE-2.0."
)
_APACHE_WARRANTY = (
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either"
    " express or implied. See the License for the specific language governing permissions and limitations under the License."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form"
    " or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is"
    " granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of"
    " this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as"
    " being the original software. This notice may not be removed or altered from any source distribution."
)
#: Licences of the GNU family: (name, title, version, whether the notice says "program" or "library").
_GNU = [
    ("GPL-2.0", "GNU General Public License", "2", "program"), ("GPL-3.0", "GNU General Public License", "3", "program"), ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "library"),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "library"), ("AGPL-3.0", "GNU Affero General Public License", "3", "program"),
]
#: Licences of Creative Commons: (name, short name, attributes as written out).
_CC = [
    ("CC-BY-4.0", "CC BY 4.0", "Attribution"), ("CC-BY-SA-4.0", "CC BY-SA 4.0", "Attribution-ShareAlike"), ("CC-BY-NC-4.0", "CC BY-NC 4.0", "Attribution-NonCommercial"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0", "Attribution-NoDerivatives"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0", "Attribution-NonCommercial-ShareAlike"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0", "Attribution-NonCommercial-NoDerivatives"),
]


def _templates() -> list[tuple[str, str]]:
    """(licence, text) of notices, titles, whole texts and SPDX lines."""
    out = [
        ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT license. See the LICENSE file in the project root for license information."),
        ("MIT", _MIT_GRANT), ("MIT", f"{_MIT_GRANT} {_MIT_WARRANTY}"), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", _APACHE),
        ("Apache-2.0", f"{_APACHE} {_APACHE_WARRANTY}"), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
        ("BSD-2-Clause", _BSD_TWO), ("BSD-2-Clause", f"{_BSD_TWO} {_BSD_WARRANTY}"), ("BSD-3-Clause", f"{_BSD_TWO} {_BSD_THIRD}"), ("BSD-3-Clause", f"{_BSD_TWO} {_BSD_THIRD} {_BSD_WARRANTY}"),
        ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
        ("ISC", _ISC), ("ISC", f"{_ISC} {_ISC_WARRANTY}"), ("ISC", "Released under the ISC License."), ("Unlicense", _UNLICENSE), ("Zlib", _ZLIB),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
        ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."), ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal."),
    ]
    for name, title, version, kind in _GNU:
        out += [
            (name, f"This work is licensed under the {title}, version {version}."), (name, f"Licensed under the {title}, version {version}."),
            (name, f"This {kind} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."),
            (name, f"{title} Version {version}. Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
        ]
    for name, short, attributes in _CC:
        out += [(name, f"Licensed under {short}."), (name, f"This work is licensed under a Creative Commons {attributes} 4.0 International License.")]
    plain = dict.fromkeys(name for name, _ in out if name not in {g[0] for g in _GNU})
    out += [(name, f"SPDX-License-Identifier: {name}") for name in plain]
    return out + [(name, f"SPDX-License-Identifier: {name}-{form}") for name, *_ in _GNU for form in ("only", "or-later")]


TEMPLATES = _templates()
#: Those that are a whole licence; all others are notices, titles or parts.
TEXTS = frozenset((f"{_MIT_GRANT} {_MIT_WARRANTY}", f"{_BSD_TWO} {_BSD_WARRANTY}", f"{_BSD_TWO} {_BSD_THIRD} {_BSD_WARRANTY}", f"{_ISC} {_ISC_WARRANTY}", _UNLICENSE, _ZLIB))

_term = re.compile(r"[a-z0-9]+")


def terms(text: str) -> list[str]:
    return _term.findall(text.lower())


def parts(text: str) -> list[tuple[int, int, list[str]]]:
    """(first line, line after the last, terms) of the lines, the paragraphs of several lines and the whole text."""
    lines = [terms(x) for x in text.split("\n")]
    out = [(i, i + 1, t) for i, t in enumerate(lines) if t]
    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i]:
            if i - start > 1:
                out.append((start, i, [t for x in lines[start:i] for t in x]))
            start = i + 1
    if sum(map(bool, lines)) > 1:
        out.append((0, len(lines), [t for x in lines for t in x]))
    return out


class Matcher:
    """Best template of a text by cosine of TF-IDF vectors."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[str, int], texts: int):
        self.idf = lambda t: math.log((texts + 1) / (frequency.get(t, 0) + 1)) + 1
        self.rare = math.log(texts + 1) + 1
        self.names = [name for name, _ in templates]
        self.whole = [text in TEXTS for _, text in templates]
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for k, (_, text) in enumerate(templates):
            v = {t: (1 + math.log(n)) * self.idf(t) for t, n in Counter(terms(text)).items()}
            norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
            for t, x in v.items():
                self.postings.setdefault(t, []).append((k, x / norm))
        self.known = {t: self.idf(t) for t in self.postings}
        self.decided = [(DECISIVE & set(found := terms(text)), {t for t in found if t.isdigit() and len(t) == 1}) for _, text in templates]

    def cosine(self, found: list[str], least: float) -> tuple[float, int] | None:
        """(cosine, its number) of the best template whose decisive terms agree, if at least ``least``; the first of equal ones.

        A template's single digits, those of its version, must all be found.
        """
        counts = Counter(found)
        shared = counts.keys() & self.known.keys()
        if not shared:
            return None
        weight = lambda t, n: (1 + math.log(n)) * self.known.get(t, self.rare)
        inside = {t: weight(t, counts[t]) for t in sorted(shared)}
        known = sum(x * x for x in inside.values())
        # terms of no template weigh at least rare each: most texts are done with here
        if known < least**2 * (known + (len(counts) - len(shared)) * self.rare**2):
            return None
        norm = math.sqrt(known + sum(weight(t, n) ** 2 for t, n in counts.items() if t not in shared))
        sums: dict[int, float] = {}
        for t, x in inside.items():
            for k, y in self.postings[t]:
                sums[k] = sums.get(k, 0.0) + x * y
        decided = DECISIVE & counts.keys()
        agree = [k for k, x in sums.items() if x / norm >= least and self.decided[k][0] == decided and self.decided[k][1] <= counts.keys()]
        if not agree:
            return None
        k = max(agree, key=lambda k: (sums[k], -k))
        return sums[k] / norm, k

    def match(self, text: str | None, least: float, whole: float) -> tuple[str | None, float, int, bool]:
        """(licence, cosine, first line, is a licence file) of a text; licence is null without a match."""
        best, covered = None, set()
        split = parts(text or "")
        for start, stop, found in split:
            if hit := self.cosine(found, least):
                if self.whole[hit[1]]:
                    covered.update(range(start, stop))
                if best is None or (hit[0], -start) > (best[0], -best[2]):
                    best = (*hit, start)
        if best is None:
            return None, 0.0, -1, False
        sizes = {start: len(found) for start, stop, found in split if stop == start + 1}
        share = sum(n for i, n in sizes.items() if i in covered) / sum(sizes.values())
        return self.names[best[1]], best[0], best[2], share >= whole


def frequencies(files: DataFrame, templates: list[tuple[str, str]]) -> tuple[dict[str, int], int]:
    """Texts that hold each term of the templates, over all texts, and the number of texts."""
    vocabulary = {t for _, text in templates for t in terms(text)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(at, 256).to_pylist():
                    counts.update(vocabulary.intersection(terms(text or "")))
                    counts[""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    found = files.select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    counts = {r["term"]: r["n"] for r in found}
    return counts, counts.pop("", 0)


def directory(path) -> F.Column:
    """Everything before the last slash; '' at the top."""
    return F.regexp_replace(F.coalesce(path, F.lit("")), "/?[^/]*$", "")


def scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, cosine: float = COSINE, whole: float = WHOLE, names: str = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$") -> DataFrame:
    """Columns id, path, license, score, line, license_from, depth for every row of files (id, path, text).

    license: of the part with the largest cosine (the first of equal ones), else of the nearest
    directory at or above the file's that holds a licence file, else null. A licence file has a match
    and either a name like LICENSE or little but the words of a whole licence; of several in a directory the one with
    the largest cosine counts, then the first path. depth: 0 for a licence of its own, 1 for one of
    its own directory, 2 for the directory above and so on; null without. line: the first of the
    matched part, null if inherited. license_from: the path that the licence comes from.
    Null texts match nothing; a null path is a file at the top; equal rows get equal results; a very
    long text is looked at whole; other columns are ignored; an empty table gives an empty result.
    """
    spark = files.sparkSession
    scratch = Scratch(spark, "licenses")
    files = files.select("id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    counts, texts = frequencies(files, templates)
    schema = pa.schema([("license", pa.string()), ("score", pa.float64()), ("line", pa.int32()), ("mostly", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(templates, counts, texts).match
        judge = per_row(lambda: lambda t: match(t, cosine, whole), schema)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                for found in judge(iter([part.select(["text"])])):
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("path"), *found.columns], names=["id", "path", *schema.names])

    kind = dict(files.dtypes)["id"]
    own = files.mapInArrow(run, f"id {kind}, path string, license string, score double, line int, mostly boolean")
    own = scratch.save(own.withColumn("dir", directory(F.col("path"))), "own")
    holders = own.where(F.col("license").isNotNull() & (F.col("mostly") | F.coalesce(F.col("path").rlike(names), F.lit(False))))
    best = F.min(F.struct(-F.col("score"), "path", "license")).alias("b")
    holders = holders.groupBy("dir").agg(best).select(F.col("dir").alias("above"), F.col("b.path").alias("from"), F.col("b.license").alias("theirs"))
    holders = scratch.save(holders, "holders")
    # each directory with those above it: the path cut at each of its slashes
    dirs = own.where("license is null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.size(steps), F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))).alias("up", "above"))
    nearest = above.join(holders, "above").groupBy("dir").agg(F.min(F.struct("up", "from", "theirs")).alias("n"))
    nearest = scratch.save(nearest.select(F.col("dir").alias("at"), F.col("n.up").alias("up"), F.col("n.from").alias("from"), F.col("n.theirs").alias("theirs")), "nearest")
    joined = own.join(nearest, (own["dir"] == nearest["at"]) & own["license"].isNull(), "left")
    has = F.col("license").isNotNull()
    return joined.select(
        "id",
        "path",
        F.coalesce("license", "theirs").alias("license"),
        F.when(has, F.col("score")).alias("score"),
        F.when(has, F.col("line")).alias("line"),
        F.when(has, F.col("path")).otherwise(F.col("from")).alias("license_from"),
        F.when(has, F.lit(0)).otherwise(F.col("up") + 1).alias("depth"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files of the directory of their source."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "doc_id").alias("path"), "text")
    return scan(files).select(F.col("id").alias("doc_id"), "path", "license", F.round("score", 9).alias("score"), "line", "license_from", "depth")

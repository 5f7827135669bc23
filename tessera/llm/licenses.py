"""Operator 6: licence scans by sparse TF-IDF cosine, and inheritance from the nearest directory.

A block of consecutive lines, from a single line to the whole text, is a
sparse vector over words, weighted by inverse document frequency, and is held
against templates; a block near one states that licence.  A file that consists
of such blocks for the most part is a licence file, and its licence holds for
its directory: a file without a licence of its own inherits from its nearest
ancestor directory that has one.

Blocks reach up to REACH times the words of a statement; every one is scored.
The long texts of whole licences are held against the whole file and against
blocks that start at every eighth of their length.  A file can state several
licences; of blocks that share lines, a weaker one counts only by words that
the better one's template has not.

A block near a template holds one of its anchors, the rarest words without
which no cosine can be near.  Texts without anchors are done at once.

Document frequencies are counted over all documents, for the words of the
templates; any other word counts as rare as can be.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batch, bounded, saved, slices

_MIT_NOTICE = ", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"
_MIT = f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so{_MIT_NOTICE}. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {third}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This {work} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details. You should have received a copy of the GNU {kind} Public License along with this {work}. If not, see http://www.gnu.org/licenses/."
#: Licence identifiers and statements as they are commonly written, and the long texts of whole licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", _MIT),
    ("MIT", "MIT License"),
    ("MIT-0", _MIT.replace(_MIT_NOTICE, "")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    *((name, _GNU.format(work=work, kind=kind, version=version)) for name, work, kind, version in (
        ("GPL-2.0", "program", "General", "2"), ("GPL-3.0", "program", "General", "3"), ("AGPL-3.0", "program", "Affero General", "3"), ("LGPL-2.1", "library", "Lesser General", "2.1"), ("LGPL-3.0", "library", "Lesser General", "3"),
    )),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", _BSD.format(third=_BSD_THIRD)),
    ("BSD-2-Clause", _BSD.format(third="")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "Unlicense", "Zlib")),
    *((name, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode()) for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0")),
)
#: Cosine from which a block states a licence, and share of a file's words in such blocks from which it is a licence file.
HEADER = 0.7
FILE = 0.5
#: Words from which a template is long, and how many times a statement's words a block may have.
LONG = 500
REACH = 3
#: Share of a template's squared weight that words not in a better template must have for a second licence on the same lines.
OWN = 0.1
#: Directories up to which what they inherit is broadcast.
BROADCAST_ROWS = 200_000
TOKEN = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


VOCABULARY = frozenset(w for _, t in TEMPLATES for w in words(t))


def document_frequencies(docs: DataFrame) -> tuple[int, dict[str, int]]:
    """(documents, documents that hold each template word); only these words leave a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df: Counter = Counter()
        n = 0
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                n += 1
                df.update(VOCABULARY.intersection(words(text or "")))
        yield batch(pa.schema([("w", pa.string()), ("n", pa.int64())]), [["", *df], [n, *df.values()]])

    found = {r["w"]: r["n"] for r in docs.select("text").transform(bounded).mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return found.pop("", 0), found


class Scanner:
    """Cosines of blocks of lines with the templates."""

    def __init__(self, n: int, df: dict[str, int]):
        self.rare = math.log(1 + n) + 1
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1 for w in VOCABULARY}
        self.names = [name for name, _ in TEMPLATES]
        self.sizes = np.array([len(words(text)) for _, text in TEMPLATES])
        self.vectors = [self._vector(words(text)) for _, text in TEMPLATES]
        self.row = {w: i for i, w in enumerate(sorted(VOCABULARY))}
        #: a word's share of the dot product with each template; the last row is that of any other word
        self.shares = np.zeros((len(self.row) + 1, len(TEMPLATES)))
        self.anchors: dict[str, list[int]] = {}
        for k, v in enumerate(self.vectors):
            for w, x in v.items():
                self.shares[self.row[w], k] = x * self.idf[w]
            left = 1.0
            for w, x in sorted(v.items(), key=lambda p: (-self.idf[p[0]], p[0])):  # rare ones first, for few texts to have them
                if left < HEADER * HEADER - 1e-9:
                    break
                self.anchors.setdefault(w, []).append(k)
                left -= x * x
        self.square = np.array([*(self.idf[w] ** 2 for w in sorted(VOCABULARY)), self.rare**2])

    def _vector(self, tokens: list[str]) -> dict[str, float]:
        v = {w: c * self.idf.get(w, self.rare) for w, c in Counter(tokens).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / size for w, x in v.items()}

    def _blocks(self, lines: list[list[str]], dots: np.ndarray, floor: np.ndarray, ends: np.ndarray, starts: dict[int, list[int]]) -> Iterator[tuple[float, int, int, int]]:
        """(cosine, template, from, to) of the blocks within reach, from each start, that are near one of its templates; a single line is always within reach."""
        for i, templates in sorted(starts.items()):
            use = np.array(templates)
            most = REACH * self.sizes[use]
            to = min(len(lines), max(i + 1, int(np.searchsorted(ends, ends[i] + most.max(), side="right")) - 1))
            inner = dots[i + 1 : to + 1, use] - dots[i, use]
            # a block's squared length is at least the sum over its words, so only these can be near
            near = inner * np.abs(inner) >= HEADER * HEADER * (floor[i + 1 : to + 1] - floor[i])[:, None] - 1e-9
            near &= inner > 0
            near[1:] &= (ends[i + 2 : to + 1] - ends[i])[:, None] <= most
            hits = np.flatnonzero(near.any(axis=1))
            if not len(hits):
                continue
            counts: Counter = Counter()
            length = 0.0
            for j in range(int(hits[-1]) + 1):
                for w in lines[i + j]:
                    length += self.idf.get(w, self.rare) ** 2 * (2 * counts[w] + 1)
                    counts[w] += 1
                for k in np.flatnonzero(near[j]):
                    score = float(inner[j, k]) / math.sqrt(length)
                    if score >= HEADER:
                        yield score, int(use[k]), i, i + j + 1

    def found(self, text: str) -> list[tuple[float, str, int, int]]:
        """(cosine, licence, from line, to line) of what a text states, best first."""
        if self.anchors.keys().isdisjoint(words(text)):
            return []
        lines = [words(part) for part in text.split("\n")]
        rows = np.array([self.row.get(w, -1) for line in lines for w in line], np.int64)
        ends = np.cumsum([0, *map(len, lines)])
        dots = np.concatenate([np.zeros((1, len(self.names))), np.cumsum(self.shares[rows], axis=0)])[ends]
        floor = np.concatenate([[0.0], np.cumsum(self.square[rows])])[ends]
        at: dict[int, list[int]] = {}  # template -> lines with one of its anchors
        for i, line in enumerate(lines):
            for k in {k for w in self.anchors.keys() & set(line) for k in self.anchors[w]}:
                at.setdefault(k, []).append(i)
        blocks: list[tuple[float, int, int, int]] = []
        short = [k for k in at if self.sizes[k] < LONG]
        # statements: each block that holds an anchor starts within reach of one
        starts: dict[int, list[int]] = {}
        for k in short:
            for i in {s for a in at[k] for s in range(min(a, int(np.searchsorted(ends, ends[a + 1] - REACH * self.sizes[k]))), a + 1)}:
                starts.setdefault(i, []).append(k)
        blocks += self._blocks(lines, dots, floor, ends, starts)
        for k in at:
            if k not in short:  # a long text: blocks of about its length from every eighth of it
                step = int(self.sizes[k]) // 8
                for i in sorted({int(np.searchsorted(ends, x)) for x in range(0, max(1, int(ends[-1]) - 3 * step), step)} - {len(lines)}):
                    for x in (6, 8, 10):
                        to = min(len(lines), int(np.searchsorted(ends, ends[i] + x * step)))
                        blocks += self._whole(lines, dots, floor, k, i, max(i + 1, to))
            blocks += self._whole(lines, dots, floor, k, 0, len(lines))
        kept: list[tuple[float, int, int, int]] = []
        for hit in sorted(set(blocks), key=lambda h: (-round(h[0], 9), h[2] - h[3], [-ord(c) for c in self.names[h[1]]], h[2])):
            _, k, i, j = hit
            clash = [h for h in kept if h[2] < j and i < h[3]]
            if any(h[1] == k for h in clash):
                continue
            if self._own(k, [h[1] for h in clash], set().union(*lines[i:j])):
                kept.append(hit)
        # a statement that is a part of a longer one of another licence does not count beside that
        parts = [h for h in kept if any(self.sizes[g[1]] > self.sizes[h[1]] and g[2] <= h[2] and h[3] <= g[3] and not self._own(h[1], [g[1]], self.vectors[h[1]].keys()) for g in kept)]
        return [(s, self.names[k], i, j) for s, k, i, j in kept if (s, k, i, j) not in parts]

    def _own(self, k: int, others: list[int], inside: Iterable[str]) -> bool:
        """Whether words inside a block tell template k from the templates of other licences."""
        others = [o for o in others if self.names[o] != self.names[k]]
        own = (self.vectors[k].keys() & inside).difference(*(self.vectors[o].keys() for o in others))
        return not others or sum(self.vectors[k][w] ** 2 for w in own) >= OWN

    def _whole(self, lines: list[list[str]], dots: np.ndarray, floor: np.ndarray, k: int, i: int, j: int) -> list[tuple[float, int, int, int]]:
        """The block of lines i to j, if it is near template k."""
        dot = float(dots[j, k] - dots[i, k])
        if dot <= 0 or dot * dot < HEADER * HEADER * (floor[j] - floor[i]) - 1e-9:
            return []
        counts = Counter(w for line in lines[i:j] for w in line)
        score = dot / math.sqrt(sum((c * self.idf.get(w, self.rare)) ** 2 for w, c in counts.items()))
        return [(score, k, i, j)] if score >= HEADER else []

    def file(self, text: str) -> tuple[str | None, float, str, list[str]]:
        """(best licence, its cosine, kind, all licences, best first) of a text: kind is file, header or none."""
        hits = self.found(text)
        if not hits:
            return None, 0.0, "none", []
        sizes = [len(part.split()) for part in text.split("\n")]
        inside = sum(sizes[x] for x in {x for _, _, i, j in hits for x in range(i, j)})
        return hits[0][1], min(1.0, hits[0][0]), "file" if inside >= FILE * sum(sizes) else "header", list(dict.fromkeys(h[1] for h in hits))


SCANNED = pa.schema([("path", pa.string()), ("own_license", pa.string()), ("score", pa.float64()), ("kind", pa.string()), ("own_licenses", pa.list_(pa.string()))])


def scan(docs: DataFrame, path: str = "path", keys: tuple[str, ...] = ()) -> DataFrame:
    """(path, own_license, score, kind, own_licenses, license, licenses, inherited_from, *keys) of every file (path, text).

    own_license is the one with the highest cosine, own_licenses has all that
    the text states; both are inherited.  A null or empty text has no header.
    A null path has no directory and inherits nothing.  Of several licence
    files in one directory the one with the highest cosine counts, ties to the
    smaller path.  Repeated rows each give a row, an empty table gives none.
    """
    n, df = document_frequencies(docs)
    schema = pa.schema([*SCANNED])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(n, df)
        for b in slices(batches):
            rows = [scanner.file(t or "") for t in b.column(1).to_pylist()]
            fields = [*schema, *(b.schema.field(2 + k) for k in range(len(keys)))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])), *b.columns[2:]], schema=pa.schema(fields))

    extra = "".join(f", `{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    found = saved(docs.select(F.col(path).alias("path"), "text", *keys).transform(bounded).mapInArrow(run, "path string, own_license string, score double, kind string, own_licenses array<string>" + extra), "scanned")
    parts = F.split("path", "/", -1)
    # a directory and all above it, nearest first: as many rows as the path is deep
    ancestors = F.when(F.size(parts) > 1, F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))).otherwise(F.array().cast("array<string>"))
    licensed = found.filter("kind = 'file'").withColumn("dir", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"))).filter("dir is not null")
    dirs = licensed.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own_license", "own_licenses")).alias("x")).select("dir", F.col("x.own_license").alias("dir_license"), F.col("x.own_licenses").alias("dir_licenses"))
    # the nearest licensed directory is found once for each directory, then joined to its files
    homes = found.filter("own_license is null and path is not null").select(F.get(ancestors, 0).alias("home"), ancestors.alias("up")).filter("home is not null").distinct()
    near = homes.select("home", F.posexplode("up").alias("depth", "dir")).join(dirs, "dir").groupBy("home").agg(F.min(F.struct("depth", "dir", "dir_license", "dir_licenses")).alias("x")).select("home", F.col("x.dir").alias("inherited_from"), F.col("x.dir_license").alias("inherited"), F.col("x.dir_licenses").alias("all_inherited"))
    near = saved(near, "near")
    near = F.broadcast(near) if near.count() <= BROADCAST_ROWS else near
    out = found.withColumn("home", F.when(F.col("own_license").isNull(), F.get(ancestors, 0)))
    return out.join(near, "home", "left").select("path", "own_license", "score", "kind", "own_licenses", F.coalesce("own_license", "inherited").alias("license"), F.when(F.col("own_license").isNull(), F.coalesce("all_inherited", "own_licenses")).otherwise(F.col("own_licenses")).alias("licenses"), "inherited_from", *keys)

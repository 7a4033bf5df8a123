"""Licence scan: sparse TF-IDF cosine to licence templates, then inheritance along directories.

A document's lines, paragraphs, sentences and runs of up to `RUN` adjacent ones of these within a paragraph are compared with
the templates, which are notices and the paragraphs of licence texts and headers: TF-IDF vectors over
words, document frequencies of the templates' words counted over all documents, words of no template
weighing as rare ones. A segment of cosine `SURE` or more states the nearest template's licence. The document's licence is
the one whose segments hold most words, each counting with its cosine; a reservation of all rights only counts where
nothing is granted. A document most of whose words stand in such segments, or whose first two lines hold the title
of a licence text, is a licence file and speaks for its directory. A document without a licence of its own inherits that of the nearest directory above it
that has a licence file: directories are joined with their ancestors by path, and documents with directories.

Only segments that could reach `SURE` by their template words are compared, which loses none.

Rows: null and empty texts state nothing; null paths inherit nothing; equal masses go to the first licence by name; of
several licence files in a directory the one of highest cosine, then smallest id, speaks; repeated rows stay; very long
texts are read whole, in pieces of lines and sentences; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishlens.llm.common import WordCache, written
from dishlens.operators.joins import join_unique

SURE, FILE_SHARE = 0.75, 0.5

#: Adjacent pieces (sentences or lines) that are compared as one; whole lines and paragraphs always are.
RUN = 12

#: Paragraphs of whole licence texts and headers.
_MIT = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    "files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
    "is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
    "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
    "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
    "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
_BSD = [
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution.",
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
_APACHE = [
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. ",
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 ",
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
    "governing permissions and limitations under the License.",
]
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
    "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
)

_ISC = [
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
    "that the above copyright notice and this permission notice appear in all copies.",
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
]


def _gnu(kind: str, version: int) -> list[str]:
    """The header of a GNU licence: its first paragraph, and the whole."""
    first = (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as "
        f"published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    )
    rest = (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details. You should have "
        f"received a copy of the GNU {kind} Public License along with this program. If not, see https://www.gnu.org/licenses/."
    )
    return [first, first + rest]


#: Names and wording of licence notices.
TEMPLATES = {
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
        _APACHE[0] + _APACHE[1], _APACHE[2], "".join(_APACHE),
    ],
    "bsd": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted", *_BSD],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "gpl-2": ["This work is licensed under the GNU General Public License, version 2.", *_gnu("General", 2)],
    "gpl-3": ["This work is licensed under the GNU General Public License, version 3.", *_gnu("General", 3)],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License.", *_gnu("Lesser General", 3)],
    "mit": [
        "Released under the MIT License.", "Licensed under the MIT License.", *_MIT,
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", _MPL],
    "public-domain": ["This work is dedicated to the public domain.", "This is free and unencumbered software released into the public domain."],
}
#: Titles that licence texts open with.
TITLES = {
    "apache-2.0": ["Apache License Version 2.0, January 2004", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "artistic-2.0": ["The Artistic License 2.0", "Artistic License 2.0"],
    "cc0": ["Creative Commons Legal Code CC0 1.0 Universal", "CC0 1.0 Universal"],
    "gpl-2": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "gpl-3": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "isc": ["ISC License"],
    "lgpl": [
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "mit": ["The MIT License", "MIT License"],
    "mpl-2.0": ["Mozilla Public License Version 2.0"],
}
for _name, _titles in TITLES.items():
    TEMPLATES[_name] = [*TEMPLATES.get(_name, []), *_titles]
TEMPLATES["isc"] += _ISC
RESERVED = "all-rights-reserved"
_WORD = re.compile(r"\w+(?:\.\d+)*")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _vocabulary() -> dict[str, int]:
    return {w: k for k, w in enumerate(sorted({w for t in TEMPLATES.values() for s in t for w in words(s)}))}


class Matcher:
    """Finds the licence segments of a text."""

    def __init__(self, idf: np.ndarray, rare: float, sure: float = SURE):
        self.vocabulary, self.idf, self.rare, self.sure = _vocabulary(), idf, rare, sure
        self.names, self.title, rows = [], [], []
        for name in sorted(TEMPLATES):
            for wording in TEMPLATES[name]:
                self.title.append(wording in TITLES.get(name, ()))
                row = np.zeros(len(idf))
                for word, n in Counter(words(wording)).items():
                    row[self.vocabulary[word]] = n * idf[self.vocabulary[word]]
                self.names.append(name)
                rows.append(row / np.sqrt((row**2).sum()))
        self.templates = np.array(rows)
        # a segment without any heavy word of a template holds less than `sure` of its length: no cosine reaches `sure`
        self.heavy = set()
        for row in self.templates:
            order = np.argsort(row, kind="stable")
            self.heavy.update(order[np.sqrt(np.cumsum(row[order] ** 2)) >= sure - 1e-9].tolist())
        # per chunk: words, weight of template words, words of no template, heavy words
        self.facts = WordCache(self._facts, 400_000)

    def _facts(self, chunk: str) -> tuple[int, float, int, int]:
        found = words(chunk)
        known = [self.vocabulary[w] for w in found if w in self.vocabulary]
        return len(found), float(sum(self.idf[k] for k in known)), len(found) - len(known), sum(k in self.heavy for k in known)

    def cosine(self, segment: str) -> tuple[float, int]:
        """Cosine to the nearest template, and its number."""
        counts = Counter(words(segment))
        row, square = np.zeros(len(self.idf)), 0.0
        for word, n in counts.items():
            at = self.vocabulary.get(word)
            weight = n * (self.rare if at is None else self.idf[at])
            square += weight**2
            if at is not None:
                row[at] = weight
        if not square:
            return 0.0, 0
        values = self.templates @ row / np.sqrt(square)
        best = int(values.argmax())
        return float(values[best]), best

    def _segments(self, pieces: list[tuple[int, int, int, int]], facts: np.ndarray) -> list[tuple[int, int]]:
        """Bounds, in chunks, of the runs of pieces (start, end, line, paragraph) that could reach `sure`.

        cosine <= |template part| / |all|; the former is at most the sum of its weights, the latter's rest at least rare * sqrt(n).
        """
        start, end, line, paragraph = np.array(pieces).T
        sums = np.concatenate([np.zeros((1, 4)), np.cumsum(facts, 0)])
        first = np.concatenate([np.arange(len(start) - k) for k in range(min(RUN, len(start)))])
        last = np.concatenate([np.arange(k, len(start)) for k in range(min(RUN, len(start)))])
        for group in (line, paragraph):
            low, count = np.unique(group, return_index=True, return_counts=True)[1:]
            first, last = np.concatenate([first, low]), np.concatenate([last, low + count - 1])
        part = sums[end[last]] - sums[start[first]]
        square = part[:, 1] ** 2
        may = (part[:, 3] > 0) & (square >= self.sure**2 * (square + self.rare**2 * part[:, 2]) - 1e-9)
        may &= paragraph[first] == paragraph[last]
        return sorted({(int(a), int(b)) for a, b in zip(start[first[may]], end[last[may]], strict=True)})

    @staticmethod
    def _lines(pieces: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
        """Bounds of the lines that hold a word, in order."""
        ends: dict[int, tuple[int, int]] = {}
        for a, b, line, _ in pieces:
            ends[line] = (ends.get(line, (a, b))[0], b)
        return list(ends.values())

    def scan(self, text: str) -> tuple[str | None, float, float]:
        """(licence, its best cosine, share of the words in licence segments; 1 for a text that opens with a title)."""
        parts, pieces, paragraph = [], [], 0
        lines = [line.replace("\t", " ").split(" ") for line in text.split("\n")]
        found = [[self.facts[p] for p in line] for line in lines]
        if not any(f[3] for line in found for f in line):
            return None, 0.0, 0.0
        for number, (line, facts) in enumerate(zip(lines, found, strict=True)):
            at = len(parts)
            parts += line
            if not any(f[0] for f in facts):
                paragraph += 1
                continue
            cuts = [at + k + 1 for k, p in enumerate(line) if p[-1:] in ".!?" and p and k + 1 < len(line)]
            bounds = [at, *cuts, len(parts)]
            pieces += [(a, b, number, paragraph) for a, b in zip(bounds, bounds[1:], strict=False)]
        facts = np.array([f for line in found for f in line], float)
        masses: dict[str, np.ndarray] = {}
        titled = False
        openings = [next(k for k in range(a, b) if facts[k, 0]) for a, b in self._lines(pieces)[:2]]
        for a, b in self._segments(pieces, facts):
            value, at = self.cosine(" ".join(parts[a:b]))
            if value >= self.sure:
                mass = masses.setdefault(self.names[at], np.zeros(len(parts)))
                mass[a:b] = np.maximum(mass[a:b], value)
                titled |= self.title[at] and any(a <= o < b for o in openings)
        if not masses:
            return None, 0.0, 0.0
        granted = {n: float(m @ facts[:, 0]) for n, m in masses.items() if n != RESERVED}
        licence = max(sorted(granted), key=granted.__getitem__) if granted else RESERVED
        stated = np.any([m > 0 for m in masses.values()], 0)
        share = 1.0 if titled else float(facts[stated, 0].sum() / facts[:, 0].sum())
        return licence, float(masses[licence].max()), share


def corpus_weights(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Inverse document frequencies of the templates' words over all documents, and that of a word never seen."""
    vocabulary = _vocabulary()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = WordCache(lambda c: tuple(vocabulary[w] for w in words(c) if w in vocabulary) or None, 400_000)
        sums, n = np.zeros(len(vocabulary), np.int64), 0
        for pdf in batches:
            n += len(pdf)
            for text in pdf["text"]:
                found = filter(None, map(cache.__getitem__, set(text.replace("\n", " ").replace("\t", " ").split(" "))))
                sums[list({k for ks in found for k in ks})] += 1
        yield pd.DataFrame({"word": [-1, *range(len(sums))], "n": [n, *sums]})

    rows = docs.select("text").mapInPandas(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}  # one row per template word
    n = found.get(-1, 0)
    idf = np.array([np.log((1 + n) / (1 + found.get(k, 0))) + 1 for k in range(len(vocabulary))])
    return idf, float(np.log(1 + n) + 1)


def ancestors(path):
    """All directories above a path, nearest first, as an array column; '' is the root."""
    parts = F.split(path, "/")
    ups = F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1))
    return F.transform(ups, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def scan_licenses(files: DataFrame, sure: float = SURE) -> DataFrame:
    """(doc_id, path, own_license, cosine, license_file, license, inherited_from) of a table (doc_id, path, text)."""
    given = files.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    idf, rare = corpus_weights(given)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(idf, rare, sure)
        for pdf in batches:
            rows = [matcher.scan(t) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "path": pdf["path"],
                "own_license": [r[0] for r in rows], "cosine": [r[1] for r in rows],
                "license_file": [r[2] >= FILE_SHARE for r in rows],
            })

    found = written(
        given.mapInPandas(scan, "doc_id long, path string, own_license string, cosine double, license_file boolean"),
        "licenses",
    )
    directory = F.get(ancestors(F.col("path")), F.lit(0))
    rank = F.struct(F.col("cosine"), -F.col("doc_id"), F.col("own_license"))
    speaking = found.filter(F.col("license_file") & F.col("path").isNotNull()).groupBy(directory.alias("above")).agg(
        F.max_by("own_license", rank).alias("spoken")
    )
    # each directory once: a directory that holds a third of the files is one row here
    needed = found.filter(F.col("own_license").isNull() & F.col("path").isNotNull()).select(directory.alias("directory")).distinct()
    up = needed.select("directory", F.explode(F.concat(F.array("directory"), ancestors(F.col("directory")))).alias("above"))
    nearest = up.join(speaking, "above").groupBy("directory").agg(
        F.max_by(F.struct("spoken", "above"), F.length("above")).alias("n")
    )
    own = found.filter("own_license IS NOT NULL").withColumns({"license": F.col("own_license"), "inherited_from": F.lit(None).cast("string")})
    # only files without a licence of their own are joined, a directory's many files from several tasks
    bare = found.filter("own_license IS NULL").withColumn("directory", directory)
    left = join_unique(bare, nearest, ["directory"], "left", ["doc_id", "path"]).withColumns(
        {"license": F.col("n.spoken"), "inherited_from": F.col("n.above")}
    )
    columns = ["doc_id", "path", "own_license", "cosine", "license_file", "license", "inherited_from"]
    return own.select(*columns).unionByName(left.select(*columns))

"""Licence scans: sparse TF-IDF cosine of headers, licence files and notices to templates, and inheritance along directories.

A text is a sparse vector over the templates' words; every other word is a dimension of its own with the weight of an unseen word, so what
speaks of other things stays far from all templates. Document frequencies are counted over all lines of all files. Three kinds of text of a file are compared: each line, and each
run of lines as a notice may be wrapped, with the notices; its header (the lines before the first blank one) and the whole of it, as a licence
file is, with the full texts of short licences. The closest counts. A file without a licence inherits that of the nearest directory above it
that holds a licence file, found by a join on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, written

#: Short notices by which files state their licence.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    "BSD-2-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the 2-Clause BSD License"),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license", "Licensed under the 3-Clause BSD License"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", "GNU General Public License Version 2, June 1991"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007"),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License Version 3, 29 June 2007"),
    "MIT": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
}

_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
)
#: The full texts of licences that are short enough to stand in a file's header.
FULL_TEXTS = {
    "BSD-2-Clause": (_BSD + _WARRANTY,),
    "BSD-3-Clause": (_BSD + _BSD_NAMES + _WARRANTY,),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
}

TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"


def terms(line: str) -> Counter:
    return Counter(TERM.findall(line.lower()))


class Templates:
    """The templates as unit vectors under given document frequencies; bounded by the template list."""

    def __init__(self, templates: dict[str, tuple[str, ...]], frequency: dict[str, int], n_lines: int, threshold: float):
        self.threshold = threshold
        self.vocabulary = {t for notices in templates.values() for n in notices for t in terms(n)}
        self.idf = {t: self._idf(frequency.get(t, 0), n_lines) for t in self.vocabulary}
        self.unseen = self._idf(0, n_lines)
        #: A notice of n words is wrapped over n lines at most.
        self.most_lines = max((len(TERM.findall(n.lower())) for notices in templates.values() for n in notices), default=1)
        self.vectors: list[tuple[str, dict[str, float]]] = []
        #: Words of which a line needs one at least: what is left of a template without them lies under the threshold.
        self.needed: set[str] = set()
        for name, notices in sorted(templates.items()):
            for notice in notices:
                weights = {t: n * self.idf[t] for t, n in terms(notice).items()}
                norm = math.sqrt(sum(x * x for x in weights.values()))
                unit = {t: x / norm for t, x in weights.items()}
                self.vectors.append((name, unit))
                left = 1.0
                for t in sorted(unit, key=lambda t: (-unit[t], t)):
                    if left < 0.999 * threshold * threshold:
                        break
                    self.needed.add(t)
                    left -= unit[t] ** 2

    @staticmethod
    def _idf(df: int, n: int) -> float:
        return math.log((1 + n) / (1 + df)) + 1

    def closest(self, line: str) -> tuple[float, str] | None:
        """The best (cosine, licence) at or over the threshold; ties go to the first name."""
        return self._closest(terms(line))

    def closest_run(self, text: str) -> tuple[float, str] | None:
        """closest() over all runs of up to most_lines lines, those without words left out; ties go to the first and shortest run."""
        lines = [found for line in text.split("\n") if (found := terms(line))]
        wanted = [not self.needed.isdisjoint(found) for found in lines]
        known = [not self.vocabulary.isdisjoint(found) for found in lines]
        best, last = None, -1
        ahead = [k for k, hit in enumerate(wanted) if hit]
        for k in ahead:
            # runs whose first line with a needed word is k; at their ends stand lines with a template's word: others only add length
            for first in range(max(last + 1, k - self.most_lines + 1), k + 1):
                if not known[first]:
                    continue
                joined: Counter = Counter()
                for end in range(first, min(len(lines), first + self.most_lines)):
                    joined.update(lines[end])
                    if end >= k and known[end]:
                        found = self._closest(joined)
                        if found and (best is None or found[0] > best[0] + 1e-12):
                            best = found
            last = k
        return best

    def _closest(self, found: Counter) -> tuple[float, str] | None:
        if self.needed.isdisjoint(found):
            return None
        norm = math.sqrt(sum((n * self.idf.get(t, self.unseen)) ** 2 for t, n in found.items()))
        best = None
        for name, unit in self.vectors:
            cosine = sum(x * found[t] * self.idf[t] for t, x in unit.items() if t in found) / norm
            if cosine >= self.threshold and (best is None or cosine > best[0] + 1e-12):
                best = (cosine, name)
        return best


def header_of(text: str) -> str:
    """The lines before the first blank one, blank lines at the start left out."""
    return re.split(r"\n[ \t\r]*\n", text.lstrip("\n\r \t"), maxsplit=1)[0]


def line_frequencies(files: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """In how many lines each template word stands, and how many lines there are; over all files. One row a task and word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                for line in text.lower().split("\n"):
                    found = TERM.findall(line)
                    if found:
                        seen[""] += 1
                        seen.update(vocabulary.intersection(found))
        yield pd.DataFrame({"term": list(seen), "n": [seen[t] for t in seen]}, columns=["term", "n"]).astype({"term": str, "n": "int64"})

    rows = files.select("text").mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a template word
    counts = {r["term"]: r["n"] for r in rows}
    return counts, counts.pop("", 0)


def scan_licenses(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", is_licence_file: Column | None = None,
                  templates: dict[str, tuple[str, ...]] = TEMPLATES, full_texts: dict[str, tuple[str, ...]] = FULL_TEXTS, threshold: float = 0.6) -> DataFrame:
    """doc_id, path, own_license, own_score, license, inherited_from for every row.

    own_license is the template closest to any line or run of lines, to the header or to the whole text, from cosine `threshold` on; own_score
    is that cosine (0 without one); ties go to notices, then the header. license is it, or what the nearest directory above has: the licence of the licence file in it with the
    highest score (ties: the first licence by name). inherited_from is that directory, null where nothing is inherited; it is empty
    for the root of relative paths and "/" for that of absolute ones. A
    licence file is one that is_licence_file marks (by default its name says so) and that has a licence. Null texts are
    empty, a null path has no directories, repeated rows are scored one by one, a licence nobody states is null. An
    empty table gives an empty result.
    """
    marked = F.coalesce(is_licence_file if is_licence_file is not None else path.rlike(LICENCE_FILE), F.lit(False))
    rows = files.select(F.col(id_col).alias("doc_id"), path.cast("string").alias("path"), marked.alias("is_file"), text_of(text_col).alias("text"))
    vocabulary = Templates(templates, {}, 1, threshold).vocabulary | Templates(full_texts, {}, 1, threshold).vocabulary
    counted = line_frequencies(rows, vocabulary)
    shapes, whole = Templates(templates, *counted, threshold), Templates(full_texts, *counted, threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, scores = [], []
            for text in batch["text"]:
                lower, best = text.lower(), (0.0, None)
                if any(t in lower for t in shapes.needed):
                    best = shapes.closest_run(text) or best
                if any(t in lower for t in whole.needed):
                    for part in (header_of(text), text):
                        found = whole.closest(part)
                        if found and found[0] > best[0] + 1e-12:
                            best = found
                names.append(best[1])
                scores.append(best[0])
            out = batch.drop(columns="text")
            yield out.assign(own_license=pd.Series(names, index=out.index, dtype=object), own_score=scores)

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInPandas(run, f"doc_id {kind}, path string, is_file boolean, own_license string, own_score double")
    scored = written(scored, "license-scores", compression="zstd")

    directory = F.when(F.col("path").rlike("^/[^/]*$"), "/").otherwise(F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    best = F.struct(-F.col("own_score"), F.col("own_license"))
    held = scored.where("is_file and own_license is not null and path is not null").groupBy(directory.alias("directory")).agg(F.min_by("own_license", best).alias("held"))
    held = written(held, "license-directories")
    # the directories above a path: its root and its first 1, 2, ... parts
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.concat_ws("/", F.slice(parts, 1, n)))
    above = F.transform(above, lambda d: F.when((d == "") & F.col("path").startswith("/"), "/").otherwise(d))
    folders = scored.where("own_license is null and path is not null").select(directory.alias("folder"), above.alias("above")).distinct()
    steps = folders.select("folder", F.posexplode("above").alias("depth", "directory"))
    nearest = steps.join(held, "directory").groupBy("folder").agg(F.max_by(F.struct("directory", "held"), "depth").alias("from"))
    nearest = written(nearest, "license-nearest")
    joined = scored.join(nearest, F.when(F.col("own_license").isNull(), directory) == F.col("folder"), "left")
    return joined.select(
        "doc_id",
        "path",
        "own_license",
        "own_score",
        F.coalesce("own_license", F.col("from.held")).alias("license"),
        F.col("from.directory").alias("inherited_from"),
    )


def document_path(docs: DataFrame) -> Column:
    """A path for each document: its source, the thousand and the hundred of its id, its id."""
    number = F.col("doc_id")
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(number / 1000).cast("string"), F.floor(number / 100).cast("string"), number.cast("string"))


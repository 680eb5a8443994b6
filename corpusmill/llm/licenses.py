"""License scans: sparse TF-IDF cosine to templates, then directory inheritance.

A header is what may be a notice: a line of a text that names a license, a run of
such lines, a paragraph that has one, or a run of such paragraphs. Its sparse
TF-IDF vector is compared with those of the notices and texts of known licenses.
Document frequencies of all terms of headers are counted over all documents;
those of terms outside the templates stay in tables, and meet the distinct headers
in joins. A file that is almost all notice is a license file. Files without a
license of their own inherit that of the license file in the nearest ancestor
directory, by joins on paths; those are made for distinct directories, not files.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import arrow_map, parts, utf8, written

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program. If not, see <https://www.gnu.org/licenses/>."
#: Notices and texts by SPDX identifier, several wordings each. The licenses' usual ones.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "SPDX-License-Identifier: Apache-2.0"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", _PERMISSION, f"MIT License Copyright (c) {_PERMISSION} {_WARRANTY}", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", "GNU General Public License as published by the Free Software Foundation, either version 3 of the License", _GNU.format("General Public License", 3), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0"),
    "GPL-2.0": ("Licensed under the GNU General Public License, version 2", _GNU.format("General Public License", 2), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0"),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3", _GNU.format("Lesser General Public License", 3), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0"),
    "LGPL-2.1": ("Licensed under the GNU Lesser General Public License, version 2.1", _GNU.format("Lesser General Public License", 2.1), "SPDX-License-Identifier: LGPL-2.1"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3", _GNU.format("Affero General Public License", 3), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted", f"{_REDISTRIBUTION} {_ENDORSEMENT}", f"BSD 3-Clause License Copyright (c) All rights reserved. {_REDISTRIBUTION} {_ENDORSEMENT} {_DISCLAIMER}", "SPDX-License-Identifier: BSD-3-Clause"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License", _REDISTRIBUTION, f"BSD 2-Clause License Copyright (c) {_REDISTRIBUTION} {_DISCLAIMER}", "SPDX-License-Identifier: BSD-2-Clause"),
    "ISC": ("Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Released into the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"),
    "Proprietary": ("All rights reserved", "Copyright, all rights reserved"),
}
CUE = re.compile(rb"(?i)licen[sc]e|copyright|rights reserved|permission (?:is hereby|to use)|public domain|redistribution and use")
#: A paragraph or run of at most so many bytes is looked at as a whole; of a longer one, stretches of so many words round each line with a cue.
NOTICE = 1 << 14
STRETCHES = (8, 16, 32, 64, 128, 256, 512)
#: Bits of the filter of terms that are counted, and distinct terms that a task counts at once.
FILTER = 1 << 22
TERMS = 1 << 18
TERM = re.compile(rb"[a-z0-9]+(?:\.[0-9]+)*|[\x80-\xff]+")
#: Cosine from which a header is of a license, and the share of a file's terms that agree with a license which makes it a license file.
LEAST, WHOLE = 0.6, 0.8


def terms(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())


VOCABULARY = sorted({t for notices in TEMPLATES.values() for n in notices for t in terms(n.encode())})


def frequencies(files: DataFrame) -> tuple[int, dict[bytes, int]]:
    """The number of texts, and of those that hold each term of the templates; what reaches the driver is as long as the vocabulary."""
    known = frozenset(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in utf8(batch.column(0)):
                seen.update(known.intersection(terms(text or b"")))
                seen[b""] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    found = {bytes(r["term"]): r["n"] for r in arrow_map(files.select("text"), run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), found


def weigher(n: int, seen: dict[bytes, int]):
    """text terms -> (sparse unit vector of template terms, number of terms); other terms only lengthen it."""
    idf = {t: math.log((1 + n) / (1 + seen.get(t, 0))) + 1 for t in VOCABULARY}
    other = math.log(1 + n) + 1

    def vector(words: list[bytes]) -> dict[bytes, float]:
        weights = {t: c * idf.get(t, other) for t, c in Counter(words).items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        return {t: w / norm for t, w in weights.items() if t in idf} if norm else {}

    return vector


def stretches(lines: list[bytes]) -> Iterator[bytes]:
    """Of many lines, those from each line with a cue on, up to it, and round it, of as many words as each of STRETCHES."""
    sizes = np.cumsum([0, *(len(terms(x)) for x in lines)])
    for i, line in enumerate(lines):
        if CUE.search(line):
            for n in STRETCHES:
                first = int(np.searchsorted(sizes, sizes[i + 1] - n, "right")) - 1
                last = int(np.searchsorted(sizes, sizes[i] + n))
                half = int(np.searchsorted(sizes, sizes[i] - n // 2, "right")) - 1, int(np.searchsorted(sizes, sizes[i + 1] + n // 2))
                for a, b in ((i, last), (first, i + 1), half):
                    own = lines[max(0, a) : b]
                    if len(own) > 1 and sum(map(len, own)) <= NOTICE:  # as long as that in few words, it is no notice
                        yield b"\n".join(own)


def headers(text: bytes) -> list[bytes]:
    """Lines with a cue, runs of adjacent ones (with the lines between blank), paragraphs with one, and runs of such paragraphs; of those beyond NOTICE, stretches of them."""
    out: list[bytes] = []
    lines: list[bytes] = []
    block: list[bytes] = []
    blocks: list[bytes] = []

    def end(run: list[bytes]) -> None:
        if len(run) > 1 and sum(map(len, run)) <= NOTICE:
            out.append(b"\n".join(run))
        elif len(run) > 1:
            out.extend(stretches([x for part in run for x in part.split(b"\n")]))
        run.clear()

    def paragraph() -> None:
        whole = b"\n".join(block)
        if block and CUE.search(whole):
            blocks.append(whole)
            end(block)
        elif block:
            end(blocks)
        block.clear()

    for line in [*text.split(b"\n"), b""]:
        if not line.strip():
            paragraph()
            continue
        block.append(line)
        if CUE.search(line):
            out.append(line)
            lines.append(line)
        else:
            end(lines)
    end(lines)
    end(blocks)
    return out


def filter_of(asked: DataFrame) -> np.ndarray:
    """A bit for each hash of a term of asked, FILTER bits whatever their number: terms without their bit needn't be counted."""
    places = asked.select(F.pmod(F.xxhash64("term"), F.lit(FILTER)).alias("p"))
    words = places.groupBy(F.expr("shiftright(p, 6)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    out = np.zeros(FILTER >> 6, np.int64)
    for w, bits in words.collect():  # at most FILTER / 64 rows
        out[w] = bits
    return out.view(np.uint64)


def header_lengths(headed: DataFrame, files: DataFrame, n: int) -> DataFrame:
    """headed (.., headers array<binary>), files (.., text) -> (a, b, header, others): distinct headers, named by a 128-bit hash, with the squared weights of their terms outside the templates."""
    known = frozenset(VOCABULARY)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(a, b, t, c) for a, b, h in zip(*[x.to_pylist() for x in batch.columns], strict=True) for t, c in Counter(terms(h)).items() if t not in known]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["a", "b", "term", "c"])

    distinct = written(headed.select(F.explode("headers").alias("header")).distinct().select(F.xxhash64("header").alias("a"), F.xxhash64(F.lit(1), "header").alias("b"), "header"), "headers")
    asked = written(arrow_map(distinct, split, "a long, b long, term binary, c long"), "header-terms")
    bits = filter_of(asked)

    def wanted(seen: Counter) -> pa.RecordBatch:
        places = np.array([xxhash.xxh64_intdigest(t, 42) % FILTER for t in seen], np.int64)
        kept = (bits[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["held", "n"]).filter(pa.array(kept))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in utf8(batch.column(0)):
                seen.update(set(terms(text or b"")) - known)
            if len(seen) >= TERMS:
                yield wanted(seen)
                seen.clear()
        yield wanted(seen)

    counts = arrow_map(files.select("text"), count, "held binary, n long").groupBy("held").agg(F.sum("n").alias("n"))
    weight = F.col("c") * (F.log((1 + n) / (1 + F.coalesce("n", F.lit(0)))) + 1)
    seen = written(counts.join(asked.select("term").distinct(), F.col("held") == F.col("term"), "left_semi"), "held")
    others = asked.join(seen, F.col("term") == F.col("held"), "left").groupBy("a", "b").agg(F.sum(weight * weight).alias("others"))
    return distinct.join(others, ["a", "b"], "left").select("a", "b", "header", F.coalesce("others", F.lit(0.0)).alias("others"))


def own_licenses(files: DataFrame, n: int, seen: dict[bytes, int]) -> DataFrame:
    """files (id, path, text) -> (id, path, own_license, own_score, is_license_file)."""
    vector = weigher(n, seen)
    templates = [(name, vector(terms(t.encode()))) for name, notices in TEMPLATES.items() for t in notices]
    idf = {t: math.log((1 + n) / (1 + seen.get(t, 0))) + 1 for t in VOCABULARY}

    def closest(words: list[bytes], others: float | None = None) -> tuple[float, str | None]:
        """The best cosine and its license; without the squared weights of other terms, a bound: their idf is 1 at least."""
        counts = Counter(words)
        v = {t: c * idf[t] for t, c in counts.items() if t in idf}
        rest = sum(c * c for t, c in counts.items() if t not in idf) if others is None else others
        norm = math.sqrt(sum(w * w for w in v.values()) + rest) or 1.0
        best, name = 0.0, None
        for license_, t in templates:
            if (got := sum(w * t[x] for x, w in v.items() if x in t) / norm) > best:
                best, name = got, license_
        return best, name

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            found, sizes = [], []
            for text in utf8(batch.column(2)):
                own = dict.fromkeys(headers(text)) if text and CUE.search(text) else ()
                found.append([h for h in own if closest(terms(h))[0] >= LEAST])  # no other can reach it
                sizes.append(len(terms(text)) if found[-1] else 0)
            rows = pa.array(range(row, row + batch.num_rows), pa.int64())
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary())), pa.array(sizes, pa.int64())], ["row", "id", "path", "headers", "size"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, sizes = [], [], []
            for header, others in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = terms(header)
                best, name = closest(words, others)
                names.append(name)
                scores.append(best)
                sizes.append(len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64())], ["a", "b", "name", "score", "words"])

    kind = files.schema["id"].dataType.simpleString()
    headed = written(arrow_map(files.select("id", "path", "text"), find, f"row long, id {kind}, path string, headers array<binary>, size long"), "headed")
    scored = written(arrow_map(header_lengths(headed, files, n), score, "a long, b long, name string, score double, words long").where(F.col("score") >= LEAST), "scored")
    each = headed.select("row", F.posexplode("headers").alias("at", "header")).select("row", "at", F.xxhash64("header").alias("a"), F.xxhash64(F.lit(1), "header").alias("b")).join(scored, ["a", "b"])
    # the header with most words that agree counts, so a text isn't taken for what one of its lines is in another license
    agree = F.struct((F.col("score") * F.col("words")).alias("agree"), "score", (-F.col("at")).alias("place"), "name")
    best = each.groupBy(F.col("row").alias("row_")).agg(F.max(agree).alias("b"))
    joined = headed.join(best, F.col("row") == F.col("row_"), "left")
    return joined.select("id", "path", F.col("b.name").alias("own_license"), F.col("b.score").alias("own_score"), F.coalesce(F.col("b.agree") >= WHOLE * F.col("size"), F.lit(False)).alias("is_license_file"))


LICENSE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"


def license_scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row for each row of files: (id, path, own_license, own_score, license, from_dir).

    license: the file's own, or that of from_dir, the nearest directory at or
    above the file's with a license file (by name, or all notice). Of several
    license files in a directory the best score counts, then the name; of headers
    that agree alike the first in the text, and of templates the first in the table. A
    long text is split at its lines in Python, one text at a time. A null path
    is one in the root directory, ''; null and empty texts have no license of their
    own. Repeated rows each get a row and count each as a document. An empty table
    gives an empty result; other columns aren't read.
    """
    source = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    n, seen = frequencies(source)
    own = written(own_licenses(source, n, seen), "licenses")
    placed = own.withColumn("dir", F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("")))
    holders = placed.where("own_license is not null and (is_license_file or path rlike '%s')" % LICENSE_NAME.replace("'", "''"))
    given = holders.groupBy(F.col("dir").alias("above")).agg(F.max(F.struct("own_score", "own_license"))["own_license"].alias("given"))
    dirs = placed.select("dir").distinct()
    parts = F.split("dir", "/")
    ancestors = dirs.select("dir", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts)))).alias("depth")).select("dir", "depth", F.array_join(F.slice(F.split("dir", "/"), F.lit(1), F.col("depth")), "/").alias("above"))
    nearest = ancestors.join(given, "above").groupBy(F.col("dir").alias("of")).agg(F.max(F.struct("depth", "above", "given")).alias("g"))
    # written, so that the join shuffles both sides and a large directory's rows can be split
    joined = placed.join(written(nearest, "nearest"), F.col("dir") == F.col("of"), "left")
    inherits = F.col("own_license").isNull()
    return joined.select(F.col("id").alias(id_col), F.col("path").alias(path_col), "own_license", "own_score", F.coalesce("own_license", "g.given").alias("license"), F.when(inherits, F.col("g.above")).alias("from_dir"))

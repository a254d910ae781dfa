"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

Blocks of consecutive lines about as long as a template, from single lines to whole license bodies, are
compared with it, with token weights from all texts. A block is looked at only if it holds one of the template's key tokens: the
others are so common that without a key no block can reach THRESHOLD. The best block names a text's own
license. A text most of which is the body of a license, or that is as a whole like a template, is a license file and holds for its
directory; a source file with a license's body as its header names its own license only. Texts without a license of their own take that of the nearest directory above them
that has one, found by joining each directory's ancestors with the licensed directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fathom.llm._common import join_counted, stage, table


@dataclass(frozen=True)
class Template:
    """body: the text of a license itself or its beginning, as in a license file; else a notice that names it. length: the tokens of the whole license, where the text is only its beginning."""

    license: str
    text: str
    body: bool = False
    length: int = 0


#: The notices and the bodies (of the long ones the beginning) of common licenses.
TEMPLATES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License."""),
    Template("Apache-2.0", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/
TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.
"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.""", True, 1600),
    Template("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    Template("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""", True),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    Template("GPL-3.0", """GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007
Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.
Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works.
The licenses for most software and other practical works are designed to take away your freedom to share and change the works.""", True, 5700),
    Template("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", True),
    Template("MIT", "Released under the MIT License."),
    Template("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", True),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    Template("proprietary", "Copyright. All rights reserved."),
)
THRESHOLD = 0.6
#: A license file is one of whose tokens the license's body makes up this share at least.
COVERS = 0.5
TOKEN = re.compile(r"[a-z0-9]+")
#: Distinct tokens that a task counts before it passes them on.
HELD_TOKENS = 1 << 18


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def document_counts(files: DataFrame) -> tuple[DataFrame, int]:
    """t, n: how many texts hold each token of any text, as a written table; and how many texts there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(set(tokens(text)))
                seen[""] += 1
                if len(seen) > HELD_TOKENS:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["t", "n"])
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["t", "n"])

    counts = stage(files.select("text").mapInArrow(run, "t string, n long").groupBy("t").agg(F.sum("n").alias("n")), "license-tokens")
    total = counts.filter("t = ''").first()
    return counts.filter("t <> ''"), total["n"] if total else 0


class Matcher:
    """Templates as weighted vectors, their key tokens, and the blocks of a text that may be like them."""

    def __init__(self, templates: tuple[Template, ...], counts: Mapping[str, int], total: int, threshold: float) -> None:
        self.threshold, self.templates = threshold, templates
        self.idf = {t: math.log((total + 1) / (counts.get(t, 0) + 1)) + 1 for x in templates for t in tokens(x.text)}
        self.vectors = [Counter(tokens(x.text)) for x in templates]
        self.sizes = [sum(v.values()) for v in self.vectors]
        self.norms = [math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in v.items())) for v in self.vectors]
        self.keys: dict[str, list[int]] = {}
        for k, v in enumerate(self.vectors):
            # A block of tokens that hold less than threshold² of the template's squared norm stays under the threshold.
            room = threshold**2 * self.norms[k] ** 2
            for t in sorted(v, key=lambda t: (self.idf[t], t)):
                room -= (v[t] * self.idf[t]) ** 2
                if room <= 0:
                    self.keys.setdefault(t, []).append(k)

    def blocks(self, lines: list[list[str]]) -> set[tuple[int, int, int]]:
        """(template, first line, last line) of the blocks to compare: from every line so far that the template's tokens are reached, and the whole text."""
        out = set()
        for j, line in enumerate(lines):
            for k in {k for t in set(line) for k in self.keys.get(t, ())}:
                out.add((k, 0, len(lines) - 1))
                first, held = j, 0  # a block reaches line j if the lines from its start to there are too few
                while first > 0 and held + len(lines[first - 1]) < self.sizes[k]:
                    first -= 1
                    held += len(lines[first])
                for start in range(first, j + 1):
                    end, held = start, len(lines[start])
                    while end + 1 < len(lines) and held < self.sizes[k]:
                        end += 1
                        held += len(lines[end])
                    out.add((k, start, end))
        return out

    def candidates(self, text: str | None) -> list[tuple[int, int, int, float, float, list[tuple[str, int]], bool]]:
        """(template, first line, last line, product, squared norm of the known tokens, the other tokens, is a license file's) of the blocks that can reach the threshold."""
        text = (text or "").lower()
        if self.keys.keys().isdisjoint(TOKEN.findall(text)):
            return []
        lines = [TOKEN.findall(x) for x in text.split("\n")]
        total, out = sum(map(len, lines)), []
        for k, a, b in sorted(self.blocks(lines)):
            counts = Counter(t for line in lines[a : b + 1] for t in line)
            product = sum(n * counts.get(t, 0) * self.idf[t] ** 2 for t, n in self.vectors[k].items()) / self.norms[k]
            known = sum((n * self.idf[t]) ** 2 for t, n in counts.items() if t in self.idf)
            others = sorted((t, n) for t, n in counts.items() if t not in self.idf)
            # A token weighs 1 at least.
            if product >= self.threshold * math.sqrt(known + sum(n * n for _, n in others)) * (1 - 1e-12):
                # Of a license known by its beginning, what follows it counts as license up to its length.
                covered = sum(counts.values()) + max(0, self.templates[k].length - self.sizes[k])
                whole = (a == 0 and b == len(lines) - 1) or (self.templates[k].body and covered >= COVERS * total)
                out.append((k, a, b, product, known, others, whole))
        return out


def own_licenses(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, dir, own, own_score, line (1-based, the block's first), file_score and file_license (the license it is the file of, or null) for every row. files: doc_id, dir, text.

    The templates, a parameter of the job, go to every task with their tokens' weights.
    """
    counts, total = document_counts(files)
    spark, vocabulary = files.sparkSession, sorted({t for x in templates for t in tokens(x.text)})
    wanted = spark.createDataFrame([(t,) for t in vocabulary], "t string")
    known = {r["t"]: r["n"] for r in counts.join(F.broadcast(wanted), "t").collect()}  # a row a template token
    matcher = Matcher(templates, known, total, threshold)
    kind = "array<struct<k:int,a:int,b:int,product:double,known:double,others:array<struct<t:string,n:int>>,whole:boolean>>"
    names = ("k", "a", "b", "product", "known", "others", "whole")
    inner = pa.list_(pa.struct([("k", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("product", pa.float64()), ("known", pa.float64()), ("others", pa.list_(pa.struct([("t", pa.string()), ("n", pa.int32())]))), ("whole", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{**dict(zip(names, c, strict=True)), "others": [{"t": t, "n": n} for t, n in c[5]]} for c in matcher.candidates(text)] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("dir"), pa.array(found, inner)], names=["doc_id", "dir", "found"])

    rows = files.select("doc_id", "dir", "text").mapInArrow(run, f"doc_id {dict(files.dtypes)['doc_id']}, dir string, found {kind}")
    # The ids number a written table, so they are stable.
    rows = stage(rows, "license-candidates").withColumn("rid", F.monotonically_increasing_id())
    blocks = rows.select("rid", F.posexplode("found").alias("no", "x")).select("rid", "no", "x.*")
    blocks = stage(blocks, "license-blocks")
    weight = F.log(F.lit(total + 1.0) / (F.col("n") + 1.0)) + 1
    rest = blocks.select("rid", "no", F.explode("others").alias("o")).select("rid", "no", F.col("o.t").alias("t"), F.col("o.n").alias("m"))
    # A word that many texts hold is one key of many rows, so such words are broadcast.
    pairs = counts.agg(F.sum("n")).first()[0] or 0
    rest = join_counted(rest, counts.withColumn("texts", F.col("n")), ["t"], "texts", pairs).groupBy("rid", "no").agg(F.sum((F.col("m") * weight) ** 2).alias("rest"))
    hits = blocks.join(rest, ["rid", "no"], "left").withColumn("score", F.round(F.col("product") / F.sqrt(F.col("known") + F.coalesce("rest", F.lit(0.0))), 9)).filter(F.col("score") >= threshold)
    names_of = F.create_map(*(F.lit(x) for k, t in enumerate(templates) for x in (k, t.license)))
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("a"), names_of[F.col("k")].alias("license"))).alias("best")
    # A license file holds for its directory by the block that makes it one.
    file = F.min(F.when(F.col("whole"), F.struct((-F.col("score")).alias("s"), F.col("a"), names_of[F.col("k")].alias("license")))).alias("file")
    hits = hits.groupBy("rid").agg(best, file)
    out = rows.select("rid", "doc_id", "dir").join(hits, "rid", "left")
    return out.select("doc_id", "dir", F.col("best.license").alias("own"), (-F.col("best.s")).alias("own_score"), (F.col("best.a") + 1).cast("long").alias("line"), (-F.col("file.s")).alias("file_score"), F.col("file.license").alias("file_license"))


def scan(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, dir, own, own_score, line, license, inherited_from for every row of files (doc_id, dir, text).

    license is the own one or else that of the nearest directory, from dir upwards, with a license file; of
    several files the best score, then the smallest doc_id, counts. A null dir is the root ''. A null or
    empty text has no license of its own; a very long text is compared block by block. Of equally good blocks the first counts, then the license by name. Repeated rows are judged each; an empty table gives no rows; further
    columns are ignored.
    """
    own = stage(own_licenses(files.withColumn("dir", F.coalesce("dir", F.lit(""))), templates, threshold), "own-licenses")
    licensed = own.filter("file_license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("file_score")).alias("s"), "doc_id", "file_license"))["file_license"].alias("dir_license"))
    dirs = own.select("dir").distinct()
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    up = dirs.select("dir", F.explode(F.array_distinct(above)).alias("up"))
    nearest = up.join(licensed.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), "up", "dir_license")).alias("best"))
    nearest = nearest.select("dir", F.col("best.up").alias("up"), F.col("best.dir_license").alias("dir_license"))
    df = own.join(nearest, "dir", "left")
    return df.select(
        "doc_id", "dir", "own", "own_score", "line", F.coalesce("own", "dir_license").alias("license"),
        F.when(F.col("own").isNull(), F.col("up")).alias("inherited_from"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no paths: source / lang / thousand of the doc_id stands for the directory."""
    docs = table(spark, sf_dir, "documents")
    place = F.concat_ws("/", "source", "lang", F.expr("doc_id div 1000").cast("string"))
    return scan(docs.select("doc_id", place.alias("dir"), "text"))

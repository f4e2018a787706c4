"""Licence scan in DataFrame functions only: cosine of headers and licence files to templates, then inheritance from the
nearest directory.

Units of a text are its header (the first and the last block of lines, parted by blank lines), every line, every sentence
of a line, and, if its name is that of a licence file, the whole text. Each unit is compared with every template (whole
licences, their headers and titles, and single sentences) by the cosine of sparse TF-IDF vectors. The weights of the
templates' words come from the number of documents that hold them, counted over all documents; a word no template has
weighs as one that no document holds, at each occurrence. A unit without any of a template's rarest words cannot reach
the threshold (by Cauchy and Schwarz, the words left over are too light), so only texts and lines with one of these anchor
words are scored, and a template only counts words for units that hold enough of its weight. Scoring happens inside the
row: the vocabulary is a constant.

A file's own licence is that of its best unit; ties go to the first template, then to the first line. ``line`` is the line of
the unit, 0 for a first block or whole text, the text's last line for a last block. A licence file speaks for its directory
(the best unit, then the smallest path). A file without a licence of its own takes that of the nearest directory above it:
the distinct directories are joined to their ancestors, and files to their directory, where directories with a
thousandth of all files or more are broadcast.

Null or empty texts have no licence. A null path has no directory and inherits nothing. Rows that repeat a path are rows
of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadscope.llm.common import checkpoint, join_counted, query, table, utf8

#: Fixed values: (licence, a text that states it).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    # Titles that licence files begin with.
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    # Headers and whole licences.
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""),
    ("MIT", """MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", """Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS
PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Copyright (c) All rights reserved. Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of
the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE
LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License
along with this program. If not, see https://www.gnu.org/licenses/"""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR
A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License
along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
)
LEAST = 0.8
#: A name that speaks for its directory.
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)[^/]*$"


def words(text: Column) -> Column:
    """Words of letters and digits of ASCII, in lower case, repeats included."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def template_words(sentence: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", sentence.lower())


@dataclass
class Weights:
    """Weight of each vocabulary word, of any other word, and the words that a line must have one of."""

    idf: dict[str, float]
    other: float
    anchors: list[str]


def weigh(files: DataFrame, templates=TEMPLATES, least: float = LEAST) -> Weights:
    """Document counts of the templates' words over all files; one row per word reaches the driver."""
    vocabulary = sorted({w for _, s in templates for w in template_words(s)})
    held = F.array_intersect(words(utf8(files["text"])), F.array(*[F.lit(w) for w in vocabulary]))
    # The empty word stands for the document itself.
    counts = files.select(F.explode(F.array_append(held, "")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}
    total = found.get("", 0)
    idf = {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 1 for w in vocabulary}
    anchors: set[str] = set()
    for _, sentence in templates:
        weight = template_weight(sentence, idf)
        left = whole = sum(x * x for x in weight.values())
        for w in sorted(weight, key=lambda w: (-idf[w], w)):  # rarest first: fewer texts to score
            if left < (least - 1e-6) ** 2 * whole:
                break
            anchors.add(w)
            left -= weight[w] ** 2
    return Weights(idf, math.log(total + 1) + 1, sorted(anchors))


def template_weight(sentence: str, idf: dict[str, float]) -> dict[str, float]:
    parts = template_words(sentence)
    return {w: parts.count(w) * idf[w] for w in dict.fromkeys(parts)}


def anchored(text: Column, weights: Weights) -> Column:
    """Whether a text or line has an anchor word."""
    return F.arrays_overlap(words(text), F.array(*[F.lit(w) for w in weights.anchors]).cast("array<string>"))


def units(text: Column, whole: Column, weights: Weights) -> Column:
    """Array of (line, text): lines with an anchor word and their sentences, the first and the last block, and the whole
    text where ``whole`` says so."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("text"))), lambda s: anchored(s["text"], weights))
    sentences = F.flatten(F.transform(lines, lambda s: F.transform(F.split(s["text"], "[.;:] +"), lambda x: F.struct(s["line"].alias("line"), x.alias("text")))))
    blocks = F.filter(F.split(text, "\n[ \t\r\n]*\n"), lambda b: b.rlike("[A-Za-z0-9]"))
    last = F.size(F.split(text, "\n")) - 1
    ends = F.when(F.size(blocks) > 0, F.array(
        F.struct(F.lit(0).alias("line"), F.element_at(blocks, 1).alias("text")), F.struct(last.alias("line"), F.element_at(blocks, -1).alias("text"))))
    every = F.when(whole, F.array(F.struct(F.lit(0).alias("line"), text.alias("text"))))
    return F.flatten(F.filter(F.array(lines, sentences, ends, every), lambda a: a.isNotNull()))


def best_unit(text: Column, whole: Column, weights: Weights, templates=TEMPLATES, least: float = LEAST) -> Column:
    """Struct (score, license, line) of the best unit, null if none reaches the threshold or the text is null."""
    vocabulary = list(weights.idf)
    table_of = F.map_from_arrays(F.array(*[F.lit(w) for w in vocabulary]), F.array(*[F.lit(weights.idf[w]) for w in vocabulary]))
    weight = [template_weight(t, weights.idf) for _, t in templates]
    length = [math.sqrt(sum(x * x for x in w.values())) for w in weight]
    mine = [F.map_from_arrays(F.array(*[F.lit(w) for w in t]), F.array(*[F.lit(x) for x in t.values()])) for t in weight]

    def opened(s: Column) -> Column:
        own = words(s["text"])
        inside = F.filter(own, lambda w: w.isin(*vocabulary))
        return F.struct(s["line"].alias("line"), inside.alias("inside"), F.array_distinct(inside).alias("held"), (F.size(own) - F.size(inside)).alias("strange"))

    def reaches(s: Column) -> Column:
        """Whether the unit holds enough of some template's weight for the threshold."""
        def covered(m: Column) -> Column:
            return F.aggregate(s["held"], F.lit(0.0), lambda a, w: a + F.coalesce(F.pow(F.try_element_at(m, w), F.lit(2.0)), F.lit(0.0)))

        return reduce(or_, [covered(m) >= (least - 1e-6) ** 2 * n * n for m, n in zip(mine, length)])

    def scored(s: Column) -> Column:
        distinct = F.transform(s["held"], lambda w: F.struct(
            w.alias("w"), (F.size(F.filter(s["inside"], lambda x: x == w)) * F.element_at(table_of, w)).alias("x")))
        return F.struct(s["line"].alias("line"), distinct.alias("words"), s["strange"].alias("strange"))

    def against(s: Column, k: int) -> Column:
        dot = F.aggregate(s["words"], F.lit(0.0), lambda a, p: a + p["x"] * F.coalesce(F.try_element_at(mine[k], p["w"]), F.lit(0.0)))
        norm = F.sqrt(F.aggregate(s["words"], F.lit(0.0), lambda a, p: a + p["x"] * p["x"]) + s["strange"] * F.lit(weights.other**2))
        return F.struct(F.round(dot / (norm * F.lit(length[k])), 9).alias("score"), F.lit(-k).alias("order"), (-s["line"]).alias("back"))

    likely = F.transform(F.filter(F.transform(units(text, whole, weights), opened), reaches), scored)
    best = F.array_max(F.flatten(F.transform(likely, lambda s: F.array(*[against(s, k) for k in range(len(templates))]))))
    names = F.array(*[F.lit(n) for n, _ in templates])
    found = F.struct(best["score"].alias("score"), F.element_at(names, 1 - best["order"]).alias("license"), (-best["back"]).alias("line"))
    return F.when(best["score"] >= least, found)


def directory(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", ""))


def inherited(files: DataFrame) -> DataFrame:
    """``files`` (key, path, license, score, line) with ``origin`` and ``source_dir``; files must be read from storage."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    placed = files.withColumn("dir", directory(F.col("path")))
    speaking = placed.filter(F.col("license").isNotNull() & F.col("dir").isNotNull() & name.rlike(LICENSE_FILE))
    best = F.min(F.struct((-F.col("score")).alias("cost"), "path", "license"))
    of_dir = speaking.groupBy("dir").agg(best.alias("best")).select("dir", F.col("best.license").alias("dir_license"))
    dirs = placed.filter(F.col("dir").isNotNull()).groupBy("dir").agg(F.count("*").alias("rows"))
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(steps, 1, n), "/").alias("above")))).alias("x")).select("dir", "x.depth", F.col("x.above").alias("above"))
    under = above.groupBy("above").agg(F.count("*").alias("n"))
    known = of_dir.withColumnRenamed("dir", "above").join(under, "above")
    nearest = join_counted(above, known, "above", "n").groupBy("dir").agg(F.max(F.struct("depth", F.col("above").alias("source_dir"), "dir_license")).alias("near"))
    given = dirs.join(nearest, "dir", "left").select("dir", "rows", "near.source_dir", "near.dir_license")
    joined = join_counted(placed.filter(F.col("dir").isNotNull()), given, "dir", "rows")
    orphans = placed.filter(F.col("dir").isNull()).withColumns({"source_dir": F.lit(None).cast("string"), "dir_license": F.lit(None).cast("string")})
    every = joined.unionByName(orphans)
    own = F.col("license").isNotNull()
    return every.select(
        *[c for c in files.columns if c != "license"], F.coalesce("license", "dir_license").alias("license"),
        F.when(own, "own").when(F.col("dir_license").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~own, F.col("source_dir")).alias("source_dir"))


def scan(files: DataFrame, key: str = "doc_id", templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """(key, path, score, line, license, origin, source_dir) of every row of ``files`` (key, path, text)."""
    weights = weigh(files, templates, least)
    # Texts without an anchor word are nulled first: their lines are not looked at.
    text = utf8(files["text"])
    likely = files.select(key, "path", F.when(anchored(text, weights), text).alias("text"))
    whole = F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILE), F.lit(False))
    found = likely.select(key, "path", best_unit(F.col("text"), whole, weights, templates, least).alias("best"))
    return inherited(checkpoint(found.select(key, "path", "best.score", "best.line", "best.license")))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: the source, two levels of directories by id; a text that ends in its notice is a licence file."""
    def level(n: int) -> Column:
        return F.concat(F.lit("d"), F.floor(F.abs(F.col("doc_id")) / n).cast("string"))

    last = F.lower(F.substring_index(utf8(F.col("text")), "\n", -1))
    name = F.concat(F.when(F.contains(last, F.lit("licens")), "LICENSE-").otherwise("file-"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), level(1000), level(100), name).alias("path"), "text")


def _sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    low = "lower({})"

    def split(text: str) -> str:
        return f"list_filter(regexp_split_to_array({low.format(text)}, '[^a-z0-9]+'), lambda w: w <> '')"

    values = ", ".join(f"({k}, {quoted(n)}, {quoted(s)})" for k, (n, s) in enumerate(TEMPLATES))
    return f"""
with docs as (
  select doc_id, coalesce(text, '') as text, coalesce(source, 'none') || '/d' || cast(abs(doc_id) // 1000 as varchar) || '/d' || cast(abs(doc_id) // 100 as varchar) as dir
  from documents),
named as (
  select *, dir || '/' || case when contains({low.format("string_split(text, chr(10))[-1]")}, 'licens') then 'LICENSE-' else 'file-' end || cast(doc_id as varchar) as path from docs),
template as (select * from (values {values}) t(k, license, sentence)),
tword as (select k, w, count(*) as tf from (select k, unnest({split("sentence")}) as w from template) group by k, w),
vocab as (select distinct w from tword),
total as (select count(*) as n from documents),
df as (select w, count(*) as n from (select unnest(list_distinct({split("text")})) as w from docs) where w in (select w from vocab) group by w),
idf as (select v.w, ln((t.n + 1) / (coalesce(df.n, 0) + 1)) + 1 as x from vocab v cross join total t left join df on df.w = v.w),
lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from docs),
blocks as (
  select doc_id, path, text, len(string_split(text, chr(10))) - 1 as last,
    list_filter(regexp_split_to_array(text, '\\n[ \\t\\r\\n]*\\n'), lambda b: regexp_matches(b, '[A-Za-z0-9]')) as b from named),
units as (
  select *, row_number() over () as unit from (
    select doc_id, pos, line from lines
    union all select doc_id, pos, unnest(regexp_split_to_array(line, '[.;:] +')) from lines
    union all select doc_id, 0, b[1] from blocks where len(b) > 0
    union all select doc_id, last, b[-1] from blocks where len(b) > 0
    union all select doc_id, 0, text from blocks where path like '%/LICENSE-%')),
lword as (
  select l.doc_id, l.pos, l.unit, l.w, count(*) as tf from (select doc_id, pos, unit, unnest({split("line")}) as w from units) l
  group by l.doc_id, l.pos, l.unit, l.w),
weighted as (
  select l.doc_id, l.pos, l.unit, l.w, l.tf * i.x as x, case when i.w is null then l.tf * (select (ln(n + 1) + 1) ** 2 from total) else (l.tf * i.x) ** 2 end as sq
  from lword l left join idf i on i.w = l.w),
lnorm as (select unit, sqrt(sum(sq)) as norm from weighted group by unit),
tnorm as (select k, sqrt(sum((t.tf * i.x) ** 2)) as norm from tword t join idf i on i.w = t.w group by k),
dots as (
  select l.doc_id, l.pos, l.unit, t.k, sum(l.x * t.tf * i.x) as dot from weighted l join tword t on t.w = l.w join idf i on i.w = l.w group by l.doc_id, l.pos, l.unit, t.k),
scored as (
  select d.doc_id, d.pos, d.k, round(d.dot / (ln.norm * tn.norm), 9) as score from dots d join lnorm ln on ln.unit = d.unit join tnorm tn on tn.k = d.k),
best as (
  select doc_id, pos, score, license from (
    select s.*, t.license, row_number() over (partition by doc_id order by score desc, s.k, pos) as r from scored s join template t on t.k = s.k where score >= {LEAST})
  where r = 1),
files as (select n.doc_id, n.path, n.dir, b.score, b.pos, b.license from named n left join best b on b.doc_id = n.doc_id),
speaking as (
  select dir, license from (select *, row_number() over (partition by dir order by score desc, path) as r from files where license is not null and path like '%/LICENSE-%') where r = 1),
near as (select distinct on (f.dir) f.dir, s.dir as source_dir, s.license from (select distinct dir from files) f join speaking s on f.dir = s.dir or starts_with(f.dir, s.dir || '/') order by f.dir, length(s.dir) desc)
select f.doc_id, f.path, round(f.score, 6) as score, cast(f.pos as int) as line, coalesce(f.license, n.license) as license,
  case when f.license is not null then 'own' when n.license is not null then 'inherited' else 'none' end as origin,
  case when f.license is null then n.source_dir end as source_dir
from files f left join near n on n.dir = f.dir
"""


@query("op3_licenses", _sql())
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return scan(as_files(docs)).withColumn("score", F.round("score", 6))

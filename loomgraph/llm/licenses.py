"""Licence scans with DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance by path joins.

A file is looked at in units: its lines, its sentences (of lines), its blocks (between empty lines), the block of
comments that it opens with, and the file as a whole. So a one-line notice, a notice within a longer line, a header wrapped
over many lines and a licence file each meet the template that they resemble. A unit and a template are sparse vectors
of tf * idf over all their words; a word's document frequency is counted over all files, also that of words no template has.

Which units can reach the threshold is decided exactly before any vector is made: of each template, the rarest terms
without which what is left of its length is below the threshold (cosine <= length of the shared terms / length of the
template). Units without such a term can't match. Different units are scored once, however many files have them.

The best template of the best unit, if its cosine reaches the threshold, is the file's own licence. A file that is a
licence file speaks for its directory: a file without a licence of its own takes that of the nearest directory above
it. Each directory is resolved once, by joins of directories with their ancestors, and the files are joined with
the result.

To the driver come the templates' terms with their frequencies (bounded by the templates). Broadcast: the templates' terms and, after
they have been counted, small tables of texts and directories; larger ones are joined by a shuffle.

Defined cases: a null or empty text has no licence of its own; a null path is a file in the root directory; of equal
cosines (to six decimals) the earlier licence by name, of several licence files of a directory the best cosine and then the licence's
name decide; copies of a text get equal results and each counts in the document frequencies; an empty table gives an empty
result; other columns are never looked at. A text's units are held with the text in its row, some five times its size.
"""

from __future__ import annotations

import re
from collections import Counter
from math import log, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, small_side
from .decontam import text_key

# Notices, standard headers and texts by which licences are known, as (licence, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write
        to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see
        <https://www.gnu.org/licenses/>."""),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in
        the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
        See the GNU Lesser General Public License for more details."""),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MIT", """MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
        IN THE SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
        ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors
        may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS
        OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
        (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
        REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]
STOP = ["a", "all", "and", "are", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "this", "to", "under", "with", "without"]
THRESHOLD = 0.75
FILE_NAME = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)[^/]*$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words, of texts in lower case.
GAP = "[^0-9a-z]+"
SENTENCE = "[.!?][ \\t\\r]+"
BLANK = "\\n[ \\t\\r]*\\n"
#: The lines a file opens with that start as comments do.
HEADER = "\\A((?:[ \\t]*(?:#|//|/\\*|\\*|--|;|%|<!--)[^\\n]*\\n?)+)"


def tokens_of(text: str) -> list[str]:
    return [w for w in re.split(GAP, text.translate(str.maketrans(UPPER, LOWER))) if w and w not in STOP]


def _words(unit: Column) -> Column:
    """The words of a unit in lower case."""
    return F.filter(F.split(unit, GAP), lambda w: (w != "") & ~w.isin(STOP))


def units(text: Column) -> Column:
    """The distinct units of a text in lower case."""
    lines = F.split(text, "\n")
    return F.array_distinct(F.concat(lines, F.flatten(F.transform(lines, lambda x: F.split(x, SENTENCE))), F.split(text, BLANK), F.array(F.regexp_extract(text, HEADER, 1), text)))


class Templates:
    """The templates' vectors, given the document frequencies of their words."""

    def __init__(self, templates: list[tuple[str, str]], df: dict[str, int], n: int, threshold: float):
        self.rows: list[tuple[str, int, str, float]] = []  # licence, number, term, part of the unit vector
        strong: set[str] = set()
        for k, (name, text) in enumerate(templates):
            tf = Counter(tokens_of(text))
            w = {t: c * (log((n + 1) / (df.get(t, 0) + 1)) + 1) for t, c in tf.items()}
            length = sqrt(sum(x * x for x in w.values()))
            self.rows += [(name, k, t, x / length) for t, x in sorted(w.items())]
            left = 1.0  # squared share of the length that the terms not taken yet have
            for t, x in sorted(w.items(), key=lambda i: (-i[1], i[0])):
                if left < threshold**2 * (1 - 1e-9):
                    break
                strong.add(t)
                left -= (x / length) ** 2
        self.strong = sorted(strong)


def own_licenses(texts: DataFrame, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(k1, k2, own, own_score) for the different texts (k1, k2, t) with a unit near a template; at most one row each."""
    spark = texts.sparkSession
    texts = texts.withColumn("t", F.translate("t", UPPER, LOWER))
    n = texts.count()
    words = texts.select(F.explode(F.array_distinct(_words(F.col("t")))).alias("term"))
    frequency = checkpointed(words.groupBy("term").agg(F.count("*").alias("df")))  # one row for each word of the corpus
    vocabulary = sorted({w for _, t in templates for w in tokens_of(t)})
    df = {r.term: r.df for r in frequency.where(F.col("term").isin(vocabulary)).collect()}
    made = Templates(templates, df, n, threshold)
    terms = spark.createDataFrame(made.rows, "template string, number int, term string, w double")

    strong = "(?<![0-9a-z])(?:" + "|".join(made.strong) + ")(?![0-9a-z])"
    near = texts.where(F.col("t").rlike(strong)).select("k1", "k2", F.explode(F.filter(units(F.col("t")), lambda u: u.rlike(strong))).alias("u"))
    near = near.select("k1", "k2", _words(F.col("u")).alias("words"))
    # A word weighs tf at least and tf times the largest idf at most, so a unit with too many words of no template stays below the threshold.
    known = F.size(F.filter("words", lambda w: w.isin(vocabulary)))
    near = near.where(F.size("words") - known <= known * known * F.lit((log(n + 1) + 1) ** 2 * (1 / threshold**2 - 1)))
    near = checkpointed(near.select("k1", "k2", F.xxhash64("words").alias("u1"), F.xxhash64(F.lit(1), "words").alias("u2"), "words"))
    different = near.dropDuplicates(["u1", "u2"]).select("u1", "u2", F.explode("words").alias("term")).groupBy("u1", "u2", "term").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * (F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    vectors = checkpointed(different.join(frequency, "term", "left").select("u1", "u2", "term", weight.alias("u")))
    length = vectors.groupBy("u1", "u2").agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("length"))
    dot = vectors.join(F.broadcast(terms), "term").groupBy("u1", "u2", "template", "number").agg(F.sum(F.col("u") * F.col("w")).alias("dot"))
    # A sum's last digits depend on its order: rounding keeps ties and the threshold the same everywhere.
    cosine = dot.join(length, ["u1", "u2"]).select("u1", "u2", "template", F.round(F.col("dot") / F.col("length"), 6).alias("cosine")).where(F.col("cosine") >= threshold)
    best = F.min_by(F.struct("template", "cosine"), F.struct(-F.col("cosine"), "template"))
    scored = checkpointed(cosine.groupBy("u1", "u2").agg(best.alias("b")))
    hit = near.select("k1", "k2", "u1", "u2").join(small_side(scored, scored.count()), ["u1", "u2"]).select("k1", "k2", "b.template", "b.cosine")
    return hit.groupBy("k1", "k2").agg(best.alias("b")).select("k1", "k2", F.col("b.template").alias("own"), F.col("b.cosine").alias("own_score"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def scan(files: DataFrame, id_col: str, path_col: str, text_col: str, is_license_file: Column | None = None, threshold: float = THRESHOLD, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """A row for each file: id, path, own_license, own_score, license, found (header, file, inherited, none), from_dir.

    is_license_file: which files with a licence speak for their directory; by default those with the usual names.
    """
    k1, k2 = text_key(files[text_col])
    path = F.coalesce(files[path_col], F.lit(""))
    notice = F.coalesce(path.rlike(FILE_NAME) if is_license_file is None else is_license_file, F.lit(False))
    texts = files.select(k1.alias("k1"), k2.alias("k2"), F.coalesce(files[text_col], F.lit("")).alias("t"))
    own = checkpointed(own_licenses(texts, threshold, templates))
    narrow = files.select(files[id_col].alias(id_col), path.alias("path"), notice.alias("notice"), k1.alias("k1"), k2.alias("k2"))
    rows = narrow.join(small_side(own, own.count()), ["k1", "k2"], "left").withColumn("dir", _parent(F.col("path")))
    rows = checkpointed(rows.drop("k1", "k2"))

    best = F.min_by("own", F.struct(-F.col("own_score"), "own"))
    spoken = rows.where(F.col("notice") & F.col("own").isNotNull()).groupBy("dir").agg(best.alias("dir_license"))
    dirs = rows.select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))).alias("depth"))
    above = above.select("dir", "depth", F.array_join(F.slice(parts, 1, F.col("depth")), "/").alias("above"))
    nearest = above.join(spoken.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max_by(F.struct("dir_license", "above"), "depth").alias("near"))
    nearest = checkpointed(nearest.select(F.col("dir").alias("d"), "near"))
    out = rows.join(small_side(nearest, nearest.count()), F.col("dir") == F.col("d"), "left")
    found = F.when(F.col("own").isNotNull(), F.when(F.col("notice"), "file").otherwise("header")).when(F.col("near").isNotNull(), "inherited").otherwise("none")
    return out.select(
        id_col, "path", F.col("own").alias("own_license"), F.col("own_score"), F.coalesce("own", "near.dir_license").alias("license"), found.alias("found"),
        F.when(found == "inherited", F.col("near.above")).alias("from_dir"),
    )

"""License scans, in DataFrame operations only: TF-IDF cosine to templates, then inheritance along directories.

Three things are compared with templates. *Licence files*: the whole text of every document with a licence cue or a disclaimer's
words, as a TF-IDF vector ((1 + ln tf) * idf, idf counted over these documents), with the vectors of whole licence texts; a cosine of
``FILE_LEAST`` or more names the licence. Whole texts are the short ones below and those of a folder, one file a licence, its name the
licence's (``folder``, by default the public texts that lie beside this module; None adds none). *Parts*: a piece of a licence text
is as near to it as the whole is, if only the piece's own terms are looked at: the cosine of its vector with the template's on those
terms. ``PART_LEAST`` or more names the licence if the two share ``PART_TERMS`` terms, or ``FEW_TERMS`` where no line names one.
*Headers*: the lines with a cue, each by itself and with the lines before and behind it (notices are wrapped), with one-line
templates, idf counted over these of the whole corpus; the best line with a cosine of ``LEAST`` or more names the licence, where the
document as a whole names none. "All rights reserved" counts only where nothing else is named, and a text whose lines name
three licences or more talks about licences and declares none.

Only terms of the templates, whose number and size are bounded (``TEXTS``), are sent to tasks; any other term weighs as one
that is seen once. A file is a licence file of its directory if its text is one, if its name says so, or if the lines that count
hold at least half of its words. Directories are then resolved to their nearest ancestor (or self) that has a licence file,
and documents without a declaration inherit by a path join.

A directory may hold a third of all rows: directories are resolved once each, and reach the documents by (directory, salt).

Defined results: null and empty texts declare nothing; texts of any length are compared whole; a null path belongs to the root
directory; of several licence files in a directory the licence of the greatest similarity, then the first name, counts;
repeated rows are scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notegraph.llm.common import cut, salt, slim

LEAST, FILE_LEAST, PART_LEAST, SALT_ROWS = 0.6, 0.9, 0.88, 1 << 17
PART_TERMS, FEW_TERMS = 80, 30
#: Public licence texts, word for word as their publishers ask.
FOLDER = os.path.join(os.path.dirname(__file__), "licence_texts")
#: The most characters that the whole texts may have together.
TEXTS = 8 << 20
CUE = r"(?i)licen[cs]e|copyright|rights reserved|public domain|spdx|copying"
#: Words that pieces of a licence text have where they have no cue.
TEXT_CUE = r"(?i)warrant(?:y|ies)\b|redistribut|merchantab"
FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
#: One-line headers; below, the notices of the GNU licences by version and the identifiers of SPDX are added by rule.
TEMPLATES = (
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software under the MIT license"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-clause license"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "Copyright. All rights reserved. No part may be reproduced without permission"),
)
#: Licences with a notice of their own: name, what stands before "General Public License", version.
GNU = (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"))
_NOTICE = "you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version"
_IDENTIFIED = sorted({name for name, _ in TEMPLATES if name != "Proprietary"} | {name for name, _, _ in GNU} | {"BSD-2-Clause", "ISC", "Zlib"})
TEMPLATES += (
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file"),
    *((name, _NOTICE.format(kind, version)) for name, kind, version in GNU),
    *((name, f"SPDX-License-Identifier: {name}") for name in _IDENTIFIED),
)
_PERMIT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_KEEP = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
the documentation and/or other materials provided with the distribution."""
_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
_DISCLAIM = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole licence texts, public wording.
TEXT_TEMPLATES = (
    ("MIT", """MIT License. Copyright (c). Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", f"Copyright (c). All rights reserved. {_PERMIT} {_KEEP} {_DISCLAIM}"),
    ("BSD-3-Clause", f"Copyright (c). All rights reserved. {_PERMIT} {_KEEP} {_NAMES} {_DISCLAIM}"),
    ("ISC", """Copyright (c). Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """Copyright (c). This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not
be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must
not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
)
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"


def terms(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0))


def template_terms() -> list[tuple[str, Counter]]:
    return [(name, Counter(re.findall(TERM, text.lower()))) for name, text in TEMPLATES]


def text_templates(folder: str | None = FOLDER) -> list[tuple[str, Counter]]:
    """Name and term counts of the whole texts. Numbers in file names become versions (GPL-3: GPL-3.0)."""
    texts = list(TEXT_TEMPLATES)
    for file in sorted(os.listdir(folder)) if folder else ():
        path = os.path.join(folder, file)
        if os.path.isfile(path) and not os.path.islink(path):
            name = f"{file}-3-Clause" if file == "BSD" else re.sub(r"-(\d)$", r"-\1.0", file)
            with open(path, encoding="utf-8", errors="replace") as f:
                texts.append((name, f.read(TEXTS + 1)))
    if sum(len(t) for _, t in texts) > TEXTS:
        raise ValueError(f"the licence texts have over {TEXTS} characters")
    return [(name, Counter(re.findall(TERM, text.lower()))) for name, text in texts]


def passages(docs: DataFrame) -> DataFrame:
    """``row_id, doc_id, path, n_words, lines`` (the lines with a cue: text, prev, next), ``text`` (where there is a cue); written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cued = text.rlike(CUE)
    rows = slim(docs, "doc_id", "path", "text").select(
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        F.coalesce("path", F.lit("")).alias("path"),
        F.when(cued | text.rlike(TEXT_CUE), text).alias("text"),
        F.when(cued, F.split(text, "\n")).otherwise(F.array().cast("array<string>")).alias("parts"),
    )
    parts = F.col("parts")
    # shifted copies beside each other, so that no line looks its neighbours up; the entry behind the last line has no text
    beside = F.arrays_zip(parts.alias("text"), F.concat(F.array(F.lit("")), parts).alias("prev"), F.slice(parts, 2, F.size(parts)).alias("next"))
    rows = rows.select(
        "row_id", "doc_id", "path", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).alias("n_words"),
        F.filter(beside, lambda x: x["text"].rlike(CUE)).alias("lines"), "text",
    )
    return cut(rows, "passages")


# cosine -----------------------------------------------------------------------------------------------------------------


def best_match(rows: DataFrame, keys: list[str], templates: list[tuple[str, Counter]], least: float, parts: bool = False) -> DataFrame:
    """``keys, license, score, rank``: the template nearest to each text of ``rows(keys, text)``, where the cosine is ``least`` or
    more. With ``parts`` also ``part``, a struct of score, rank, license and shared (terms): the nearest template on the text's
    own terms; then rows stay where either is near enough, the first three null where only ``part`` is.

    Terms weigh (1 + ln tf) * idf, idf counted over ``rows``. A row of words and counts per text is all that is shuffled, so
    one very long text is no task's burden.
    """
    spark = rows.sparkSession
    words = rows.select(*keys, F.explode(terms(F.col("text"))).alias("term"))
    words = cut(words.groupBy(*keys, "term").agg((1 + F.log(F.count("*"))).alias("tf")), "license-terms")
    n = rows.count()
    known = sorted({t for _, c in templates for t in c})
    table = json.dumps([{"term": t, "n": [c[t] for _, c in templates]} for t in known])
    counts = F.from_json(F.lit(table), "array<struct<term:string,n:array<int>>>")
    counts = cut(spark.range(1).select(F.explode(counts).alias("x")).select("x.term", "x.n"), "license-templates")
    # the templates' terms have a bound (TEXTS), so they may be sent to every task
    seen = words.join(F.broadcast(counts.select("term")), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((1.0 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1
    vector = F.transform("n", lambda k: F.when(k > 0, (1 + F.log(k)) * F.col("idf")).otherwise(0.0))
    table = cut(counts.join(seen, "term", "left").withColumn("idf", idf).select("term", "idf", vector.alias("v")), "license-vectors")
    at = lambda k: F.get("v", F.lit(k))
    norms = table.agg(*[F.sqrt(F.sum(at(k) * at(k))) for k in range(len(templates))]).first()
    rare = math.log((1 + n) / 2) + 1 if n else 1.0
    met = words.join(F.broadcast(table), "term", "left").withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(rare)))
    dots = [F.sum(F.col("x") * at(k)).alias(f"dot{k}") for k in range(len(templates))]
    if parts:
        dots += [F.sum(at(k) * at(k)).alias(f"vv{k}") for k in range(len(templates))]
        dots += [F.count_if(at(k) > 0).alias(f"n{k}") for k in range(len(templates))]
    sums = met.groupBy(*keys).agg(F.sum(F.col("x") * F.col("x")).alias("xx"), *dots)
    cosines = [
        F.struct((F.coalesce(f"dot{k}", F.lit(0.0)) / (F.sqrt("xx") * norms[k])).alias("score"), F.lit(-k).alias("rank"), F.lit(name).alias("license"))
        for k, (name, _) in enumerate(templates)
    ]
    if not parts:
        best = sums.select(*keys, F.array_max(F.array(*cosines)).alias("b")).where(F.col("b.score") >= least)
        return best.select(*keys, "b.license", "b.score", "b.rank")
    pieces = [
        F.when(
            F.col(f"n{k}") >= FEW_TERMS,
            F.struct((F.col(f"dot{k}") / F.sqrt(F.col("xx") * F.col(f"vv{k}"))).alias("score"), F.lit(-k).alias("rank"), F.lit(name).alias("license"), F.col(f"n{k}").alias("shared")),
        )
        for k, (name, _) in enumerate(templates)
    ]
    best = sums.select(*keys, F.array_max(F.array(*cosines)).alias("b"), F.array_max(F.array(*pieces)).alias("p"))
    whole, part = F.col("b.score") >= least, F.col("p.score") >= PART_LEAST
    best = best.where(whole | part)
    return best.select(*keys, *[F.when(whole, F.col(f"b.{c}")).alias(c) for c in ("license", "score", "rank")], F.when(part, F.col("p")).alias("part"))


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def scan(docs: DataFrame, least: float = LEAST, folder: str | None = FOLDER) -> DataFrame:
    """``doc_id, path, license, score, declared, inherited_from`` for every row of (doc_id, path, text)."""
    found = passages(docs)
    lined = found.where(F.size("lines") > 0).select("row_id", F.posexplode("lines").alias("line_no", "x")).select("row_id", "line_no", "x.*")
    wide = F.concat_ws("\n", F.col("prev"), F.col("text"), F.col("next"))
    ways = F.when((F.coalesce("prev", F.lit("")) == "") & (F.coalesce("next", F.lit("")) == ""), F.array("text")).otherwise(F.array(F.col("text"), wide))
    near = best_match(lined.select("row_id", "line_no", F.posexplode(ways).alias("way", "text")), ["row_id", "line_no", "way"], template_terms(), least)
    near = near.groupBy("row_id", "line_no").agg(F.max(F.struct("score", "rank", "license")).alias("best"))
    lined = lined.join(near, ["row_id", "line_no"])
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    real = F.col("best.license") != "Proprietary"
    own = lined.groupBy("row_id").agg(
        F.max(F.when(real, F.col("best"))).alias("named"), F.max("best").alias("any"), F.count_distinct(F.when(real, F.col("best.license"))).alias("names"), F.sum(words).alias("words")
    )
    own = own.where("names < 3").select("row_id", "named", "any", "words")
    whole = best_match(found.where("text IS NOT NULL").select("row_id", "text"), ["row_id"], text_templates(folder), FILE_LEAST, parts=True)
    long = F.when(F.col("part.shared") >= PART_TERMS, F.col("part"))
    whole = whole.select(
        "row_id", F.coalesce("license", long["license"]).alias("text_license"), F.coalesce("score", long["score"]).alias("text_score"),
        F.col("part.license").alias("part_license"), F.col("part.score").alias("part_score"),
    )
    rows = found.select("row_id", "doc_id", "path", "n_words").join(own, "row_id", "left").join(whole, "row_id", "left")
    rows = rows.select(
        "row_id", "doc_id", "path", parent(F.col("path")).alias("dir"), "n_words", "words",
        *[F.coalesce(f"text_{c}", f"named.{c}", f"part_{c}", f"any.{c}").alias(c) for c in ("score", "license")],
        (F.col("text_license").isNotNull() | (F.col("named").isNull() & F.col("part_license").isNotNull())).alias("is_text"),
    )
    rows = cut(rows, "declared")

    is_file = F.col("license").isNotNull() & (F.col("is_text") | F.col("path").rlike(FILE) | (2 * F.col("words") >= F.col("n_words")))
    # first name wins ties: max_by takes the largest key, so compare by the hex of the path with digits turned round
    back = F.translate(F.hex("path"), "0123456789ABCDEF", "FEDCBA9876543210")
    files = rows.where(is_file).withColumn("back", F.concat(back, F.lit("~"))).groupBy("dir").agg(F.max_by("license", F.struct("score", F.col("back"))).alias("dir_license"), F.max("score").alias("dir_score"))
    dirs = rows.groupBy("dir").agg(F.count("*").alias("n"))
    parts = F.split(F.col("dir"), "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    above = dirs.select("dir", F.explode(F.array_distinct(up)).alias("ancestor"))
    files = files.withColumnRenamed("dir", "ancestor")
    nearest = above.join(files, "ancestor").groupBy("dir").agg(F.max_by(F.struct("dir_license", "dir_score", "ancestor"), F.char_length("ancestor")).alias("from"))
    salted = rows.withColumn("salt", salt(F.col("row_id"), max(8, rows.count() // SALT_ROWS)))
    spread = salted.where("license IS NULL").groupBy("dir", "salt").agg(F.count("*").alias("n")).drop("n").join(nearest, "dir")
    out = salted.join(spread, ["dir", "salt"], "left")
    declared = F.col("license").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", F.col("from.dir_license")).alias("license"),
        F.round(F.coalesce("score", F.col("from.dir_score")), 6).alias("score"),
        declared.alias("declared"),
        F.when(~declared, F.col("from.ancestor")).alias("inherited_from"),
    )


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents have no paths; theirs are source / hundreds of the id / id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 100).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return scan(slim(docs, "doc_id", "source", "text").withColumn("path", path))

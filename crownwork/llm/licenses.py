"""License scans, by DataFrame functions only.

Texts are compared to license templates by the Dice coefficient over sets of word bigrams:
2 * common / (bigrams of the text + bigrams of the template). Normal form: lower case, other characters than letters
and digits become spaces. Of a document, the whole text is compared, each line, and runs of words, so that a notice is
found that is wrapped over lines, or in the middle of a paragraph: for each bigram of the template that the document
holds, the runs that begin there, of lengths that grow by a tenth.

A coefficient of at least t needs bigram counts n and m with n <= m * (2 - t) / t and n >= m * t / (2 - t), and so at least
m * t / (2 - t) common ones. So each document is first searched for words of which each fitting text has one, then for
enough bigrams of some template; only what has them is compared, with that template alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices that authors of works are asked to use, and short licenses, by the identifiers in general use.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("BSD-2-Clause", _BSD + " " + _BSD_END),
    ("BSD-3-Clause", _BSD + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
]

#: Words that most English texts have: of little use to find fitting texts by.
COMMON = frozenset("a an and any are as at be by can file for from if in is it may not of on or other that the this to under use with work you your".split())


def template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def needed(m: int, least: float) -> int:
    """How many of a template's m bigrams a fitting text has."""
    return max(math.ceil(m * least / (2 - least) - 1e-9), 1)


def spans(text: str, least: float) -> list[int]:
    """The lengths of runs, in bigrams, that are compared with a template: its own, and others, each a tenth longer."""
    m = len(bigrams_of(text))
    out, most = [needed(m, least)], max(math.floor(m * (2 - least) / least + 1e-9), 1)
    while out[-1] < most:
        out.append(min(max(out[-1] + 1, math.ceil(out[-1] * 1.1)), most))
    return sorted({*out, len(template_words(text)) - 1})


def telling_words(grams: list[str], least: float) -> set[str]:
    """Words of which each text has one that has enough of the bigrams: one word each of so many bigrams that no fitting
    text lacks them all."""
    best = lambda g: max(g.split(), key=lambda w: (w not in COMMON, len(w), w))
    ranked = sorted(grams, key=lambda g: (best(g) in COMMON, -len(best(g)), g))
    return {best(g) for g in ranked[: len(grams) - needed(len(grams), least) + 1]}


def words_of(text: Column) -> Column:
    """The words of a text in normal form; one empty word if there is none."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")


def pairs_of(words: Column) -> Column:
    """Each word with the next one."""
    return F.filter(F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())


def with_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for a row: filters on it aren't moved below it, where they'd compute it anew."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def scanned(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license, line, dice: the best part for each license of a document of docs(doc_id, text) whose coefficient
    is at least ``least``. line: 0 for the whole text, else the line (from 1), or that in which the run begins; of equally
    good parts the least line.

    Null and empty texts, and those of one word, have no bigrams and match nothing. Rows that repeat a doc_id are
    scanned as one document: a license's best part of any of them. Templates without a bigram are left out."""
    known = [(name, grams, spans(text, least)) for name, text in (TEMPLATES if templates is None else templates) if (grams := bigrams_of(text))]
    if not known:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, license string, line int, dice double")
    texts = lambda values: F.array(*[F.lit(v) for v in values])
    every, telling = texts(sorted({g for _, grams, _ in known for g in grams})), texts(sorted({w for _, grams, _ in known for w in telling_words(grams, least)}))
    own = docs.where("text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    worded = with_once(own, "words", words_of(F.col("text"))).where(F.arrays_overlap("words", telling))
    cut = with_once(with_once(worded, "grams", pairs_of(F.col("words"))).drop("words"), "held", F.array_intersect("grams", every))
    enough = [F.when(F.size(F.array_intersect("held", texts(grams))) >= needed(len(grams), least), F.lit(k)) for k, (_, grams, _) in enumerate(known)]
    fitting = cut.select("doc_id", "text", "grams", F.explode(F.array(*enough)).alias("k")).where("k is not null")
    of = F.array(*[F.struct(F.lit(name).alias("license"), texts(grams).alias("grams"), F.lit(needed(len(grams), least)).alias("need"), F.array(*[F.lit(n) for n in lengths]).alias("spans")) for name, grams, lengths in known])
    both = fitting.select("doc_id", "text", "grams", of[F.col("k")].alias("t"))
    m, reach = F.size("t.grams"), (2 - least) / least

    def dice(grams: Column) -> Column:
        n = F.size(F.array_distinct(grams))
        value = 2.0 * F.size(F.array_intersect(grams, F.col("t.grams"))) / (n + m)
        return F.when((n <= m * reach + 1e-9) & (n >= m / reach - 1e-9), value).otherwise(0.0)

    starts = F.filter(F.sequence(F.lit(1), F.size("grams")), lambda i: F.array_contains("t.grams", F.element_at("grams", i)))
    dense = lambda a, i: F.when(F.get("starts", i + F.col("t.need") - 1) < a + F.array_max("t.spans"), a)
    runs = F.transform(F.array_compact(F.transform("starts", dense)), lambda a: F.array_max(F.transform("t.spans", lambda n: F.struct(dice(F.slice("grams", a, n)).alias("dice"), (-a).alias("at")))))
    lines = F.transform(F.split("text", "\n"), lambda part, i: F.struct(dice(pairs_of(words_of(part))).alias("dice"), (-i - 1).alias("at")))
    found = with_once(with_once(both, "starts", starts), "run", F.array_max(runs)).withColumns({"line": F.array_max(lines), "whole": dice(F.col("grams"))}).drop("grams", "starts")
    counts = F.transform(F.split("text", "\n"), lambda part: F.size(F.filter(words_of(part), lambda w: w != "")))
    step = lambda a, n: F.when(a["seen"] + n < -F.col("run.at"), F.struct((a["seen"] + n).alias("seen"), (a["line"] + 1).alias("line"))).otherwise(a)
    at = F.aggregate(counts, F.struct(F.lit(0).alias("seen"), F.lit(1).alias("line")), step)["line"]
    part = lambda value, line: F.struct(F.coalesce(value, F.lit(0.0)).alias("dice"), line.alias("line"))
    parts = F.array(part("whole", F.lit(0)), part("line.dice", F.col("line.at")), part("run.dice", -at))
    hits = with_once(found.select("doc_id", F.col("t.license").alias("license"), "text", "run", "line", "whole"), "hit", F.array_max(parts)).select("doc_id", "license", "hit").where(F.col("hit.dice") >= least)
    best = hits.groupBy("doc_id", "license").agg(F.max("hit").alias("b"))
    return best.select("doc_id", "license", (-F.col("b.line")).alias("line"), F.round("b.dice", 6).alias("dice"))


def oracle_sql(least: float = 0.8) -> str:
    """DuckDB SQL for scanned() over documents."""
    known = [(name, bigrams_of(text), spans(text, least)) for name, text in TEMPLATES]
    rows = ", ".join(f"('{name}', [" + ", ".join(f"'{g}'" for g in grams) + f"], {needed(len(grams), least)}, {lengths}, {len(grams)})" for name, grams, lengths in known)
    words = lambda text: f"list_filter(string_split(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
    pairs = lambda w: f"list_transform(range(1, len({w})), lambda k: {w}[k] || ' ' || {w}[k + 1])"
    return f"""
    WITH templates(license, grams, need, spans, m) AS (VALUES {rows}),
    docs AS (SELECT row_number() OVER () AS r, doc_id, text, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
    cut AS (SELECT r, doc_id, text, {pairs('w')} AS g FROM docs WHERE len(w) > 1),
    cand AS (
      SELECT r, doc_id, text, g, license, grams, need, spans, m, list_filter(range(1, len(g) + 1), lambda i: list_contains(grams, g[i])) AS starts
      FROM cut, templates WHERE len(list_intersect(list_distinct(g), grams)) >= need),
    lines AS (SELECT r, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS part FROM (SELECT r, string_split(text, chr(10)) AS parts FROM docs WHERE r IN (SELECT r FROM cand))),
    cut_lines AS (SELECT r, line, {words('part')} AS w FROM lines),
    ends AS (SELECT r, line, sum(len(w)) OVER (PARTITION BY r ORDER BY line) AS until FROM cut_lines),
    runs AS (SELECT r, doc_id, license, grams, m, g, a, unnest(spans) AS n FROM (
      SELECT *, starts[i] AS a FROM (SELECT *, unnest(range(1, len(starts) + 1)) AS i FROM cand) WHERE starts[i + need - 1] < starts[i] + list_max(spans))),
    parts AS (
      SELECT r, doc_id, license, grams, m, list_distinct(g) AS part, 0 AS line, 0 AS a FROM cand
      UNION ALL SELECT r, doc_id, license, grams, m, list_distinct({pairs('w')}), line, 0 FROM cand JOIN cut_lines USING(r) WHERE len(w) > 1
      UNION ALL SELECT r, doc_id, license, grams, m, list_distinct(g[a:a + n - 1]), NULL, a FROM runs),
    rated AS (SELECT r, doc_id, license, line, a, 2.0 * len(list_intersect(part, grams)) / (len(part) + m) AS dice FROM parts),
    good AS (SELECT r, doc_id, license, dice, coalesce(line, (SELECT min(e.line) FROM ends e WHERE e.r = rated.r AND e.until >= rated.a)) AS line FROM rated WHERE dice >= {least}),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY dice DESC, line) AS k FROM good)
    SELECT doc_id, license, CAST(line AS INTEGER) AS line, round(CAST(dice AS DOUBLE), 6) AS dice FROM best WHERE k = 1
    """

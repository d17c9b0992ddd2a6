"""Licence scans by Dice coefficient over word bigrams, in DataFrame functions only.

Units are each line of a text, the text as a whole, and runs of lines of up to as many words as the largest
template allows, so a notice that is broken into lines is found in a longer text. Of runs that overlap, each other or
a line, only the best of a licence is reported (then the line, then the first and shortest run); the text as a whole
stands for a run that is no better. A unit is normalised to words (A-Z as a-z,
everything but letters, digits and non-ASCII as a blank), its set of distinct word bigrams includes
one from the start and one to the end, and is compared with that of each licence template. Dice is
2 * shared / (unit + template); a unit matches at ``percent`` or more. Sizes alone bound Dice, so a
unit is only compared with templates of fitting size, and units that fit none are dropped before
any bigram is looked up. A match also shares so many bigrams that one of a few ``anchors`` of the template is
among them, whichever these are: texts without any anchor are not cut into units at all. A run begins and ends with
lines that share a bigram with a template, as without others it would match better.

The templates are a list given by the caller, so the table of their bigrams is as small as the list; at
most ``MOST_BIGRAMS`` are broadcast. A null or wordless text matches nothing. Texts are compared once
each, so repeated rows agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowwatch.llm.tables import fresh, held, lower_ascii, text_key
from flowwatch.session import materialize

MOST_BIGRAMS = 200_000
PERCENT = 80

#: Notices of public licences.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("mit", "Released under the MIT License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("mit-text", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("isc-text", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
]


def _words(text: Column) -> Column:
    """Words of a lower-case text, between a mark for its start and one for its end."""
    plain = F.btrim(F.regexp_replace(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(plain != "", F.split(F.concat(F.lit("^ "), plain, F.lit(" $")), " ")).otherwise(F.array().cast("array<string>"))


def _bigrams(words: str) -> Column:
    return F.expr(f"if(size({words}) < 2, array(), array_distinct(transform(sequence(0, size({words}) - 2), i -> xxhash64({words}[i], {words}[i + 1]))))")


def _may_match(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can reach the Dice coefficient at all."""
    return F.least(a, b) * 200 >= (a + b) * percent


def scan(docs: DataFrame, templates: list[tuple[str, str]], text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per distinct text, unit and template that match.

    text_key, unit (number of the line from 0, or of a run's first line, -1 for the whole text), last (number of
    the last line, -1 for the whole text), licence, shared and total: the Dice coefficient is 2 * shared / total.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(templates, "licence string, body string").select("licence", _words(lower_ascii(F.col("body"))).alias("w"))
    known = held(known, "grams", _bigrams("w")).select("licence", "w", "grams", F.size("grams").alias("b")).where("b > 0")
    # Long bigrams first: they are rare. Those with a mark of start or end come last.
    rare = F.expr("array_sort(array_distinct(transform(sequence(0, size(w) - 2), i -> struct(i = 0 or i = size(w) - 2 as edge, -length(w[i]) - length(w[i + 1]) as len, xxhash64(w[i], w[i + 1]) as gram))))")
    rows = known.select("b", "grams", rare.alias("rare")).collect()
    sizes = sorted({r.b for r in rows})
    if sum(r.b for r in rows) > MOST_BIGRAMS:
        raise ValueError(f"the templates hold over {MOST_BIGRAMS} bigrams, too many to broadcast")
    # Of b bigrams percent * b / (200 - percent) are shared at least, so of any more than the others one is.
    anchors = {(g.gram, g.edge) for r in rows for g in r.rare[: r.b - -(-r.b * percent // (200 - percent)) + 1]}
    longs = lambda values: F.array(*(F.lit(x) for x in sorted(values))).cast("array<bigint>")
    table = F.broadcast(known.select("licence", "b", F.explode("grams").alias("gram")))

    texts = docs.where(F.col(text).isNotNull()).select(text_key(F.col(text)).alias("text_key"), lower_ascii(F.col(text)).alias("t"))
    if not any(edge for _, edge in anchors):
        texts = held(texts, "w", _words(F.col("t"))).select("text_key", "t", _bigrams("w").alias("g")).where(F.arrays_overlap("g", longs(g for g, _ in anchors))).drop("g")
    # Written once; copies of a text count once.
    texts = materialize(texts.distinct(), "licence-texts")
    most = max(sizes, default=0) * (200 - percent) // percent
    lines = texts.select("text_key", F.posexplode(F.split("t", "\n", -1)).alias("unit", "body")).withColumn("last", F.col("unit"))
    whole = texts.where(F.instr("t", "\n") > 0).select("text_key", F.lit(-1).alias("unit"), F.col("t").alias("body"), F.lit(-1).alias("last"))
    units = held(lines.unionAll(whole), "w", _words(F.col("body"))).select("text_key", "unit", "last", "w").unionAll(_runs(texts, longs({g for r in rows for g in r.grams}), most))
    # A unit of d distinct words has d - 1 distinct bigrams at least, so words alone rule most units out.
    units = units.where(F.size("w") * (200 - percent) >= min(sizes, default=0) * percent)
    units = units.where(F.size(F.array_distinct("w")) <= most + 1)
    fits = F.lit(False)
    for b in sizes:
        fits = fits | _may_match(F.col("a"), F.lit(b), percent)
    units = held(units, "grams", _bigrams("w")).where(F.arrays_overlap("grams", longs({g for g, _ in anchors})))
    units = units.select("text_key", "unit", "last", "grams", F.size("grams").alias("a")).where(fits)
    met = units.select("text_key", "unit", "last", "a", F.explode("grams").alias("gram")).join(table, "gram").where(_may_match(F.col("a"), F.col("b"), percent))
    shared = met.groupBy("text_key", "unit", "last", "a", "licence", "b").agg(F.count(F.lit(1)).alias("shared"))
    found = shared.withColumn("total", F.col("a") + F.col("b")).where(F.col("shared") * 200 >= F.col("total") * percent)
    # Of each text and licence: the runs that overlap nothing better.
    ranked = F.struct((-F.col("shared") / F.col("total")).alias("d"), (F.col("last") > F.col("unit")).alias("run"), F.col("unit"), F.col("last"), F.col("shared"), F.col("total"))
    by_licence = found.groupBy("text_key", "licence").agg(F.sort_array(F.collect_list(ranked)).alias("m"))
    best = F.expr("filter(m, x -> not x.run or not exists(m, y -> y < x and (y.unit < 0 or (y.unit <= x.last and y.last >= x.unit))))")
    return by_licence.select("text_key", "licence", F.explode(best).alias("x")).select("text_key", "x.unit", "x.last", "licence", "x.shared", "x.total")


def _runs(texts: DataFrame, grams: Column, most: int) -> DataFrame:
    """text_key, unit, last and words of runs of two to many lines that may match, of ``most`` words at most."""
    lines = F.transform(F.split("t", "\n", -1), lambda x: _words(x))
    # The words of each line that has any, with its number; then whether a run may begin and end there.
    numbered = F.expr("filter(transform(l, (x, i) -> struct(i as i, slice(x, 2, greatest(size(x) - 2, 0)) as w)), x -> size(x.w) > 0)")
    rows = held(held(texts.select("text_key", lines.alias("l")), "n", numbered).drop("l"), "known", grams)
    pairs = "exists(sequence(0, size({0}) - 2), k -> array_contains(known, xxhash64({0}[k], {0}[k + 1])))"
    begins = "filter(sequence(0, size(n) - 2), i -> " + pairs.format("concat(array('^'), n[i].w, array(n[i + 1].w[0]))") + ")"
    ends = "filter(sequence(1, size(n) - 1), i -> " + pairs.format("concat(array(element_at(n[i - 1].w, -1)), n[i].w, array('$'))") + ")"
    rows = rows.where("size(n) > 1")
    rows = held(held(rows, "begins", F.expr(begins)), "ends", F.expr(ends))
    # Words up to each line, so that a run's words are a difference.
    rows = held(rows, "upto", F.expr("aggregate(n, array(0), (a, x) -> concat(a, array(element_at(a, -1) + size(x.w))))")).drop("known")
    runs = rows.select("text_key", "n", "upto", "ends", F.explode("begins").alias("i"))
    runs = runs.select("text_key", "n", "i", F.explode(F.expr(f"filter(ends, j -> j > i and upto[j + 1] - upto[i] <= {most})")).alias("j"))
    words = F.expr("concat(array('^'), flatten(transform(slice(n, i + 1, j - i + 1), x -> x.w)), array('$'))")
    return runs.select("text_key", F.expr("n[i].i").alias("unit"), F.expr("n[j].i").alias("last"), words.alias("w"))


def label(docs: DataFrame, templates: list[tuple[str, str]], text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents with a struct ``licences``: matches (unit, licence, dice), names and best, or empty and null.

    The best match has the highest Dice, then the first name. A column of that name is replaced.
    """
    k, found = fresh(docs, "_key", "_found")
    hits = materialize(scan(docs, templates, text, percent), "licences").withColumn("dice", F.col("shared") * 2 / F.col("total"))
    by_text = hits.groupBy("text_key").agg(
        F.sort_array(F.collect_list(F.struct("unit", "licence", "dice"))).alias("matches"),
        F.sort_array(F.collect_set("licence")).alias("names"),
        F.min(F.struct((-F.col("dice")).alias("d"), "licence")).alias("first"),
    )
    # Written, so that the join with many copies of one text can be split.
    by_text = materialize(by_text, "licences-by-text").select(F.col("text_key").alias(k), F.struct("matches", "names", F.struct(F.col("first.licence").alias("licence"), (-F.col("first.d")).alias("dice")).alias("best")).alias(found))
    none = F.array()
    result = F.struct(
        F.coalesce(F.col(f"{found}.matches"), none.cast("array<struct<unit:int,licence:string,dice:double>>")).alias("matches"),
        F.coalesce(F.col(f"{found}.names"), none.cast("array<string>")).alias("names"),
        F.col(f"{found}.best").alias("best"),
    )
    return docs.withColumn(k, text_key(F.col(text))).join(by_text, k, "left").withColumn("licences", result).drop(k, found)

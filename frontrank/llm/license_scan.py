"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams, DataFrames only.

A unit is a whole text, one of its lines, or a passage: a run of words of the whole text, line ends being blanks, so that
a notice which wraps over lines or stands inside a longer line is compared as such. Units and templates are lower-cased, everything but letters and digits
becomes a blank, and the distinct pairs of neighbouring words are their bigrams. Dice = 2 * shared / (a + b) can only
reach DICE if the smaller number of bigrams is at least DICE / (2 - DICE) of the larger; a unit's number of words bounds
its bigrams, so most units are dropped before any bigram is made, and the others meet only templates within the bound.

Templates are few (checked) and written into the plan; documents are not shuffled. Of several templates that reach DICE
the best is reported, then the first by name.

Passages: taking a bigram that is not the template's from either end of a passage never lowers its Dice, so only those
from one of the template's bigrams to another are compared, up to 1 / ratio of the template's size. Such a passage can
only reach DICE if it holds at least `ratio` of the template's bigrams, so starts with fewer of them close by are
dropped by places alone. Of overlapping passages the best is reported, under the line that it starts in; a passage that
overlaps a matching line or text of the same licence, or one that matches as well, is not reported again. Passages are
also compared with the whole licence texts in TEXTS.

Null and empty texts have no unit. A text of one line is reported once, as line 0. Repeated rows give repeated rows.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frontrank.llm.common import read

DICE, MOST = 0.8, 200

# The notices by which texts declare these licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

# Whole licences, for passages only.
TEXTS = {
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
}


def normalised(text: Column) -> Column:
    """Lower-case words with one blank between; line ends stay."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def words_of(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(unit, r"\s+", " ")), " ")


def bigrams_of(words: Column) -> Column:
    """words: a column, not an expression, which would be evaluated for each word."""
    pairs = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
    return F.array_distinct(F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def plain_bigrams(text: str) -> list[str]:
    """As bigrams_of, for the templates (ASCII)."""
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def key_words(bigrams: list[str], ratio: float) -> set[str]:
    """Words, long ones first, of which any text that reaches DICE must hold one.

    Such a text shares at least `ratio` of the template's bigrams, so any set of bigrams larger than the rest of them
    has one that it shares.
    """
    words, covered = set(), set()
    for word in sorted({w for b in bigrams for w in b.split()}, key=lambda w: (-len(w), w)):
        if len(covered) > (1 - ratio) * len(bigrams) + 1e-9:
            break
        words.add(word)
        covered |= {b for b in bigrams if word in b.split()}
    return words


def against(b: Column, order: int, name: str, own: list[str], ratio: float) -> Column:
    """(dice, order, license) of distinct bigrams and one template; null beyond the size bound."""
    size = F.size(b)
    near = (size >= ratio * len(own) - 1e-9) & (size <= len(own) / ratio + 1e-9)
    value = 2.0 * F.size(F.array_intersect(b, F.array(*map(F.lit, own)))) / (size + len(own))
    return F.when(near, F.struct(value.alias("dice"), F.lit(-order).alias("order"), F.lit(name).alias("license")))


def passages(text: DataFrame, known: list[tuple[str, list[str]]], units: list[tuple[str, list[str]]], dice: float) -> DataFrame:
    """doc_id, line, license, dice of the passages of t that match one of `known` and that no unit reports already."""
    ratio = dice / (2 - dice)
    bound = lambda x, body: F.get(F.transform(F.array(x), body), 0)  # noqa: E731  (evaluates x once)
    split = text.select("doc_id", "t", F.explode(F.array(words_of(F.col("t")))).alias("w"))
    every = sorted({b for _, own in known for b in own})
    joined = F.transform("w", lambda w, i: F.struct(i.alias("at"), F.concat_ws(" ", w, F.get("w", i + 1)).alias("b")))
    hits = split.select("doc_id", "t", "w", F.explode(F.array(F.filter(joined, lambda x: x["b"].isin(every)))).alias("h"))
    fewest = min(-int(-(ratio * len(own) - 1e-9) // 1) for _, own in known)
    hits = hits.filter(F.size("h") >= max(1, fewest))

    none = F.array().cast("array<struct<dice:double,order:int,back:int,end:int,license:string>>")
    apart = lambda x, y: (-x["back"] > y["end"]) | (-y["back"] > x["end"])

    def best_apart(all_of: Column) -> Column:
        """The best ones that don't overlap a better one."""
        return F.aggregate(F.reverse(F.array_sort(all_of)), none, lambda acc, x: F.when(F.forall(acc, lambda y: apart(x, y)), F.concat(acc, F.array(x))).otherwise(acc))

    def found(order: int, name: str, own: list[str]) -> Column:
        """The best passages of one template: (dice, order, start, end, license)."""
        least, most, mine = max(1, -int(-(ratio * len(own) - 1e-9) // 1)), int(len(own) / ratio + 1e-9), F.array(*map(F.lit, own))

        def from_start(h: Column, j: Column) -> Column:
            start = F.get(h, j)["at"]
            ends = F.filter(F.slice(h, j + least, F.lit(most)), lambda e: e["at"] - start < most)

            def to_end(e: Column) -> Column:
                words = F.slice(F.col("w"), start + 1, e["at"] - start + 2)
                return bound(words, lambda ws: bound(bigrams_of(ws), lambda b: F.struct((2.0 * F.size(F.array_intersect(b, mine)) / (F.size(b) + len(own))).alias("dice"), F.lit(-order).alias("order"), (-start).alias("back"), (e["at"] + 1).alias("end"), F.lit(name).alias("license"))))

            return F.array_max(F.transform(ends, to_end))

        def starts(h: Column) -> Column:
            last = F.size(h) - least
            near = F.filter(F.sequence(F.lit(0), last), lambda j: F.get(h, j + least - 1)["at"] - F.get(h, j)["at"] < most)
            return F.when(last >= 0, F.filter(F.transform(near, lambda j: from_start(h, j)), lambda x: x["dice"] >= dice))

        return F.coalesce(bound(bound(F.filter("h", lambda x: x["b"].isin(own)), starts), best_apart), none)

    some = hits.select("doc_id", "t", F.explode(F.array(F.concat(*(found(i, name, own) for i, (name, own) in enumerate(known))))).alias("x")).filter(F.size("x") > 0)
    lines = some.select("doc_id", "t", F.split("t", "\n").alias("ls"), F.explode(best_apart(F.col("x"))).alias("x"))
    sizes = F.transform("ls", lambda line: F.when(F.trim(line) == "", 0).otherwise(F.size(words_of(line))))
    sized = lines.select("doc_id", "t", "ls", "x", F.explode(F.array(sizes)).alias("n"))

    def line_of(place: Column) -> Column:
        """Lines that end at or before this word."""
        zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("line"))
        return F.aggregate("n", zero, lambda acc, n: F.struct((acc["sum"] + n).alias("sum"), (acc["line"] + F.when(acc["sum"] + n <= place, 1).otherwise(0)).alias("line")))["line"]

    placed = sized.select("doc_id", "t", "ls", "x", line_of(-F.col("x.back")).alias("a"), line_of(F.col("x.end")).alias("z"))
    over = placed.select("doc_id", "x", "a", F.size("ls").alias("n"), F.concat(F.array("t"), F.slice("ls", F.col("a") + 1, F.col("z") - F.col("a") + 1)).alias("us"))

    def told(unit: Column) -> Column:
        best = lambda b: F.array_max(F.array(*(against(b, i, name, own, ratio) for i, (name, own) in enumerate(units))))
        return bound(words_of(unit), lambda w: bound(bigrams_of(w), lambda b: bound(best(b), lambda m: F.coalesce((m["dice"] >= dice) & ((m["license"] == F.col("x.license")) | (m["dice"] >= F.col("x.dice"))), F.lit(False)))))

    new = over.filter(~F.exists("us", told))
    return new.select("doc_id", F.when(F.col("n") > 1, F.col("a") + 1).otherwise(0).alias("line"), F.col("x.license").alias("license"), F.col("x.dice").alias("dice"))


def license_scan(docs: DataFrame, templates: dict[str, list[str]], dice: float = DICE, texts: dict[str, list[str]] = TEXTS) -> DataFrame:
    """doc_id, line (0: the whole text), license, dice for each unit that matches a template.

    A passage has the line that it starts in, or 0 in a text of one line. texts: whole licences, for passages only.
    """
    known = [(name, plain_bigrams(t)) for name, own in sorted(templates.items()) for t in own]
    whole_texts = [(name, plain_bigrams(t)) for name, own in sorted(texts.items()) for t in own]
    if len(known) + len(whole_texts) > MOST:
        raise ValueError(f"more than {MOST} templates")
    ratio = dice / (2 - dice)
    least, most = min(len(b) for _, b in known) * ratio, max(len(b) for _, b in known) / ratio
    keys = sorted(set().union(*(key_words(b, ratio) for _, b in known)))
    pattern = rf"\b(?:{'|'.join(keys)})\b"
    any_key = sorted(set(keys).union(*(key_words(b, ratio) for _, b in whole_texts)))
    text = docs.select("doc_id", F.explode(F.array(normalised(F.coalesce("text", F.lit(""))))).alias("t")).filter(F.col("t").rlike(rf"\b(?:{'|'.join(any_key)})\b"))
    whole = F.array(F.struct(F.lit(0).alias("line"), F.col("t").alias("unit")))
    lines = F.transform(F.split("t", "\n"), lambda line, i: F.struct((i + 1).alias("line"), line.alias("unit")))
    units = F.when(F.contains("t", F.lit("\n")), F.concat(whole, lines)).otherwise(whole)
    cut = text.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.line", "u.unit").filter(F.col("unit").rlike(pattern))
    words = cut.select("doc_id", "line", F.explode(F.array(words_of(F.col("unit")))).alias("w"))
    pairs = words.select("doc_id", "line", F.explode(F.array(bigrams_of(F.col("w")))).alias("b")).filter((F.size("b") >= least) & (F.size("b") <= most))
    best = F.array_max(F.array(*(against(F.col("b"), i, name, own, ratio) for i, (name, own) in enumerate(known))))
    out = pairs.select("doc_id", "line", F.explode(F.array(best)).alias("x"))
    out = out.select("doc_id", "line", F.col("x.license").alias("license"), F.col("x.dice").alias("dice")).filter(F.col("dice") >= dice)
    return out.unionByName(passages(text, known + whole_texts, known, dice))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"), TEMPLATES)


def oracle_sql(templates: dict[str, list[str]], dice: float = DICE) -> str:
    """The same in DuckDB's SQL, without the pruning."""
    listed = [(name, plain_bigrams(t)) for name, texts in sorted(templates.items()) for t in texts]
    rows = ", ".join(f"({i}, '{name}', [{', '.join(repr(b) for b in own)}])" for i, (name, own) in enumerate(listed))
    return f"""
WITH t(ord, license, bg) AS (VALUES {rows}),
units AS (SELECT doc_id, 0 AS line, coalesce(text, '') AS unit FROM documents UNION ALL
SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT, unnest(string_split(text, chr(10))) FROM documents WHERE contains(text, chr(10))),
words AS (SELECT doc_id, line, string_split(trim(regexp_replace(lower(unit), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
pairs AS (SELECT doc_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM words),
scores AS (SELECT doc_id, line, license, ord, 2.0 * len(list_intersect(b, bg)) / (len(b) + len(bg)) AS dice FROM pairs, t WHERE len(b) > 0)
SELECT doc_id, line, license, dice::DOUBLE AS dice FROM scores WHERE dice >= {dice}
QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY dice DESC, ord) = 1"""


ORACLE_SQL = oracle_sql(TEMPLATES)

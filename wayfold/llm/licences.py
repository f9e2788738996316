"""Licence scans: passages compared with licence templates by the Dice coefficient over word bigrams.

A passage is a line, a paragraph (lines up to a blank one), the whole text, or a window of as many bigrams as a template
has, placed so that one of the template's rarer bigrams lies where the template has it; so a notice within running text
is found, too. Both sides are normalised (lower case, runs of anything but letters and digits become one space) and taken
as sets of word bigrams, a single word as itself. Dice is twice the common bigrams over the sum of both sizes. It reaches
a threshold t only if the sizes' ratio lies between t / (2 - t) and its inverse, so a template is compared only with
passages of a fitting size. And it must share so many bigrams that of each template's rarer words one must occur: texts
and passages without any of these marker words are passed over before a bigram is made, which loses nothing.

Everything is a DataFrame expression on the row itself: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.rules import _let

THRESHOLD = 0.8

# Public licence statements, notices and whole licences, by SPDX identifier and kind; words that are in any
# text.
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
COMMON = frozenset("a all an and any are as at be by for from in is it may must no not of on or other shall that the this to under use used with without you".split())
TEMPLATES = {
    "Apache-2.0/statement": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause/statement": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause/statement": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0/statement": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0/statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/statement": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0/sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0/statement": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0/statement": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0/statement": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "LGPL-3.0/statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT/statement": "Released under the MIT License.",
    "MIT/grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "ISC/grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense/statement": "This is free and unencumbered software released into the public domain.",
    "MIT/licence": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause/licence": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        + _BSD_DISCLAIMER
    ),
    "BSD-3-Clause/licence": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        + _BSD_DISCLAIMER
    ),
    "ISC/licence": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib/licence": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
}

_WORD_BREAK = r"[^\p{L}\p{N}]+"
UNITS = ("line", "paragraph", "text", "window")


def template_sequence(text: str) -> list[str]:
    """The word bigrams of a template in order, with repeats; a single word as itself."""
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] or words


def template_bigrams(text: str) -> list[str]:
    return sorted(set(template_sequence(text)))


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Sizes of the other set at which Dice can reach the threshold."""
    per_mille = round(1000 * threshold)
    return -(-size * per_mille // (2000 - per_mille)), size * (2000 - per_mille) // per_mille


def least_common(size: int, threshold: float) -> int:
    """Bigrams that a passage must share with a template of ``size`` to reach the threshold."""
    per_mille = round(1000 * threshold)
    return -(-per_mille * (size + bounds(size, threshold)[0]) // 2000)


def markers(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which every passage that reaches the threshold with a template holds one: so many of its words that the
    bigrams without any are too few. Rarer words, and those of other templates, are taken first."""
    taken: list[str] = []
    for text in templates.values():
        own = set(template_sequence(text))
        need = least_common(len(own), threshold)
        while len(left := {b for b in own if not set(b.split()) & set(taken)}) >= need:
            rare = lambda w: w not in COMMON and not w.isdigit()
            score = lambda w: (rare(w), sum(w in b.split() for b in left), len(w), w)  # noqa: B023, E731
            taken.append(max({w for b in left for w in b.split()}, key=score))
    return sorted(taken)


def anchors(templates: dict[str, str], threshold: float) -> list[tuple[str, int, str, int]]:
    """(template, its length in bigrams, bigram with a marker word, first place of that in the template)."""
    marks, out = set(markers(templates, threshold)), []
    for name, text in sorted(templates.items()):
        sequence = template_sequence(text)
        out += [(name, len(sequence), b, sequence.index(b)) for b in sorted(set(sequence)) if set(b.split()) & marks]
    return out


def _words(passage: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(passage), _WORD_BREAK, " "), " "), lambda w: w != "")


def _pairs(words: Column) -> Column:
    """All bigrams in order; none of a single word."""
    n = F.size(words)
    return F.transform(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))


def _strings(values) -> Column:
    """An array of strings without a bar, from one literal."""
    return F.split(F.lit("|".join(values)), r"\|")


_COMPARED = "array<struct<common:int,n:int,n_template:int,template:string,unit:int,place:int>>"


class _Known:
    """The templates as literals: their number is the place in the sorted names."""

    def __init__(self, templates: dict[str, str], threshold: float):
        self.names = sorted(templates)
        own = [template_bigrams(templates[n]) for n in self.names]
        lengths = [len(template_sequence(templates[n])) for n in self.names]
        limits = [bounds(len(b), threshold) for b in own]
        self.per_mille, self.least, self.most = round(1000 * threshold), min(low for low, _ in limits), max(high for _, high in limits)
        row = lambda n, b, size, limit: F.struct(F.lit(n).alias("name"), _strings(b).alias("own"), F.lit(size).alias("length"), F.lit(limit[0]).alias("low"), F.lit(limit[1]).alias("high"))
        self.table = F.array(*map(row, self.names, own, lengths, limits))
        self.marker = r"(?<![a-z0-9])(?:" + "|".join(markers(templates, threshold)) + r")(?![a-z0-9])"
        self.anchors: dict[str, list[tuple[int, int]]] = {}
        for name, _, bigram, place in anchors(templates, threshold):
            self.anchors.setdefault(bigram, []).append((self.names.index(name), place))

    def marked(self, passage: Column) -> Column:
        return F.lower(passage).rlike(self.marker)

    def compare(self, t: Column, bigrams: Column, unit: int, place: Column) -> Column:
        """A struct of how a set of bigrams compares with a template; common is 0 where the sizes do not fit."""
        n = F.size(bigrams)
        common = F.when((n >= t["low"]) & (n <= t["high"]), F.size(F.array_intersect(bigrams, t["own"]))).otherwise(F.lit(0))
        return F.struct(common.alias("common"), n.alias("n"), F.size(t["own"]).alias("n_template"), t["name"].alias("template"), F.lit(unit).alias("unit"), place.cast("int").alias("place"))

    def good(self, compared: Column) -> Column:
        return F.filter(compared, lambda h: 2000 * h["common"] >= self.per_mille * (h["n"] + h["n_template"]))

    def of_passages(self, passages: Column, unit: int) -> Column:
        """Structs of the templates that passages reach the threshold with."""
        placed = F.filter(F.transform(passages, lambda p, i: F.struct(p.alias("p"), i.alias("i"))), lambda x: self.marked(x["p"]))

        def of(words: Column, place: Column) -> Column:
            bigrams = F.array_distinct(F.when(F.size(words) > 1, _pairs(words)).otherwise(words))
            every = lambda b: F.transform(self.table, lambda t: self.compare(t, b, unit, place))
            fits = lambda b: F.when((F.size(b) >= self.least) & (F.size(b) <= self.most), every(b)).otherwise(F.array().cast(_COMPARED))
            return self.good(_let(F.when(F.size(words) > self.least - 1, bigrams).otherwise(F.array().cast("array<string>")), fits))

        return F.flatten(F.transform(placed, lambda x: _let(_words(x["p"]), lambda w: of(w, x["i"]))))

    def of_windows(self, text: Column) -> Column:
        """The same for the windows of a text."""
        # "bigram=template:place,template:place;..." as one literal
        told = ";".join(f"{b}=" + ",".join(f"{t}:{at}" for t, at in found) for b, found in sorted(self.anchors.items()))
        spots = F.str_to_map(F.lit(told), F.lit(";"), F.lit("="))
        number = lambda e, k: F.get(F.split(e, ":"), F.lit(k)).cast("int")

        def of(pairs: Column) -> Column:
            hits = F.filter(F.transform(pairs, lambda b, i: F.struct(b.alias("b"), i.alias("i"))), lambda x: x["b"].isin(sorted(self.anchors)))
            starts = F.flatten(F.transform(hits, lambda x: F.transform(F.split(F.element_at(spots, x["b"]), ","), lambda e: F.struct(number(e, 0).alias("t"), F.greatest(F.lit(0), x["i"] - number(e, 1)).alias("start")))))
            window = lambda c, t: F.array_distinct(F.slice(pairs, c["start"] + 1, t["length"]))
            compared = lambda c: _let(F.get(self.table, c["t"]), lambda t: _let(window(c, t), lambda b: self.compare(t, b, 3, c["start"])))
            return self.good(F.transform(F.array_distinct(starts), compared))

        return _let(_let(_words(text), _pairs), of)


def scan_licences(documents: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): n_matches, and of the best match template, unit, place (from 0
    among the text's units; of a window its first word), common, n_bigrams, n_template and dice.

    Best: the greatest Dice; then the most common bigrams, lines before paragraphs before the text before windows, the
    smaller place, the template's name. No match, a null or empty text: n_matches 0, the other columns null. Other columns are ignored;
    repeated rows are repeated; no rows give none.
    """
    known = _Known(templates, threshold)
    text = F.coalesce(F.col("text"), F.lit(""))
    paragraphs = F.split(text, r"\n[ \t\r]*\n", -1)
    none = F.array().cast("array<string>")
    found = F.concat(
        known.of_passages(F.split(text, "\n", -1), 0),
        known.of_passages(_let(paragraphs, lambda units: F.when(F.size(units) > 1, units).otherwise(none)), 1),
        known.of_passages(F.when(F.instr(text, "\n") > 0, F.array(text)).otherwise(none), 2),
        known.of_windows(text),
    )
    found = F.when(known.marked(text), found).otherwise(F.array().cast(_COMPARED))
    # Dice in billionths, an integer: equal on every engine
    share = lambda h: F.floor(F.lit(2_000_000_000).cast("long") * h["common"] / (h["n"] + h["n_template"])).cast("long")
    ranked = lambda hits: F.transform(
        hits, lambda h: F.struct((-share(h)).alias("order"), (-h["common"]).alias("less"), h["unit"].alias("unit"), h["place"].alias("place"), h["template"].alias("template"), h["common"].alias("common"), h["n"].alias("n"), h["n_template"].alias("n_template"))
    )
    judged = documents.select(F.col("doc_id").cast("long").alias("doc_id"), _let(found, lambda hits: F.struct(F.size(hits).alias("n"), F.array_min(ranked(hits)).alias("best"))).alias("m"))
    best = F.col("m.best")
    unit = F.coalesce(*(F.when(best["unit"] == k, F.lit(name)) for k, name in enumerate(UNITS)))
    return judged.select(
        "doc_id",
        F.col("m.n").cast("long").alias("n_matches"),
        best["template"].alias("template"),
        unit.alias("unit"),
        best["place"].cast("long").alias("place"),
        best["common"].cast("long").alias("common"),
        best["n"].cast("long").alias("n_bigrams"),
        best["n_template"].cast("long").alias("n_template"),
        F.round(2.0 * best["common"] / (best["n"] + best["n_template"]), 6).alias("dice"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle(table: str = "documents", threshold: float = THRESHOLD) -> str:
    rows = []
    for name, text in TEMPLATES.items():
        own = template_bigrams(text)
        rows.append(f"('{name}', {bounds(len(own), threshold)[0]}, {bounds(len(own), threshold)[1]}, [{', '.join(repr(b) for b in own)}])")
    spots = ", ".join(f"('{name}', {length}, '{bigram}', {place})" for name, length, bigram, place in anchors(TEMPLATES, threshold))
    per_mille = round(1000 * threshold)
    normal = lambda t: f"list_filter(string_split(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
    WITH templates(template, low, high, own) AS (VALUES {", ".join(rows)}),
    spots(template, length, bigram, spot) AS (VALUES {spots}),
    docs AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM {table}),
    units AS (
        SELECT k, 0 AS u, unnest(string_split(text, chr(10))) AS passage, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM docs
        UNION ALL
        SELECT k, 1, unnest(p), generate_subscripts(p, 1) - 1 FROM (SELECT k, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS p FROM docs) WHERE len(p) > 1
        UNION ALL SELECT k, 2, text, 0 FROM docs WHERE contains(text, chr(10))),
    words AS (SELECT k, u, place, {normal("passage")} AS w FROM units),
    pairs AS (SELECT k, u, place, CASE WHEN len(w) > 1 THEN list_distinct({pairs}) ELSE w END AS b FROM words),
    running AS (SELECT k, {pairs} AS b FROM (SELECT k, {normal("text")} AS w FROM docs) WHERE len(w) > 1),
    placed AS (SELECT k, unnest(b) AS bigram, generate_subscripts(b, 1) - 1 AS i FROM running),
    starts AS (SELECT DISTINCT k, template, length, greatest(0, i - spot) AS start FROM placed JOIN spots USING (bigram)),
    windows AS (SELECT s.k, 3 AS u, s.start AS place, s.template, list_distinct(r.b[s.start + 1 : s.start + s.length]) AS b FROM starts s JOIN running r USING (k)),
    hits AS (SELECT k, u, place, template, len(list_intersect(b, own)) AS common, len(b) AS n, len(own) AS n_template
        FROM pairs JOIN templates ON len(b) BETWEEN low AND high
        UNION ALL SELECT k, u, place, template, len(list_intersect(b, own)), len(b), len(own) FROM windows JOIN templates USING (template) WHERE len(b) BETWEEN low AND high),
    good AS (SELECT *, count(*) OVER (PARTITION BY k) AS n_matches, row_number() OVER (PARTITION BY k ORDER BY 2000000000 * common // (n + n_template) DESC, common DESC, u, place, template) AS r
        FROM hits WHERE 2000 * common >= {per_mille} * (n + n_template))
    SELECT d.doc_id, coalesce(g.n_matches, 0)::BIGINT AS n_matches, g.template, CASE g.u WHEN 0 THEN 'line' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'text' WHEN 3 THEN 'window' END AS unit, g.place::BIGINT AS place,
        g.common::BIGINT AS common, g.n::BIGINT AS n_bigrams, g.n_template::BIGINT AS n_template, round(2.0 * g.common / (g.n + g.n_template), 6)::DOUBLE AS dice
    FROM docs d LEFT JOIN good g ON d.k = g.k AND g.r = 1
    """

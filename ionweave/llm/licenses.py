"""Licence scan: parts of texts against licence templates by the Dice coefficient over word bigrams, native.

Words are runs of a-z and 0-9 in the lower-cased text; bigrams are pairs of neighbouring words, as 64-bit hashes. Units of a text are

* its lines,
* its paragraphs (between blank lines) of more than one line,
* its runs: for each template, stretches of the whole text, whatever its lines, that begin and end with a bigram of the template, with at
  most ``GAP`` - 1 others in a row between. They find what stands within a longer line, and texts of several paragraphs; what only other
  templates have neither lengthens nor joins them. A run is held against its own template, and one that lies within another template's is
  not reported beside it (of equal runs the one of higher Dice is).

With a unit's a and a template's b distinct bigrams, of which o are shared, Dice is 2 o / (a + b). It can reach the threshold t only
where a template's size lies between a t / (2 - t) and a (2 - t) / t, and a unit counts only with t / (2 - t) of the smallest template's
size, and of its own, in bigrams that any template has. All bounds are on distinct bigrams, so pruning loses nothing. No row is
shuffled, and the plan is the same for any number of templates, whose bigrams are one constant; ``MOST`` bounds it.

Edge cases: null and empty texts have no units that match. Units of less than two words have no bigrams and match nothing. Of
templates that tie, the first by name is reported. Equal rows are reported as often as they occur, null ids as null. Texts are whole,
however long. Extra columns are neither read nor returned, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionweave.llm.common import beside, table

#: In percent.
THRESHOLD = 80
#: Bigrams of a template this far apart are of one run; 3 allows a changed word.
GAP = 3
#: Bigrams of all templates together; they are in the plan that each task gets.
MOST = 100_000

# Public licence texts without their copyright lines, and the notices that licences ask for or offer.
TEXTS = {
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
        'software and accompanying documentation covered by this license (the "Software") to use, reproduce, '
        "display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
        "Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the "
        "following: The copyright notices in the Software and this entire statement, including the above license "
        "grant, this restriction and the following disclaimer, must be included in all copies of the Software, in"
        " whole or in part, and all derivative works of the Software, unless such copies or derivative works are "
        "solely in the form of machine-executable object code generated by a source language processor. THE "
        'SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-"
        "INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR "
        "ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, or"
        " (at your option) any later version. This program is distributed in the hope that it will be useful, but"
        " WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or"
        " (at your option) any later version. This program is distributed in the hope that it will be useful, but"
        " WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU"
        " General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        'copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF '
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize"
        " copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the"
        " detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment "
        "in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
        "THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT "
        "OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors"
        " be held liable for any damages arising from the use of this software. Permission is granted to anyone "
        "to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions: 1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in "
        "a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. "
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software. 3. This notice may not be removed or altered from any source distribution."
    ),
}

# Opening clauses of licences, and short notices as authors write them.
NOTICES = {
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-4.0-short": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-sa-4.0-short": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0-notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
        "to this work."
    ),
    "gpl-3.0-grant": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or"
        " (at your option) any later version."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies."
    ),
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions:"
    ),
    "mit-notice": "Released under the MIT License.",
    "unlicense-opening": "This is free and unencumbered software released into the public domain.",
}

TEMPLATES = TEXTS | NOTICES


def template_bigrams(text: str) -> list[tuple[str, str]]:
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(zip(words, words[1:], strict=False)))


def bigram_hash(a: str, b: str) -> int:
    """``xxhash64`` of two columns as Spark has it."""
    import xxhash

    h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
    return h - (1 << 64) if h >> 63 else h


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bigrams_of(text: Column) -> Column:
    """The hashes of all bigrams of a text in order."""

    def of(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))
        return F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<bigint>"))

    return let(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), of)


def unit(kind: str, nth: Column, grams: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), nth.cast("long").alias("nth"), grams.alias("g"))


def units_of(text: Column) -> Column:
    """Lines and paragraphs (kind, nth, g) of a text."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: unit("line", i, bigrams_of(x)))
    blocks = F.transform(F.split(text, "\n[ \t\r]*\n"), lambda x, i: F.struct(i.alias("nth"), x.alias("text")))
    blocks = F.filter(blocks, lambda p: F.contains(p["text"], F.lit("\n")))
    paragraphs = F.transform(blocks, lambda p: unit("paragraph", p["nth"], bigrams_of(p["text"])))
    return F.concat(lines, paragraphs)


def spans_of(hits: Column, t: Column, low: int, high: int) -> Column:
    """(a, z) of each run of a template's bigrams among the places ``hits`` (g, i) that is long enough to be the template."""

    def of(at: Column) -> Column:
        begins = F.filter(at, lambda p, j: (j == 0) | (p - F.get(at, j - 1) > GAP))
        ends = F.filter(at, lambda p, j: (j == F.size(at) - 1) | (F.get(at, j + 1) - p > GAP))
        return F.filter(F.arrays_zip(begins.alias("a"), ends.alias("z")), lambda x: (x["z"] - x["a"] + 1) * high >= t["b"] * low)

    return let(F.transform(F.filter(hits, lambda h: F.array_contains(t["g"], h["g"])), lambda h: h["i"]), of)


def score(grams: Column, a: Column, t: Column) -> Column:
    """How a unit of ``a`` distinct bigrams matches a template."""
    shared = F.size(F.array_intersect(grams, t["g"]))
    dice = 2.0 * shared / (a + t["b"])
    return F.struct(dice.alias("dice"), t["order"].alias("order"), t["license"].alias("license"), shared.alias("shared"), t["b"].alias("b"))


def runs_of(text: Column, held: Column, known, threshold: int) -> Column:
    """The runs of a text that reach the threshold with their templates: (kind, nth, z, a, x), x the score; ``nth`` and ``z`` are the numbers
    of the first and the last bigram."""
    low, high = threshold, 200 - threshold

    def of(grams: Column) -> Column:
        places = F.filter(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))), lambda h: known(h["g"]))

        def against(hits: Column) -> Column:
            def of_template(t: Column) -> Column:
                def run(x: Column) -> Column:
                    own = F.array_distinct(F.slice(grams, x["a"] + 1, x["z"] - x["a"] + 1))
                    return let(own, lambda g: F.struct(F.lit("run").alias("kind"), x["a"].cast("long").alias("nth"), x["z"].alias("z"), F.size(g).alias("a"), score(g, F.size(g), t).alias("x")))

                runs = F.transform(spans_of(hits, t, low, high), run)
                return F.filter(runs, lambda r: 200 * r["x"]["shared"] >= threshold * (r["a"] + r["x"]["b"]))

            return F.flatten(F.transform(held, of_template))

        def outermost(found: Column) -> Column:
            def beats(y: Column, x: Column) -> Column:
                same = (y["nth"] == x["nth"]) & (y["z"] == x["z"])
                return (y["nth"] <= x["nth"]) & (y["z"] >= x["z"]) & F.when(same, y["x"] > x["x"]).otherwise(True)

            return F.filter(found, lambda x: ~F.exists(found, lambda y: beats(y, x)))

        return let(let(places, against), outermost)

    return let(bigrams_of(text), of)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """(id, kind, nth, license, shared, unit_bigrams, dice) of each unit that reaches the threshold with its best template."""
    named = sorted((TEMPLATES if templates is None else templates).items())
    grams = {k: sorted(bigram_hash(*g) for g in template_bigrams(v)) for k, v in named}
    if not grams or not all(grams.values()) or not 0 < threshold <= 100:
        raise ValueError("templates need two words at least, the threshold is 1 to 100")
    if sum(map(len, grams.values())) > MOST:
        raise ValueError(f"templates have more than {MOST} bigrams")
    low, high = threshold, 200 - threshold
    least, most = min(map(len, grams.values())), max(map(len, grams.values()))
    every = sorted({g for x in grams.values() for g in x})
    # one constant, whatever the number of templates; order makes the first by name the largest of those that tie
    rows = [{"license": k, "order": -i, "b": len(g), "g": g} for i, (k, g) in enumerate(grams.items())]
    held = F.from_json(F.lit(json.dumps(rows)), "array<struct<license:string,order:int,b:int,g:array<bigint>>>")

    def known(g: Column) -> Column:
        return g.isin(every)

    def enough(u: Column) -> Column:
        return (F.size(u["g"]) * high >= least * low) & (F.size(F.filter(u["g"], known)) * high >= least * low)

    def sized(u: Column) -> Column:
        a = F.size(u["g"])
        return (a * high >= least * low) & (a * low <= most * high) & (F.size(F.filter(u["g"], known)) * high >= a * low)

    text = F.coalesce(F.col(text_col), F.lit(""))
    units = F.filter(units_of(text), enough)
    units = F.filter(F.transform(units, lambda u: F.struct(u["kind"].alias("kind"), u["nth"].alias("nth"), F.array_distinct(u["g"]).alias("g"))), sized)
    no_grams, no_score = F.array().cast("array<bigint>"), F.lit(None).cast("struct<dice:double,order:int,license:string,shared:int,b:int>")
    plain = F.transform(units, lambda u: F.struct(u["kind"].alias("kind"), u["nth"].alias("nth"), u["g"].alias("g"), F.size(u["g"]).alias("a"), no_score.alias("x")))
    runs = F.transform(runs_of(text, held, known, threshold), lambda r: F.struct(r["kind"].alias("kind"), r["nth"].alias("nth"), no_grams.alias("g"), r["a"].alias("a"), r["x"].alias("x")))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.concat(plain, runs)).alias("u")).select("id", "u.kind", "u.nth", "u.g", "u.a", "u.x")
    fitting = F.filter(held, lambda t: (F.col("a") * high >= t["b"] * low) & (F.col("a") * low <= t["b"] * high))
    found = F.filter(F.transform(fitting, lambda t: score(F.col("g"), F.col("a"), t)), lambda x: 200 * x["shared"] >= threshold * (F.col("a") + x["b"]))
    best = F.when(F.col("x").isNotNull(), F.col("x")).otherwise(F.array_max(found))
    best = rows.select("id", "kind", "nth", "a", F.explode(F.filter(F.array(best), lambda x: x.isNotNull())).alias("x"))
    shared, a = F.col("x.shared").cast("long"), F.col("a").cast("long")
    out = best.select(F.col("id").alias(id_col), "kind", "nth", "x.license", shared.alias("shared"), a.alias("unit_bigrams"), F.round("x.dice", 6).alias("dice"))
    return out.toDF(id_col, *beside(id_col, out.columns[1:]))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _oracle() -> str:
    """SQL without any pruning."""
    rows = ", ".join(f"('{name}', '{a} {b}')" for name, t in sorted(TEMPLATES.items()) for a, b in template_bigrams(t))
    return rf"""
WITH templates(license, g) AS (VALUES {rows}),
sized AS (SELECT license, count(*) AS b FROM templates GROUP BY license),
raw AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, 'line' AS kind, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS nth FROM raw),
parts AS (SELECT r, 'paragraph' AS kind, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS unit, generate_subscripts(regexp_split_to_array(text, '\n[ \t\r]*\n'), 1) - 1 AS nth FROM raw),
units AS (SELECT r, kind, nth, unit FROM lines UNION ALL SELECT r, kind, nth, unit FROM parts WHERE contains(unit, chr(10)) UNION ALL SELECT r, 'text', 0, text FROM raw),
split AS (SELECT r, kind, nth, regexp_extract_all(lower(unit), '[a-z0-9]+') AS w FROM units),
words AS (SELECT r, kind, nth, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM split WHERE len(w) >= 2),
pairs AS (SELECT r, kind, nth, i, word || ' ' || lead(word) OVER (PARTITION BY r, kind, nth ORDER BY i) AS g FROM words),
hits AS (SELECT p.r, t.license, p.i, p.i - lag(p.i) OVER (PARTITION BY p.r, t.license ORDER BY p.i) AS gap FROM pairs AS p JOIN templates AS t ON p.g = t.g WHERE p.kind = 'text'),
islands AS (SELECT r, license, i, sum(CASE WHEN gap > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY r, license ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM hits),
runs AS (SELECT r, license, min(i) AS a, max(i) AS z FROM islands GROUP BY r, license, island),
grams AS (SELECT DISTINCT r, kind, nth, g FROM pairs WHERE kind <> 'text' AND g IS NOT NULL),
run_grams AS (SELECT DISTINCT u.r, u.license, u.a, u.z, p.g FROM runs AS u JOIN pairs AS p ON p.r = u.r AND p.kind = 'text' AND p.i BETWEEN u.a AND u.z),
run_sizes AS (SELECT x.r, x.license, x.a, x.z, count(*) AS n, count(t.g) AS shared FROM run_grams AS x LEFT JOIN templates AS t ON x.g = t.g AND x.license = t.license GROUP BY x.r, x.license, x.a, x.z),
run_held AS (SELECT x.*, s.b, 2.0 * shared / (n + s.b) AS dice FROM run_sizes AS x JOIN sized AS s ON x.license = s.license WHERE 200 * shared >= {THRESHOLD} * (n + s.b)),
outermost AS (SELECT * FROM run_held AS x WHERE NOT EXISTS (SELECT 1 FROM run_held AS y WHERE y.r = x.r AND y.a <= x.a AND y.z >= x.z
  AND (y.a <> x.a OR y.z <> x.z OR CAST(y.dice AS DOUBLE) > CAST(x.dice AS DOUBLE) OR (CAST(y.dice AS DOUBLE) = CAST(x.dice AS DOUBLE) AND y.license < x.license)))),
counted AS (SELECT r, kind, nth, count(*) AS a FROM grams GROUP BY r, kind, nth),
met AS (SELECT x.r, x.kind, x.nth, t.license, count(*) AS shared FROM grams AS x JOIN templates AS t ON x.g = t.g GROUP BY x.r, x.kind, x.nth, t.license),
held AS (SELECT m.*, c.a, s.b, 2.0 * m.shared / (c.a + s.b) AS dice FROM met AS m JOIN counted AS c ON m.r = c.r AND m.kind = c.kind AND m.nth = c.nth JOIN sized AS s ON m.license = s.license
         WHERE 200 * m.shared >= {THRESHOLD} * (c.a + s.b)),
best AS (SELECT *, row_number() OVER (PARTITION BY r, kind, nth ORDER BY CAST(dice AS DOUBLE) DESC, license) AS place FROM held)
SELECT raw.doc_id, kind, CAST(nth AS BIGINT) AS nth, license, CAST(shared AS BIGINT) AS shared, CAST(a AS BIGINT) AS unit_bigrams, round(CAST(2 * shared AS DOUBLE) / (a + b), 6) AS dice
FROM best JOIN raw ON best.r = raw.r WHERE place = 1
UNION ALL SELECT raw.doc_id, 'run', CAST(x.a AS BIGINT), license, CAST(shared AS BIGINT), CAST(n AS BIGINT), round(CAST(2 * shared AS DOUBLE) / (n + b), 6) FROM outermost AS x JOIN raw ON x.r = raw.r
"""


ORACLE = _oracle()

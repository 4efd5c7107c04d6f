"""Licence scans: normalised text against licence templates by the Dice coefficient of word bigrams. DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices by which public licences are usually granted, and paragraphs of their texts.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD-3-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("MIT", "Distributed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "This file is licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
]


def whole(name: str, title: str, *begins: str) -> tuple[str, str]:
    """The text of a licence from those of its paragraphs above that begin so."""
    return name, " ".join([title, *[next(t for n, t in reversed(TEMPLATES) if t.lower().startswith(b)) for b in begins]])


TEMPLATES += [
    whole("MIT", "MIT License Copyright (c)", "permission is hereby granted", "the above copyright notice", "the software is provided"),
    whole("BSD-3-Clause", "Copyright (c) All rights reserved.", "redistribution and use", "redistributions of source", "redistributions in binary", "neither the name", "this software is provided by"),
    whole("BSD-2-Clause", "Copyright (c) All rights reserved.", "redistribution and use", "redistributions of source", "redistributions in binary", "this software is provided by"),
]


def bigrams(text: str) -> list[str]:
    """A template's distinct pairs of neighbouring words, normalised as the texts are."""
    words = re.findall(r"[^\W_]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def needed(templates: list[tuple[str, str]], threshold: float) -> list[str]:
    """Pairs of which any text as like a template as the threshold holds one: a text with Dice t shares at least t / (2 - t)
    of the template's pairs, so it cannot lack more than the rest. The longest pairs are taken, as the rarest."""
    out = set()
    for _, text in templates:
        pairs = sorted(bigrams(text), key=lambda p: (-len(p), p))
        out.update(pairs[: len(pairs) - math.ceil(threshold / (2 - threshold) * len(pairs) - 1e-9) + 1])
    return sorted(out)


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")


def pairs_of(text: Column) -> Column:
    """The distinct pairs of neighbouring words of a text. The words are the one element of an array, so that they are made
    once, not for each pair."""
    words = F.array(F.split(F.trim(normalised(text)), " "))
    return F.get(F.transform(words, lambda w: F.array_distinct(F.transform(F.slice(w, 2, F.size(w)), lambda x, i: F.concat_ws(" ", F.get(w, i), x)))), F.lit(0))


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = 0.8, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(id, unit, unit_no, template_no, license, n_bigrams, dice, also): a row for each unit of a text that is as like a
    template as the threshold, with the likest template (of equals the first). also names the other licences whose templates
    are as like as that one, joined by commas.

    Units are the lines of a text, its sentences that are no lines, its paragraphs (split at blank lines) of several lines, and
    the whole text if it has several paragraphs; each is lower-cased and split into words of letters and digits. Dice is over
    sets of pairs of neighbouring words. Templates are a literal list, so nothing is joined or shuffled: texts, then units,
    without any pair that a match needs are dropped first, then a unit meets only the templates whose sizes its own allows.
    Null, empty and one-word texts match nothing; repeated rows and ids give repeated rows; other columns are dropped.
    """
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9
    known = [(i, name, bigrams(t)) for i, (name, t) in enumerate(templates)]
    listed = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(name).alias("license"), F.array(*map(F.lit, pairs)).alias("pairs")) for i, name, pairs in known])
    sizes = [len(p) for _, _, p in known]
    pattern = " (?:" + "|".join(needed(templates, threshold)) + ") "
    likely = lambda part: F.concat(F.lit(" "), normalised(part), F.lit(" ")).rlike(pattern)
    rows = df.select(F.col(id).alias("_id"), F.col(text).alias("_text")).where(likely(F.col("_text")))

    lines, paragraphs, sentences = F.split("_text", "\n"), F.split("_text", r"\n[ \t\r]*\n"), F.split(F.regexp_replace("_text", r"([.!?])[ \t]+", "$1\n"), "\n")

    def numbered(kind: str, parts: Column, keep) -> Column:
        each = F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("unit"), i.alias("no"), p.alias("text")))
        return F.filter(each, lambda u: keep(u["text"]) & likely(u["text"]))

    units = F.concat(
        numbered("line", lines, lambda t: F.length(t) > 0),
        numbered("sentence", F.transform(sentences, lambda t: F.when(~F.array_contains(lines, t), t).otherwise("")), lambda t: F.length(t) > 0),
        numbered("paragraph", paragraphs, lambda t: F.contains(t, F.lit("\n"))),
        F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("document").alias("unit"), F.lit(0).alias("no"), F.col("_text").alias("text")))).otherwise(F.array()),
    )
    # what explode() gives is not folded into later expressions, so no pair is made twice
    paired = rows.select("_id", F.explode(units).alias("u")).select("_id", "u.unit", "u.no", F.explode(F.array(pairs_of(F.col("u.text")))).alias("pairs"))
    sized = paired.where(F.size("pairs").between(math.ceil(low * min(sizes)), math.floor(high * max(sizes))))
    met = F.filter(listed, lambda t: (F.size("pairs") >= low * F.size(t["pairs"])) & (F.size("pairs") <= high * F.size(t["pairs"])))
    dice = lambda t: F.lit(2.0) * F.size(F.array_intersect("pairs", t["pairs"])) / (F.size("pairs") + F.size(t["pairs"]))
    scored = sized.select("_id", "unit", "no", F.size("pairs").alias("n_bigrams"), F.explode(F.array(F.transform(met, lambda t: F.struct(dice(t).alias("dice"), (-t["no"]).alias("no"), t["license"].alias("license"))))).alias("met"))
    found = scored.withColumn("m", F.array_max("met")).where(F.col("m.dice") >= threshold - 1e-9)
    equal = F.filter("met", lambda t: (t["dice"] == F.col("m.dice")) & (t["license"] != F.col("m.license")))
    also = F.array_join(F.array_sort(F.array_distinct(F.transform(equal, lambda t: t["license"]))), ",")
    return found.select(F.col("_id").alias(id), "unit", F.col("no").cast("long").alias("unit_no"), (-F.col("m.no")).cast("long").alias("template_no"), F.col("m.license").alias("license"), F.col("n_bigrams").cast("long").alias("n_bigrams"), F.round("m.dice", 6).alias("dice"), also.alias("also"))


def oracle(templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> str:
    """scan() of documents as DuckDB SQL, without pruning."""
    values = ", ".join("({}, '{}', [{}])".format(i, name, ", ".join(f"'{p}'" for p in bigrams(t))) for i, (name, t) in enumerate(templates))
    return rf"""
WITH templates(no, license, pairs) AS (VALUES {values}),
d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (SELECT r, doc_id, string_split(text, chr(10)) AS parts FROM d),
sents AS (SELECT r, doc_id, string_split(text, chr(10)) AS lines, string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM d),
paras AS (SELECT r, doc_id, text, string_split_regex(text, '\n[ \t\r]*\n') AS parts FROM d),
units AS (
  SELECT r, doc_id, 'line' AS unit, unnest(range(len(parts))) AS unit_no, unnest(parts) AS body FROM lines
  UNION ALL SELECT r, doc_id, unit, unit_no, body FROM (SELECT r, doc_id, 'sentence' AS unit, unnest(range(len(parts))) AS unit_no, unnest(parts) AS body, lines FROM sents) WHERE NOT list_contains(lines, body)
  UNION ALL SELECT * FROM (SELECT r, doc_id, 'paragraph', unnest(range(len(parts))), unnest(parts) AS body FROM paras) WHERE contains(body, chr(10))
  UNION ALL SELECT r, doc_id, 'document', 0, text FROM paras WHERE len(parts) > 1),
split AS (SELECT r, doc_id, unit, unit_no, string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words FROM units WHERE length(body) > 0),
paired AS (SELECT r, doc_id, unit, unit_no, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS pairs FROM split WHERE len(words) > 1),
met AS (SELECT r, doc_id, unit, unit_no, no, license, len(p.pairs) AS n, 2.0::DOUBLE * len(list_intersect(p.pairs, t.pairs)) / (len(p.pairs) + len(t.pairs)) AS dice FROM paired p, templates t),
top AS (SELECT *, first(license) OVER w AS name, row_number() OVER w AS place, max(dice) OVER (PARTITION BY r, unit, unit_no) AS most FROM met WHERE dice >= {threshold} - 1e-9 WINDOW w AS (PARTITION BY r, unit, unit_no ORDER BY dice DESC, no))
SELECT doc_id, unit, CAST(unit_no AS BIGINT) AS unit_no, CAST(max(CASE WHEN place = 1 THEN no END) AS BIGINT) AS template_no, any_value(name) AS license, CAST(any_value(n) AS BIGINT) AS n_bigrams, round(any_value(most), 6) AS dice,
  coalesce(string_agg(DISTINCT CASE WHEN dice = most AND license <> name THEN license END, ',' ORDER BY CASE WHEN dice = most AND license <> name THEN license END), '') AS also
FROM top GROUP BY r, doc_id, unit, unit_no"""

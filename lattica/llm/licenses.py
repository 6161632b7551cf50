"""Operator 10: license notices found by MinHash bands over overlapping windows, with DataFrame functions alone.

A text is its sequence of word shingles. Templates fall into tiers by their number of shingles; a tier's windows hold
twice as many and overlap by half, so some window holds any whole notice. A window has one MinHash value a band (the
least of its shingles' hashes, hashed again with the band's seed); it retrieves a template with an equal value in any
band. The number of bands follows from the least similarity that a window around a match can have, so that a match is
missed with at most the chance MOST_MISSED. Retrieved windows are verified by exact containment of the template's
shingles.

The bands of all templates are one table (shingle, tier, band, template), joined by shingle: a window can have a
template's value only where it holds the shingle that gives it, so only windows around such shingles are worked out.
The plan is the same for any number of templates.
"""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import WORD_GAP, let, null_as

MOST_MISSED = 1e-6
PUNCTUATION = ".,;:!?\"'()[]{}<>|*#$%&_/\\-–—"

#: Common license notices, headers of source files, and whole texts of short licenses.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    "BSD-2-Clause text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with
        the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
        OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated
        but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being
        the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense text": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
        publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or
        authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this
        dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
        copyright law.""",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
        BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "GPL-2.0-or-later header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details.""",
    "GPL-3.0-or-later header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
        License for more details. You should have received a copy of the GNU General Public License along with this program. If
        not, see <https://www.gnu.org/licenses/>.""",
    "AGPL-3.0-or-later header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General
        Public License for more details.""",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}


def shingle_hashes(text: Column, size: int) -> Column:
    """Hashes of a text's `size`-word shingles in order; of fewer words, of all of them as one."""
    clean = F.translate(F.lower(null_as(text)), PUNCTUATION, "")
    last = lambda ws: F.when(F.size(ws) == 0, 0).otherwise(F.greatest(F.size(ws) - size + 1, F.lit(1)))
    return let(F.array_remove(F.split(clean, WORD_GAP), ""), lambda ws: F.transform(F.slice(ws, F.lit(1), last(ws)), lambda w, i: F.xxhash64(w, *(F.get(ws, i + k) for k in range(1, size)))))


class Tier:
    """Windows of one size, and the templates for it."""

    def __init__(self, most: int, templates: dict[str, list[int]], contained: float):
        self.templates = templates
        self.window, self.stride = (1, 1) if most == 1 else (2 * most, most)
        least = 1.0
        for t in map(len, templates.values()):
            shared = math.ceil(contained * t - 1e-9)
            least = min(least, shared / (self.window + t - shared))
        self.least = least
        bands = 1 if least >= 1 else math.ceil(math.log(MOST_MISSED) / math.log(1 - least))
        self.bands = range(bands)

    def values(self) -> list[tuple[int, int, int, int, str]]:
        """For each template and band the shingle that gives the value, the window, the stride, the band and the template."""
        return [(min(t, key=lambda h, band=band: banded(h, band)), self.window, self.stride, band, name) for name, t in self.templates.items() for band in self.bands]


def banded(h: int, band: int) -> int:
    """A shingle hash hashed with a band's number, as Spark's xxhash64(band, h) does it: signed, 64 bits."""
    x = xxhash.xxh64_intdigest(struct.pack("<q", h), xxhash.xxh64_intdigest(struct.pack("<q", band), 42))
    return x - (1 << 64) if x >> 63 else x


def tiers(spark: SparkSession, templates: dict[str, str], size: int, contained: float) -> list[Tier]:
    """The templates by their numbers of distinct shingles: 1, up to 4, up to 8, up to 16 and so on."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    found = {r[0]: sorted(set(r[1])) for r in rows.select("license", shingle_hashes(F.col("text"), size)).collect() if r[1]}
    by: dict[int, dict[str, list[int]]] = {}
    for name, hashes in found.items():
        n = len(hashes)
        by.setdefault(1 if n == 1 else max(4, 1 << (n - 1).bit_length()), {})[name] = hashes
    return [Tier(most, own, contained) for most, own in sorted(by.items())]


def licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, size: int = 5, contained: float = 0.8) -> DataFrame:
    """doc_id, license, containment, place (the window's first shingle) for each notice that a text holds.

    A row matches a template once, by its best window (of equals the first). Null and empty texts match nothing; a null
    id stays null; repeated rows each give their matches; an empty table or no templates give no rows. A very long text
    is read whole; its windows are worked out one after the other. Extra columns are not read. Only matches are
    shuffled. The table of bands is broadcast: it has as many rows as the given templates have bands.
    """
    spark = docs.sparkSession
    found = tiers(spark, templates, size, contained)
    values = [v for t in found for v in t.values()] or [(0, 1, 1, 0, "")]
    bands = F.broadcast(spark.createDataFrame(values, "h long, window int, stride int, band long, license string"))
    own = F.broadcast(spark.createDataFrame([(name, t) for tier in found for name, t in tier.templates.items()] or [("", [0])], "license string, own array<long>"))
    hashes = shingle_hashes(F.col("text").cast("string"), size)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), hashes.alias("hashes"))
    known = ", ".join(f"{h}L" for h in sorted({v[0] for v in values}))  # a set that each shingle is looked up in
    hits = F.expr(f"filter(transform(hashes, (h, i) -> CASE WHEN h IN ({known}) THEN struct(h AS h, i AS at) END), x -> x IS NOT NULL)")
    hits = rows.select("*", F.explode(hits).alias("hit")).select("row", "doc_id", "hashes", "hit.*").join(bands, "h")
    # The windows that hold a place: its own one, and but for windows of one shingle the one before.
    last = F.floor(F.col("at") / F.col("stride")).cast("int")
    around = F.filter(F.array(last, F.when(F.col("window") > 1, last - 1)), lambda k: k >= 0)
    held = hits.select("row", "doc_id", "h", "band", "license", F.col("stride"), F.explode(around).alias("k"), "hashes", "window")
    held = held.select("row", "doc_id", "h", "band", "license", (F.col("k") * F.col("stride")).cast("long").alias("place"), F.slice("hashes", F.col("k") * F.col("stride") + 1, F.col("window")).alias("held"))
    value = lambda h: F.xxhash64(F.col("band"), h)
    held = held.where(F.array_min(F.transform("held", value)) == value(F.col("h"))).join(own, "license")
    scored = held.select("row", "doc_id", "license", F.struct((F.size(F.array_intersect("held", "own")) / F.size("own")).alias("containment"), (-F.col("place")).alias("before")).alias("m"))
    best = scored.where(F.col("m.containment") >= contained - 1e-9).groupBy("row", "doc_id", "license").agg(F.max("m").alias("m"))
    return best.select("doc_id", "license", F.col("m.containment").alias("containment"), (-F.col("m.before")).alias("place"))


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    chars = PUNCTUATION.replace("'", "''")
    clean = f"list_filter(regexp_split_to_array(translate(lower(coalesce(text, '')), '{chars}', ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    return f"""
WITH tpl AS (SELECT license, {clean} AS w FROM (VALUES {values}) v(license, text)),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT license, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM tpl)),
t AS (SELECT license, g, count(*) OVER (PARTITION BY license) AS t FROM ts),
tier AS (SELECT *, CASE WHEN t = 1 THEN 1 WHEN t <= 4 THEN 4 ELSE CAST(2 ** ceil(log2(t)) AS BIGINT) END AS stride FROM t),
d AS (SELECT row_number() OVER () AS r, doc_id, {clean} AS w FROM documents),
s AS (SELECT r, doc_id, i - 1 AS place, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
hit AS (SELECT r, doc_id, license, t, stride, g, place // stride AS k FROM s JOIN tier USING (g)),
win AS (SELECT r, doc_id, license, t, stride, g, k FROM hit UNION SELECT r, doc_id, license, t, stride, g, k - 1 FROM hit WHERE stride > 1 AND k > 0),
c AS (SELECT r, doc_id, license, k * stride AS place, count(DISTINCT g) / t AS containment FROM win GROUP BY r, doc_id, license, t, stride, k)
SELECT doc_id, license, CAST(max(containment) AS DOUBLE) AS containment, CAST(min_by(place, (-containment, place)) AS BIGINT) AS place
FROM c GROUP BY r, doc_id, license HAVING max(containment) >= 0.8 - 1e-9
"""


SQL = _sql()

"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Templates are license notices, in full or their telling part, and passages of license texts. The opening of the BSD texts,
which all of them share, is named BSD. Notices of fewer than five words, such as SPDX lines, aren't covered. A word is folded to lower case and stripped of what is neither letter nor digit. Templates of
like size form a class. A class's windows hold 1.5 times its largest template's shingles and overlap so that each
occurrence of a template lies inside one window. BANDS minima of one row each then agree in at least one band with
probability 1 - (1 - J)^BANDS. A window that holds 0.8 of a template of s shingles has J = 0.8 s / (1.5 l + 0.2 s), with l
the shingles of the largest template of its class, at most 1.5 s: J >= 0.326 and the probability is 0.9996 at least.

A band of a window can agree with that of a template only if the window holds the template's least shingle. So only
windows around such shingles, the anchors, get minima at all; all others could not be retrieved. Retrieved windows are
verified: matched are those with at least CONTAINMENT of the template's different five-word shingles.

All steps are built-in functions and one join with the templates' bands, a table of fixed size (BANDS rows a template).

Defined cases: null, empty and short texts match nothing. Repeated rows give repeated results (rows are told apart
within the plan). A null id is kept. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, words

SHINGLE, BANDS, CONTAINMENT = 5, 20, 0.8
#: License notices (fixed values). A notice that differs from another one in a word or two, such as a version, is cut so
#: short that those words decide: no template's text holds CONTAINMENT of another one's shingles, unless it holds them all.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Licensed under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": "Apache License Version 2.0, January 2004",
    "GPL-2.0": "the GNU General Public License, version 2",
    "GPL-3.0": "the GNU General Public License, version 3",
    "LGPL-2.1": "the GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "the GNU Lesser General Public License, version 3",
    "AGPL-3.0": "the GNU Affero General Public License, version 3",
    "GPL-2.0-header": "the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "GPL-3.0-header": "the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "GPL-2.0-only-header": "the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License",
    "GPL-3.0-only-header": "the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License",
    "LGPL-2.1-header": "the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "LGPL-3.0-header": "the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
    "AGPL-3.0-header": "the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
    "GPL-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June",
    "LGPL-2.1-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "LGPL-3.0-text": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "AGPL-3.0-text": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD-2-Clause-notice": "under the BSD 2-Clause License",
    "BSD-3-Clause-notice": "under the BSD 3-Clause License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-text": "Mozilla Public License Version 2.0",
    "EPL-1.0": "terms of the Eclipse Public License v1.0",
    "EPL-2.0": "terms of the Eclipse Public License 2.0",
    "EPL-2.0-header": "terms of the Eclipse Public License v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": "waived all copyright and related or neighboring rights to this work",
    "CC0-1.0-notice": "CC0 1.0 Universal Public Domain Dedication",
    "CC0-1.0-text": "CC0 1.0 Universal (CC0 1.0) Public Domain Dedication",
}
#: License texts in full, less their copyright lines.
TEMPLATES |= {
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-full": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE.""",
    "BSD-3-Clause-full": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the
names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib-full": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-full": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
}
#: The Creative Commons licenses come in the same two notices.
for _short, _long in {
    "BY": "Attribution",
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}.items():
    TEMPLATES[f"CC-{_short}-4.0"] = f"This work is licensed under a Creative Commons {_long} 4.0 International License."
    TEMPLATES[f"CC-{_short}-4.0-notice"] = f"Licensed under CC {_short} 4.0."
_rng = random.Random(1)
MASKS = [_rng.getrandbits(64) - 2**63 for _ in range(BANDS)]


def folded_words(text: Column) -> Column:
    return words(F.regexp_replace(fold(text), r"[^\p{L}\p{N}\x20\x09-\x0D]+", ""))


def _hashes(w: Column) -> Column:
    n = F.size(w)
    at = lambda i, k: F.get(w, i + k)
    each = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(at(i, k) for k in range(SHINGLE))))
    return F.when(n >= SHINGLE, each).otherwise(F.array().cast("array<bigint>"))


def _shingles(w: Column) -> Column:
    n = F.size(w)
    each = F.transform(F.sequence(F.lit(1), n - SHINGLE + 1), lambda i: F.concat_ws(" ", F.slice(w, i, SHINGLE)))
    return F.when(n >= SHINGLE, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class Size:
    """A class of templates: its windows' shingles and the step between their starts."""

    window: int
    step: int


@dataclass
class Index:
    """The templates with their bands."""

    rows: list[tuple[str, int, list[str], list[int]]]  # name, class, shingles, hashes
    sizes: list[Size]

    def bands(self) -> list[tuple[int, int, int, str]]:
        return [(c, k, min(h ^ m for h in hashes), name) for name, c, _, hashes in self.rows for k, m in enumerate(MASKS)]

    def anchors(self) -> list[int]:
        return sorted({min(hashes, key=lambda h: h ^ m) for _, _, _, hashes in self.rows for m in MASKS})


def index(spark: SparkSession, templates: dict[str, str] | None = None) -> Index:
    """Templates of fewer than five words can't be indexed and raise ValueError."""
    given = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "name string, text string")
    w = folded_words(F.col("text"))
    found = sorted(((r["name"], r["s"], r["h"]) for r in given.select("name", _shingles(w).alias("s"), _hashes(w).alias("h")).collect()), key=lambda r: (len(r[1]), r[0]))
    if not found or not found[0][1]:
        raise ValueError("a template has fewer than five words")
    rows, sizes, first, largest = [], [], 0, 0
    for name, s, h in found:
        if not first or len(s) > 1.5 * first:
            first = len(s)
            sizes.append(Size(0, 0))
        largest = max(len(h), largest if rows and rows[-1][1] == len(sizes) - 1 else 0)
        window = math.ceil(1.5 * largest)
        sizes[-1] = Size(window, window - largest + 1)
        rows.append((name, len(sizes) - 1, s, h))
    return Index(rows, sizes)


def _permuted(mask: int) -> Column:
    return F.transform("h", lambda h: h.bitwiseXOR(F.lit(mask)))


def _windows(number: int, size: Size) -> Column:
    """The windows of a class that hold an anchor, each once; they start at multiples of the class's step."""
    first = lambda a: F.ceil(F.greatest(a - size.window + 1, F.lit(0)) / size.step)
    found = F.array_distinct(F.flatten(F.transform("anchors", lambda a: F.sequence(first(a), F.floor(a / size.step)))))
    return F.transform(found, lambda j: F.struct(F.lit(number).alias("class"), (j * size.step).cast("int").alias("start"), F.lit(size.window).alias("window")))


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each row and license found in it: id, license, containment (the best window's), word (its start)."""
    spark = df.sparkSession
    ix = index(spark, templates)
    docs = df.select(F.col(id_col).alias("id"), folded_words(F.col(text)).alias("w")).withColumn("h", _hashes(F.col("w")))
    anchors = F.filter(F.transform("h", lambda h, i: F.when(h.isin(ix.anchors()), i)), lambda i: i.isNotNull())
    # the id, being nondeterministic, keeps the filter above the projections: pushed down, it would repeat their work per word
    docs = docs.withColumn("anchors", anchors).withColumn("row", F.monotonically_increasing_id()).filter(F.size("anchors") > 0)
    # the windows of each class that hold an anchor; a window starts at a multiple of its class's step
    starts = [_windows(c, size) for c, size in enumerate(ix.sizes)]
    windows = docs.select("row", "id", "w", "h", F.explode(F.concat(*starts)).alias("x"))
    windows = windows.select(
        "row", "id", "x.class", "x.start",
        F.slice("w", F.col("x.start") + 1, F.col("x.window") + SHINGLE - 1).alias("w"),
        F.slice("h", F.col("x.start") + 1, F.col("x.window")).alias("h"),
    )
    minima = F.array(*(F.array_min(_permuted(m)) for m in MASKS))
    banded = windows.select("row", "id", "class", "start", "w", F.posexplode(minima).alias("band", "least"))
    bands = spark.createDataFrame(ix.bands(), "class int, band int, least long, license string")
    met = banded.join(F.broadcast(bands), ["class", "band", "least"]).dropDuplicates(["row", "license", "start"])
    own = spark.createDataFrame([(name, s) for name, _, s, _ in ix.rows], "license string, template array<string>")
    verified = met.join(F.broadcast(own), "license").withColumn("containment", F.size(F.array_intersect(_shingles(F.col("w")), "template")) / F.size("template"))
    best = F.max(F.struct("containment", (-F.col("start")).alias("s")))
    out = verified.filter(F.col("containment") >= CONTAINMENT).groupBy("row", "id", "license").agg(best.alias("best"))
    return out.select(F.col("id").alias(id_col), "license", "best.containment", (-F.col("best.s")).cast("long").alias("word"))

"""License scan: MinHash bands over text windows retrieve templates, shingles verify them.

A text is cut to lower-case words and each run of ``SHINGLE`` words is hashed once. Windows
of shingles slide over the hashes: templates of about one length form a class whose windows
are longer than the longest by the step, half of the shortest, so one window holds any
occurrence whole. Each window has BANDS minima under different permutations, keyed re-hashes
of the shingles; a band is one minimum and collides with a probability of at least the
template's share of the window.
Classes hold lengths within a factor of two, so that share is over 0.4 and all bands miss
with a probability under 0.6**BANDS (under 0.3**BANDS for a lone length).
A window is joined by (class, band, minimum) with the templates that have that minimum, and only
with those; the share of a template's distinct shingles, compared as text, that a stretch as long as the template holds, decides.

Only built-in expressions run: no rows are exploded before a band has matched, and nothing
is shuffled but the matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackledger.llm.common import fresh

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 12
SEED = 42
WORD_BREAK = r"[^\p{L}\p{N}]+"

#: Fixed values: (template, license, wording). Notices and lines as they stand in files and on pages.
NOTICES = (
    ("reserved", "proprietary", "All rights reserved."),
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-licensed", "MIT", "Licensed under the MIT License."),
    ("mit-project", "MIT", "This project is licensed under the MIT License."),
    ("apache-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("bsd-line", "BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("gpl-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-short", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-short", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-line", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-line", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-sa-line", "CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd-line", "CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc-by-sa-wiki", "CC-BY-SA", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    ("cc0-line", "CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense-line", "Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "apache-notice",
        "Apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "apache-warranty",
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License.",
    ),
    (
        "gpl-grant",
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    (
        "lgpl-grant",
        "LGPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
    ),
    (
        "agpl-grant",
        "AGPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation",
    ),
    (
        "gpl-warranty",
        "GPL",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "mpl-notice",
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at",
    ),
    (
        "epl-notice",
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ),
)
#: Whole short licenses, clause by clause, without the copyright line.
MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction"
)
MIT_RIGHTS = (
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
MIT_CONDITION = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met"
)
BSD_CONDITIONS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
BSD_NAMES = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies."
)
ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
ZLIB_GRANT = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
    "arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial "
    "applications, and to alter it and redistribute it freely, subject to the following restrictions"
)
BOOST_GRANT = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
    "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare "
    "derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
)
UNLICENSE_GRANT = (
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
    "for any purpose, commercial or non-commercial, and by any means."
)
WHOLE = (
    ("mit-grant", "MIT", MIT_GRANT),
    ("mit-condition", "MIT", MIT_CONDITION),
    ("mit-warranty", "MIT", MIT_WARRANTY),
    ("mit", "MIT", " ".join((MIT_GRANT, MIT_RIGHTS, MIT_CONDITION, MIT_WARRANTY))),
    ("bsd-terms", "BSD", BSD_TERMS),
    ("bsd-warranty", "BSD", BSD_WARRANTY),
    ("bsd-2-clause", "BSD-2-Clause", " ".join((BSD_TERMS, BSD_CONDITIONS, BSD_WARRANTY))),
    ("bsd-3-clause", "BSD-3-Clause", " ".join((BSD_TERMS, BSD_CONDITIONS, BSD_NAMES, BSD_WARRANTY))),
    ("isc-grant", "ISC", ISC_GRANT),
    ("isc", "ISC", f"{ISC_GRANT} {ISC_WARRANTY}"),
    ("zlib-grant", "Zlib", ZLIB_GRANT),
    ("boost-grant", "BSL-1.0", BOOST_GRANT),
    ("unlicense-grant", "Unlicense", UNLICENSE_GRANT),
)
#: License names of the SPDX list that a tag line may name.
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later",
    "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only",
    "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "CC-BY-4.0", "CC-BY-SA-4.0",
)
TEMPLATES = (*NOTICES, *WHOLE, *((f"spdx-{x.lower()}", x, f"SPDX-License-Identifier: {x}") for x in SPDX))


@dataclass(frozen=True)
class Template:
    name: str
    license: str
    words: tuple[str, ...]

    @property
    def width(self) -> int:
        """Words per shingle: all of a wording shorter than a shingle."""
        return min(SHINGLE, len(self.words))

    @property
    def shingles(self) -> tuple[str, ...]:
        w = self.width
        return tuple(dict.fromkeys(" ".join(self.words[i : i + w]) for i in range(len(self.words) - w + 1)))


def templates(rows: Sequence[tuple[str, str, str]] = TEMPLATES) -> list[Template]:
    return [Template(n, lic, tuple(re.findall(r"[^\W_]+", text.lower()))) for n, lic, text in rows]


def spark_hash(*words: str) -> int:
    """What ``F.xxhash64`` gives for the words: each hash seeds the next."""
    h = SEED
    for w in words:
        h = xxhash.xxh64_intdigest(w.encode(), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def shingle_hash(shingle: str) -> int:
    return spark_hash(*shingle.split(" "))


def permutation(band: int) -> int:
    """Key of a band's permutation: hashes are joined with it by exclusive or and hashed again."""
    return spark_hash(f"band {band}")


def signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def permuted(h: int, band: int) -> int:
    """A hash under the band's permutation, as ``F.xxhash64`` gives it for one long."""
    return signed(xxhash.xxh64_intdigest(((h ^ permutation(band)) % (1 << 64)).to_bytes(8, "little"), SEED))


def bands_for(length: int) -> int:
    """A window of one shingle equals its template, so one band decides; else BANDS."""
    return 1 if length == 1 else BANDS


def classes(found: Sequence[Template]) -> dict[tuple[int, int], list[Template]]:
    """Templates by (words per shingle, class length): lengths round up to a power of two."""
    out: dict[tuple[int, int], list[Template]] = {}
    for t in found:
        length = 1 << (len(t.shingles) - 1).bit_length()
        out.setdefault((t.width, length), []).append(t)
    return out


def geometry(members: Sequence[Template]) -> tuple[int, int]:
    """(window, step) in shingles: step + longest - 1 shingles hold any occurrence whole."""
    longest = max(len(t.words) - t.width + 1 for t in members)
    shortest = min(len(t.words) - t.width + 1 for t in members)
    step = max(1, shortest // 2)
    return longest + step - 1, step


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often it is used."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def shingle_hashes(words: Column, width: int) -> Column:
    """Hashes of all shingles of ``width`` words (none when there are fewer words)."""
    return F.when(
        F.size(words) >= width,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - width),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def least(members: Sequence[Template], band: int) -> dict[int, int]:
    """Minimum of each template under the band's permutation, and the hash it comes from."""
    return dict(min((permuted(h, band), h) for h in map(shingle_hash, t.shingles)) for t in members)


def least_of(held: Column, band: int) -> Column:
    """Minimum of the window's hashes under the band's permutation."""
    return F.array_min(F.transform(held, lambda h: F.xxhash64(h.bitwiseXOR(F.lit(permutation(band))))))


def window_hits(held: Column, members: Sequence[Template], bands: int) -> Column:
    """The bands, and the minimum in each, in which the window collides with some template."""

    def hit(band: int) -> Column:
        found = let(least_of(held, band), lambda low: F.when(low.isin(sorted(least(members, band))), low))
        return F.struct(F.lit(band).alias("band"), found.alias("low"))

    return F.filter(F.array(*[hit(b) for b in range(bands)]), lambda h: h["low"].isNotNull())


def class_candidates(words: Column, hashes: Column, members: Sequence[Template]) -> Column:
    """Windows of one class of templates that collide in a band, as structs."""
    width = members[0].width
    window, step = geometry(members)
    last = F.greatest(F.size(hashes) - window, F.lit(0)) + (step - 1)
    starts = F.when(F.exists(hashes, lambda h: h.isin(first_hits(members))), F.sequence(F.lit(0), last, F.lit(step)))
    found = F.transform(
        F.coalesce(starts, F.array().cast("array<int>")),
        lambda s: F.struct(
            s.alias("start"),
            F.lit(width).alias("width"),
            F.lit(window).alias("window"),
            F.slice(words, s + 1, window + width - 1).alias("held"),
            window_hits(F.slice(hashes, s + 1, window), members, bands_for(window)).alias("hits"),
        ),
    )
    return F.filter(found, lambda c: F.size(c["hits"]) > 0)


def band_keys(found: Sequence[Template]) -> list[tuple]:
    """One row per template and band: what a window's (class, band, minimum) is joined with."""
    out = []
    for (width, _), members in classes(found).items():
        window, _ = geometry(members)
        for t in members:
            lows = [min(permuted(shingle_hash(s), band) for s in t.shingles) for band in range(bands_for(window))]
            out += [(width, window, band, low, t.name, lows) for band, low in enumerate(lows)]
    return out


def first_hits(members: Sequence[Template]) -> list[int]:
    """The shingles that are some template's minimum in some band."""
    return sorted({h for b in range(bands_for(geometry(members)[0])) for h in least(members, b).values()})


def width_candidates(words: Column, width: int, groups: Sequence[Sequence[Template]]) -> Column:
    """Candidate windows of all classes whose shingles have ``width`` words.

    A band collides only on a shingle that is a template's minimum, so texts without such a
    shingle are done after one look at their hashes, before windows are formed.
    """
    lows = sorted({h for members in groups for h in first_hits(members)})

    def windows(hashes: Column) -> Column:
        found = F.concat(*[class_candidates(words, hashes, members) for members in groups])
        return F.when(F.exists(hashes, lambda h: h.isin(lows)), found)

    return F.coalesce(let(shingle_hashes(words, width), windows), F.array().cast(HITS))


HITS = "array<struct<start:int,width:int,window:int,held:array<string>,hits:array<struct<band:int,low:bigint>>>>"
KEYS = "width int, window int, band int, low long, template string, lows array<long>"


def stretch_share() -> Column:
    """Largest share of the template's shingles in a stretch of the window as long as the template."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("held") - F.col("span"), F.lit(0)))
    held = F.transform(starts, lambda i: F.size(F.array_intersect("shingles", F.slice("held", i + 1, F.col("span")))))
    return F.array_max(held) / F.size("shingles")


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rows: Sequence[tuple[str, str, str]] = TEMPLATES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """One row per (id, template) found: license, best containment, windows, first word.

    ``first_word`` is the position of the first shingle of the template in the text, counted
    in words. Null and empty texts hold nothing; rows that share an id (null included) are
    put together; a table without matches gives an empty result.
    """
    found = templates(rows)
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    groups: dict[int, list[list[Template]]] = {}
    for (width, _), members in classes(found).items():
        groups.setdefault(width, []).append(members)
    hits = let(words, lambda w: F.concat(*[width_candidates(w, width, g) for width, g in groups.items()]))
    spark = docs.sparkSession
    windows = docs.select(F.col(id_col).alias("id"), F.explode(hits).alias("hit")).select(
        "id", "hit.start", "hit.width", "hit.window", "hit.held", "hit.hits", F.explode("hit.hits").alias("h")
    )
    # Both sides of the joins below that come from the templates are literal lists of the caller,
    # so they are broadcast at any input size. The first band of a window that leads to a template counts.
    retrieved = windows.withColumns({"band": F.col("h.band"), "low": F.col("h.low")}).join(
        F.broadcast(spark.createDataFrame(band_keys(found), KEYS)), ["width", "window", "band", "low"]
    )
    leads = F.filter("hits", lambda h: F.get("lows", h["band"]) == h["low"])
    candidates = retrieved.where(F.col("band") == F.get(leads, F.lit(0))["band"]).select("id", "start", "width", "held", "template")
    known = spark.createDataFrame(
        [(t.name, t.license, list(t.shingles), len(t.words) - t.width + 1) for t in found],
        "template string, license string, shingles array<string>, span int",
    )
    held = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("held") - F.col("width"), F.lit(0))),
        lambda i: F.concat_ws(" ", F.slice("held", i + 1, F.col("width"))),
    )
    checked = (
        candidates.join(F.broadcast(known), "template")
        .withColumn("held", held)
        .where(F.size(F.array_intersect("shingles", "held")) / F.size("shingles") >= containment)
        .withColumn("share", stretch_share())
        .where(F.col("share") >= containment)
        .withColumn("first", F.col("start") + F.array_position(F.transform("held", lambda h: F.array_contains("shingles", h)), True) - 1)
    )
    return (
        checked.groupBy("id", "template", "license")
        .agg(
            F.max("share").alias("containment"),
            F.count(F.lit(1)).alias("n_windows"),
            F.min("first").cast("long").alias("first_word"),
        )
        .withColumnRenamed("id", id_col)
    )


def without(docs: DataFrame, licenses: Sequence[str], *, id_col: str = "doc_id", **settings) -> DataFrame:
    """``docs`` without those that carry one of the licenses; rows with a null id stay."""
    flag = fresh(docs, "license_id")
    bad = scan(docs, id_col=id_col, **settings).where(F.col("license").isin(list(licenses))).select(F.col(id_col).alias(flag)).distinct()
    return docs.join(bad, F.col(id_col) == F.col(flag), "left_anti")

"""License scans: MinHash bands over overlapping windows, verified by shingle containment.

Built-in functions only. Tokens are lower-cased runs of letters and digits; shingles are SHINGLE tokens.
Every template of m distinct-or-not shingles gives windows of m shingles that start every m / 8 shingles
(at least every one). A window that holds CONTAINED of a template at the best start has a Jaccard
similarity of at least (c m - m / 16) / (2 m - (c m - m / 16)), 0.58 at c = 0.8; with BANDS bands of one
MinHash the chance to miss it is below 0.42 ** BANDS, 3e-5 for 12, and a text that repeats the template
word for word is never missed where windows start at every shingle. Templates are a short fixed list,
which bounds what is broadcast. Windows that share a band with a template are verified: the share of the
template's distinct shingles in the window, widened by one step on either side.

Bands are looked up inside the row of the document, in arrays of the templates' values; only a window that
hits becomes a row and carries its hashes.

Windows are formed only around guard words: tokens chosen so that over 1 - CONTAINED of every template's
shingles hold one. Any window that contains CONTAINED of a template then holds a guard word, so this
skips no match; the choice is proven in guards().

Defined cases: null text has no tokens; texts with fewer tokens than a shingle match nothing; a license
found several times in a document is one row, with its best containment and first place; rows that repeat
an id and text, null ids too, are one document, other rows are documents of their own, whatever their ids;
of licenses that match from the same place, as notices that differ in a version do, all are reported and
`best` marks the one of the highest containment (of these the longest, then the first by name); no match, no
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.llm.common import let

SHINGLE, CONTAINED, BANDS = 5, 0.8, 12
MOST_TEMPLATES = 2000

#: The notices by which public licenses ask to be applied.
TEMPLATES = {
    "GPL-3.0 (notice)": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0 (notice)": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0 (notice)": "This work is licensed under the GNU Lesser General Public License, version 3",
    "AGPL-3.0 (notice)": "This work is licensed under the GNU Affero General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "MIT (notice)": "Released under the MIT License",
    "Apache-2.0 (notice)": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
    'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "MIT (warranty)": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.",
    "BSD (warranty)": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
    "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
    "subject to the following restrictions",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this '
    'license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit '
    "third-parties to whom the Software is furnished to do so",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
    "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
    "Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
    "Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
}


def tokens_of(text: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+|_", text.lower()) if t]


def shingles_of(tokens: list[str]) -> list[tuple[str, ...]]:
    return [tuple(tokens[i : i + SHINGLE]) for i in range(len(tokens) - SHINGLE + 1)]


def guards(templates: dict[str, str]) -> list[str]:
    """Few tokens, of six letters or more where there are any, such that over 1 - CONTAINED of the shingles of every template hold one."""
    chosen: set[str] = set()
    left = {name: shingles_of(tokens_of(text)) for name, text in templates.items()}
    if any(not s for s in left.values()):
        raise ValueError("a template needs as many tokens as a shingle")

    def short(name):
        return sum(not chosen & set(s) for s in left[name]) >= CONTAINED * len(left[name])

    while open_ := [n for n in left if short(n)]:
        open_tokens = {t for n in open_ for s in left[n] if not chosen & set(s) for t in s}
        votes = {t: (sum(any(t in s for s in left[n]) for n in open_), len(t), t) for t in {t for t in open_tokens if len(t) > 5} or open_tokens}
        chosen.add(max(votes, key=votes.get))
    return sorted(chosen)


def shingle_hashes(tokens: Column) -> Column:
    return let(tokens, lambda t: F.when(F.size(t) < SHINGLE, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(t) - SHINGLE), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(SHINGLE)]))))


def minhashes(hashes: Column) -> list[Column]:
    """For each band the hashes under that band's function; a window's MinHash is the least of its slice."""

    def under(band: int) -> Column:
        return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band)))

    return [under(b) for b in range(BANDS)]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, license, containment (share of the template's shingles), first_token, n_windows and best of every match."""
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"at most {MOST_TEMPLATES} templates are looked up in a row")
    spark = docs.sparkSession
    guard = guards(templates)
    rows = [(name, tokens_of(text), len(tokens_of(text)) - SHINGLE + 1) for name, text in templates.items()]
    known = spark.createDataFrame(rows, "license string, tokens array<string>, m int").withColumn("h", shingle_hashes(F.col("tokens")))
    known = known.select("license", "m", F.array_distinct("h").alias("wanted"), F.array(*[F.array_min(x) for x in minhashes(F.col("h"))]).alias("bands"))
    # the values of every band and size: at most MOST_TEMPLATES * BANDS numbers
    values: dict[int, set] = {}
    for r in known.select("m", "bands").collect():
        values.setdefault(r.m, set()).update(enumerate(r.bands))
    sought = F.create_map(*[x for m, found in sorted(values.items()) for x in (F.lit(m), F.array(*[F.array(*[F.lit(v).cast("long") for b, v in sorted(found) if b == band]) for band in range(BANDS)]))])

    lower = F.lower(F.col(text_col))
    any_guard = F.lit(False)
    for word in guard:
        any_guard |= F.contains(lower, F.lit(word))
    near = docs.filter(any_guard).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("of"), F.regexp_extract_all(lower, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)).alias("t"))
    near = near.select("doc_id", "of", shingle_hashes(F.col("t")).alias("h"), F.filter(F.transform("t", lambda w, i: F.when(w.isin(guard), i)), lambda i: i.isNotNull()).alias("at")).filter((F.size("h") > 0) & (F.size("at") > 0))
    near = near.withColumn("g", F.array(*minhashes(F.col("h"))))
    # a row a document and template size; documents with a guard word only
    sized = near.select("*", F.explode(F.lit(sorted(values))).alias("m")).withColumn("step", F.greatest(F.lit(1), F.floor(F.col("m") / 8)).cast("int")).withColumn("sought", F.element_at(sought, F.col("m")))
    # starts of the windows that hold a guard word, on the grid of steps
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: grid(p, F.col("m"), F.col("step"), F.greatest(F.lit(0), F.size("h") - F.col("m"))))))

    def hit(s: Column) -> Column:
        least = [F.array_min(F.slice(F.get("g", b), s + 1, F.col("m"))) for b in range(BANDS)]
        out = F.lit(False)
        for b, value in enumerate(least):
            out |= F.array_contains(F.get("sought", b), value)
        return out

    windows = sized.withColumn("s", F.explode(F.filter(starts, hit)))
    begin = F.greatest(F.lit(0), F.col("s") - F.col("step"))
    wide = F.slice("h", begin + 1, F.col("m") + F.col("step") + F.col("s") - begin)
    hits = windows.select("doc_id", "of", "m", "s", begin.alias("begin"), wide.alias("wide")).join(F.broadcast(known.select("license", "m", "wanted")), "m")
    share = F.size(F.array_intersect("wanted", "wide")) / F.size("wanted")
    place = F.col("begin") + F.get(F.filter(F.transform("wide", lambda h, i: F.when(F.array_contains("wanted", h), i)), lambda i: i.isNotNull()), 0)
    hits = hits.withColumn("containment", share).filter(F.col("containment") >= CONTAINED).select("doc_id", "of", "license", "m", "s", "containment", place.alias("first_token"))
    found = hits.groupBy("doc_id", "of", "license").agg(F.max("containment").alias("containment"), F.min("first_token").alias("first_token"), F.count_distinct("s").alias("n_windows"), F.first("m").alias("m"))
    # a document has at most a row a template
    by = Window.partitionBy("doc_id", "of", "first_token").orderBy(F.col("containment").desc(), F.col("m").desc(), "license")
    return found.select("doc_id", "license", "containment", "first_token", "n_windows", (F.row_number().over(by) == 1).alias("best"))


def grid(p: Column, m: Column, step: Column, last: Column) -> Column:
    """Starts, multiples of step, of windows of m shingles that hold a shingle with token p."""
    low = F.ceil(F.greatest(F.lit(0), p - (SHINGLE - 1) - m + 1) / step).cast("int")
    high = F.floor(F.least(p, last) / step).cast("int")
    return F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), lambda k: k * step)).otherwise(F.array().cast("array<int>"))

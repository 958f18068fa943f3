"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

DataFrame functions only.  A text's words (lower case, without punctuation) give its
shingles of five words.  Windows of :data:`WINDOW` shingles start every :data:`STRIDE`;
templates are cut into pieces of at most :data:`PIECE` shingles, so that a piece lies
whole in a window (two, mostly).  Bands have one row: a window and a piece with Jaccard
similarity ``j`` collide in one of ``b`` bands with probability ``1 - (1 - j) ** b``.
The least ``j`` of a true match is 1 / WINDOW, from a template of one shingle:
``1 - (7/8) ** 96 = 0.999997`` for one window.  Mostly two hold it, but they share shingles
and hashes, so they aren't independent; one in a text's first shingles has one window.
A longer template collides with more pieces and windows.

Two sets without a common element can't share a MinHash, so windows that hold no
template shingle at all are left out before any band is computed; that loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices and short licenses as licensors publish them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC-full": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause-full": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

WIDTH = 5
WINDOW, STRIDE, PIECE, BANDS = 8, 4, 4, 96
PUNCTUATION = ".,;:()[]{}\"'`<>/*#!?|"


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Array of 64-bit hashes of the text's shingles in order; empty if it has fewer words."""
    words = F.filter(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, ""), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.array(words), lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(*(F.element_at(w, (i + j).cast("int")) for j in range(width))))).otherwise(F.array().cast("array<bigint>")))[0]


def _banded(rows: DataFrame, sets: str) -> DataFrame:
    """A row for each set of an array column of sets and each band, with band and low.

    A set has :data:`WINDOW` shingles, repeated ones among them.  Bands are rows, so that
    their hashes are generated code.
    """
    others = [c for c in rows.columns if c != sets]
    each = rows.select(*others, F.explode(sets).alias("set"))
    each = each.select(*others, "set", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    return each.select(*others, "band", F.least(*(F.xxhash64(F.col("set")[i], "band") for i in range(WINDOW))).alias("low"))


def _filled(shingles: Column) -> Column:
    """A set as :data:`WINDOW` shingles, the first of them repeated as often as others lack."""
    return F.concat(shingles, F.array_repeat(shingles[0], F.lit(WINDOW) - F.size(shingles)))


def templates(spark: SparkSession, texts: dict[str, str] | DataFrame = TEMPLATES) -> DataFrame:
    """(license, shingles, pieces): a bounded table, one row for each template."""
    df = texts.select("license", "template") if isinstance(texts, DataFrame) else spark.createDataFrame(sorted(texts.items()), "license string, template string")
    df = df.select("license", F.array_distinct(shingle_hashes(F.col("template"))).alias("shingles"))
    return df.where(F.size("shingles") > 0).withColumn("pieces", F.transform(F.sequence(F.lit(0), F.floor((F.size("shingles") - 1) / PIECE).cast("int")), lambda p: _filled(F.slice("shingles", p * PIECE + 1, F.lit(PIECE)))))


def license_scan(docs: DataFrame, notices: dict[str, str] | DataFrame = TEMPLATES, percent: int = 75) -> DataFrame:
    """Templates of which a place in a text holds at least ``percent`` of the shingles.

    Takes doc_id and text, other columns are ignored; ``notices`` may be a table (license,
    template), of which the driver holds the shingles' hashes.  Returns doc_id, license,
    containment (the best of the text's places, 0..1) and first_shingle (where the first
    such place starts, counted in shingles from 0), one row for each doc_id and license;
    repeated rows fold together.  Null, empty and short texts (under five words) match
    nothing; a null doc_id is an id like others.  No input rows or no templates, no output
    rows.  The work grows with a text's length, however much of it is licenses.
    """
    spark = docs.sparkSession
    known = templates(spark, notices).collect()  # bounded by the templates given
    if not known:
        return docs.select(F.col("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_shingle")).limit(0)
    any_of = sorted({x for t in known for x in t.shingles})
    spread = max(WINDOW, *(len(t.shingles) for t in known))
    wanted = spark.createDataFrame([(i, t.license, t.shingles) for i, t in enumerate(known)], "notice int, license string, wanted array<bigint>")
    pieces = spark.createDataFrame([(i, t.pieces) for i, t in enumerate(known)], "notice int, pieces array<array<bigint>>")
    index = _banded(pieces, "pieces").distinct().toDF("notice", "own_band", "own_low")

    # A hash set's lookups, which don't grow with the templates.
    holds = lambda shingles: F.exists(shingles, lambda x: x.isin(any_of))
    held = docs.select(F.col("doc_id"), shingle_hashes(F.col("text").cast("string")).alias("shingles")).where(holds("shingles"))
    # Texts are cut into regions that overlap by the longest template on either side; the
    # windows that start in a region's middle are its own, and carry it instead of the text.
    middles = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("shingles") - 1), F.lit(spread))
    begin = lambda m: F.greatest(F.lit(0), m - spread)
    cut = F.transform(middles, lambda m: F.struct(m.alias("middle"), begin(m).alias("place"), F.slice("shingles", begin(m) + 1, m - begin(m) + 2 * spread + WINDOW).alias("region")))
    # Regions without any template shingle go before they become rows.
    regions = held.select("doc_id", F.size("shingles").alias("n"), F.explode(F.filter(cut, lambda r: holds(r["region"]))).alias("r")).select("doc_id", "n", "r.middle", "r.place", "r.region")
    last = F.least(F.col("middle") + spread - 1, F.greatest(F.lit(0), F.col("n") - STRIDE))
    first = F.ceil(F.col("middle") / STRIDE).cast("int") * STRIDE
    starts = F.when(first <= last, F.sequence(first, last, F.lit(STRIDE))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda start: F.slice("region", start - F.col("place") + 1, F.lit(WINDOW)))
    regions = regions.withColumn("windows", F.transform(F.filter(windows, holds), _filled)).where(F.size("windows") > 0)
    # The index holds BANDS rows for each piece of the given templates: a proven bound.
    hits = _banded(regions.select("doc_id", "place", "region", "windows"), "windows").join(F.broadcast(index), (F.col("band") == F.col("own_band")) & (F.col("low") == F.col("own_low")))
    # However many bands met, a region is held against a template once.
    once = hits.select("doc_id", "place", "region", "notice").distinct().join(F.broadcast(wanted), "notice")
    common = F.size(F.array_intersect("wanted", "region"))
    at = F.col("place") - 1 + F.array_position(F.transform("region", lambda x: F.array_contains("wanted", x)), True)
    checked = once.withColumn("common", common).where(F.col("common") * 100 >= F.size("wanted") * percent)
    return checked.groupBy("doc_id", "license").agg(F.max(F.col("common") / F.size("wanted")).alias("containment"), F.min(at).cast("int").alias("first_shingle"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))

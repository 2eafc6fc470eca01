"""Licence scans: canonical digest lookup.

A text is brought into canonical form - lower case, punctuation and white
space as one space, copyright lines left out, equivalent spellings made one -
and the SHA-256 of the whole form is looked up among the digests of known
licences with a hash join. Two kinds of unit are looked up: the entire
document (a licence file) and each entire line (a licence notice).

The known licences are an argument (license_id, text); each is looked up with
and without its first line, as many copies leave out the title. The join is a
broadcast one, so their number is checked against ``MOST_KNOWN``; a longer list
is joined by Spark's own choice.

Null or empty text, and text of nothing but punctuation and copyright lines,
has no digest and matches nothing. Equal rows get equal results; other columns
are not read. Of several licences with one digest the smallest id is reported.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirage.llm.common import text_of

MOST_KNOWN = 10_000

# Equivalent spellings, from the published matching guidelines
# for licence lists; the left form becomes the right one.
EQUIVALENT = [
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("noncommercial", "non commercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

# Licence texts and notices as published.
KNOWN = [
    ("MIT", """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]


def _listed() -> list[tuple[str, str]]:
    """Full texts of ``known_licenses.json``, and its notices: each opening
    with each name of a licence, and the licence's SPDX line."""
    listed = json.loads(Path(__file__).with_name("known_licenses.json").read_text("utf-8"))
    notices = [(i, f"{opening} {name}.") for i, names in listed["names"].items() for name in names for opening in listed["openings"]]
    spdx = [(i, f"SPDX-License-Identifier: {i}") for i in listed["names"]]
    return [(i, t) for i, t in listed["texts"]] + notices + spdx


KNOWN += _listed()

#: Everything that becomes a space: ASCII control characters and punctuation,
#: general punctuation, and a few Latin-1 signs. Line feeds part the lines.
MARKS = r"[\x00-\x09\x0B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\x{A0}-\x{A8}\x{AB}-\x{B1}\x{B4}\x{B6}-\x{B8}\x{BB}\x{BF}\x{2000}-\x{206F}]+"
#: A canonical line that is a copyright notice, not part of the licence.
COPYRIGHT = (r"^ ?(portions )?((copyright c|c copyright) .*|copyright c|(copyright|c) (year|yyyy|by|[0-9]{4})( .*)?"
             r"|all rights reserved) ?$")
#: One pass finds every spelling to replace (the longest first).
SPELLING = r"\b(" + "|".join(sorted((a for a, _ in EQUIVALENT), key=lambda a: (-len(a), a))) + r")\b"


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, without empty and copyright lines."""
    t = F.regexp_replace(F.regexp_replace(F.lower(text), "©|\\(c\\)", " c "), MARKS, " ")
    spelt = t
    for a, b in EQUIVALENT:
        spelt = F.regexp_replace(spelt, rf"\b{a}\b", b)
    t = F.when(F.regexp_like(t, F.lit(SPELLING)), spelt).otherwise(t)
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(x))
    return F.filter(lines, lambda x: (x != "") & ~F.regexp_like(x, F.lit(COPYRIGHT)))


def digest(lines: Column) -> Column:
    """SHA-256 of canonical lines as one text; null without lines."""
    return F.when(F.size(lines) > 0, F.sha2(F.array_join(lines, " "), 256))


def known_digests(known: DataFrame) -> DataFrame:
    """digest, license_id of ``known`` (license_id, text), with and without
    the first line."""
    lines = known.select("license_id", canonical_lines(text_of()).alias("lines"))
    both = lines.select("license_id", F.explode(F.array("lines", F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))))).alias("lines"))
    return (both.select("license_id", digest(F.col("lines")).alias("digest")).where("digest is not null")
            .groupBy("digest").agg(F.min("license_id").alias("license_id")))


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_digest (of the
    entire canonical text), license_id (of the entire text, or null), notices
    (sorted distinct licences of entire lines), n_notices (lines that match)."""
    table = known_digests(known)
    if known.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN:
        table = F.broadcast(table)
    rows = docs.select("doc_id", canonical_lines(text_of()).alias("lines"))
    rows = rows.select("doc_id", digest(F.col("lines")).alias("text_digest"),
                       F.transform("lines", lambda x: F.sha2(x, 256)).alias("lines"))
    rows = rows.withColumn("row", F.xxhash64("lines"))
    units = rows.select("doc_id", "text_digest", "row", F.posexplode_outer(F.concat(F.array(F.col("text_digest")), "lines")).alias("unit", "digest"))
    hits = units.join(table, "digest", "left")
    # Rows of one document come from one task, so this combines before the shuffle.
    line = F.when(F.col("unit") > 0, F.col("license_id"))
    return (hits.groupBy("doc_id", "text_digest", "row")
            .agg(F.min(F.when(F.col("unit") == 0, F.col("license_id"))).alias("license_id"),
                 F.sort_array(F.collect_set(line)).alias("notices"), F.count(line).alias("n_notices"),
                 F.count(F.when(F.col("unit") == 0, 1)).alias("_copies"))
            .select("doc_id", "text_digest", "license_id", "notices", (F.col("n_notices") / F.col("_copies")).cast("long").alias("n_notices"),
                    F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_k")).drop("_k"))


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "license_id string, text string")

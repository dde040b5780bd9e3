"""Licence scans by canonical digest lookup.

A text is brought to a canonical form: lower case, copyright notices dropped,
everything but letters and digits a single space, equivalent spellings made
one. The SHA-256 of the canonical form is looked up among the digests of
known licence texts by a hash join, for entire texts: the whole document,
each of its paragraphs (between blank lines), and each of its lines.

Canonical forms are column expressions in one pass over the documents. The
known digests are broadcast when they are few (``BROADCAST_ROWS``, counted
first) and joined by a shuffle of the documents' digests otherwise.

Defined cases: null and empty texts, and units without letters or digits,
match nothing (an empty licence text is ignored); a licence that occurs n
times as a line or paragraph counts n; rows with the same key add up; a
document that is one paragraph or line reports all of its units; two known
licences with one canonical form are both reported; empty tables give empty
results; only the named columns are read, so further ones cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted

BROADCAST_ROWS = 200_000

#: Spellings that count as one (the first becomes the second).
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "noncommercial": "nc",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "v2": "version 2",
    "v3": "version 3",
    "whilst": "while",
    "wilful": "willful",
}

#: Fixed value: how the two-clause and three-clause texts end.
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Licence texts and notices known from the start; ``known_licenses`` adds a table of whole texts.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

""" + _BSD_END),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.

""" + _BSD_END),
]

#: A line that begins with a sign, or with the word and then a sign, a year, a colon or "by". A
#: sentence that is wrapped before "copyright notice" stays.
COPYRIGHT_LINE = "(^|\\n)[ \\t]*(\\(c\\)|©|copyright[ \\t]*(\\(c\\)|©|:|by[ \\t]|[12][0-9][0-9][0-9]|<|\\[))[^\\n]*"


def known_licenses(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """The built-in texts and those of a table (``license_id``, ``text``: whole
    licences, any number; an id may have several texts)."""
    own = spark.createDataFrame(KNOWN, "license_id string, text string")
    return own if texts is None else own.unionByName(texts.select("license_id", "text"))


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line of a text (blank lines are empty)."""
    spelled = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    t = F.regexp_replace(t, "[^\\p{L}\\p{N}\\n]+", " ")
    return F.transform(F.split(t, "\n"), lambda line: F.array_join(F.transform(
        F.filter(F.split(line, " "), lambda w: w != ""), lambda w: F.coalesce(spelled[w], w)), " "))


def _joined(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda x: x != ""), " ")


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def units(text: Column) -> Column:
    """array<struct<unit, canonical>>: the whole text, its paragraphs and lines."""
    lines = canonical_lines(text)
    named = lambda unit, c: F.struct(F.lit(unit).alias("unit"), c.alias("canonical"))
    # between lines stands "\n", so a blank line is seen as "\n\n"
    paragraphs = F.split(F.array_join(lines, "\n"), "\n\n+")
    both = F.concat(F.array(named("text", _joined(lines))),
                    F.transform(paragraphs, lambda p: named("paragraph", F.trim(F.translate(p, "\n", " ")))),
                    F.transform(lines, lambda x: named("line", x)))
    return F.filter(both, lambda u: u["canonical"] != "")


def scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, license_id, unit ('text', 'paragraph' or 'line') and n (occurrences)."""
    digests = known.select("license_id", digest(_joined(canonical_lines(known["text"]))).alias("digest"),
                           _joined(canonical_lines(known["text"])).alias("c")) \
        .filter("c <> '' and license_id is not null").select("license_id", "digest").distinct()
    found = docs.select(quoted(key).alias("key"), F.explode(units(quoted(text))).alias("u")) \
        .select("key", "u.unit", digest(F.col("u.canonical")).alias("digest"))
    if known.count() <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    return found.join(digests, "digest").groupBy("key", "license_id", "unit").agg(F.count(F.lit(1)).alias("n")) \
        .select(F.col("key").alias(key), "license_id", "unit", "n")

"""Licence texts and notices found by the digest of their canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import durable, row_key
from .license_texts import TEXTS

#: Known texts up to this number are broadcast (32-byte digests, so under 10 MB), else joined by a shuffle.
BROADCAST_ROWS = 100_000

# Public licence texts and the usual one-line notices.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
        ' files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,'
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission"
        " notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\","
        " WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS"
        " FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,"
        " DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION"
        " WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED"
        ' "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF'
        " MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL"
        " DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,"
        " NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)
# Spellings taken as one.
EQUIVALENT = (("licence", "license"), ("organis", "organiz"), ("behaviour", "behavior"), ("favour", "favor"), ("acknowledgement", "acknowledgment"), ("non commercial", "noncommercial"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The form that the SQL of the query uses; NOTICE_LINE keeps the sentences that it takes for copyright lines.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|spdx-filecopyrighttext)[^\n]*"
# Lines that begin like a copyright line but belong to a licence's sentences hold one of these words.
_SENTENCE = (
    r"notices?|holders?|owners?|licen[sc]e[sd]?|licensors?|permission|must|shall|may|you|your|conditions|disclaimer|liable|laws?|statements?|interests?"
    r"|this|any|that|these|to|is|are|treaty|work|software and"
)
_TITLE = r"(?:the )?(?:mit|expat|isc|zlib|(?:new |modified |simplified )?bsd|bsd [0-3][- ]clause|[0-3][- ]clause bsd)(?: \"[^\"\n]*\")? licen[sc]e(?: ?\([a-z0-9 -]+\))?[.:]?[ \t\r]*"
#: A copyright line (with the reservation of rights below it), or the title above a licence, in lower case.
NOTICE_LINE = (
    rf"(^|\n)[ \t]*(?:(?:copyright|\(c\)|\u00a9|spdx-filecopyrighttext)(?![^\n]*\b(?:{_SENTENCE})\b)[^\n]*(?:\n[ \t]*all rights reserved\.?[ \t\r]*(?=\n|$))?"
    rf"|{_TITLE}(?=\n\s*(?:copyright|\(c\)|\u00a9|permission|redistribution|this software)))"
)
SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def canonical(text: Column) -> Column:
    """Lower case, copyright and title lines gone, every run of signs and spaces one blank, one spelling for equivalent words."""
    low = F.translate(text, _UPPER, _LOWER)
    low = F.trim(F.regexp_replace(F.regexp_replace(low, NOTICE_LINE, "\n"), SIGNS, " "))
    for spelling, chosen in EQUIVALENT:
        low = F.replace(low, F.lit(spelling), F.lit(chosen))
    return low


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_texts(spark: SparkSession, known=KNOWN + TEXTS) -> DataFrame:
    return spark.createDataFrame(list(known), "license string, text string")


def scan(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: doc_id, digest, license, notices, n_notices.

    ``digest`` is that of the whole canonical text and ``license`` what it is known as; ``notices`` are the different
    licences whose whole text is a line, a paragraph or, over several paragraphs, a part of the document, and ``n_notices`` is their number.  A text without
    letters or digits, null too, has no digest.  Repeated rows are each answered, other columns ignored; a
    text known under several names takes the first.  Lines are looked up once per different line of a document.
    """
    blank = r"\n[ \t\r]*\n"
    forms = known.filter("text is not null").select("license", "text", canonical(F.col("text")).alias("form"))
    digests = forms.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license").alias("license"))
    digests = durable(digests)
    few = digests.count() <= BROADCAST_ROWS
    # A known text of several paragraphs is looked for where a document has any one of them.
    several = forms.filter(F.size(F.split("text", blank)) > 1)
    anchors = several.select("license", F.sha2("form", 256).alias("whole"), F.explode(F.split("text", blank)).alias("part"))
    anchors = durable(anchors.select("license", "whole", canonical(F.col("part")).alias("part")).filter("part <> ''").select("license", "whole", F.sha2("part", 256).alias("digest")).distinct())
    wanted = digests.join(anchors.select("digest", F.lit(True).alias("anchor")).distinct(), "digest", "full")
    wanted, digests = (F.broadcast(wanted), F.broadcast(digests)) if few else (wanted, digests)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", row_key())
    # A paragraph of one line is looked up as a line, and the only paragraph of a text as the whole.
    paragraphs, none = F.split("text", blank), F.array().cast(T.ArrayType(T.StringType()))
    longer = F.when(F.size(paragraphs) > 1, F.filter(paragraphs, lambda p: F.contains(p, F.lit("\n")))).otherwise(none)
    parts = F.array_distinct(F.concat(F.split("text", r"\n"), longer))
    found = durable(rows.select("key", F.explode(parts).alias("part")).select("key", digest(F.col("part")).alias("digest")).join(wanted, "digest"))
    named_parts = found.filter("license is not null").select("key", "license")
    hits = durable(found.filter("anchor").select("key", "digest").join(anchors, "digest").select("key", "license", "whole").distinct())
    keys = hits.select("key").distinct()
    held = keys.count()
    if held:
        marked = rows.join(F.broadcast(keys) if held <= BROADCAST_ROWS else keys, "key").select("key", canonical(F.col("text")).alias("text"))
        whole_forms = several.select(F.sha2("form", 256).alias("whole"), "form").distinct()
        inside = F.contains(F.concat(F.lit(" "), "text", F.lit(" ")), F.concat(F.lit(" "), "form", F.lit(" ")))
        named_parts = named_parts.unionByName(marked.join(hits, "key").join(whole_forms, "whole").filter(inside).select("key", "license"))
    notices = named_parts.groupBy("key").agg(F.array_sort(F.collect_set("license")).alias("notices"))
    form = F.nullif(canonical(F.col("text")), F.lit(""))
    whole = rows.select("key", "doc_id", F.sha2(form, 256).alias("digest"), (F.size(paragraphs) <= 1).alias("single"))
    named = whole.join(digests, "digest", "left").join(notices, "key", "left")
    own = F.when(F.col("single") & F.col("license").isNotNull(), F.array("license")).otherwise(none)
    names = F.array_sort(F.array_union(F.coalesce("notices", none), own))
    return named.select("doc_id", "digest", "license", F.concat_ws(",", names).alias("notices"), F.size(names).cast("long").alias("n_notices"))

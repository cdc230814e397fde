"""Licence scans by canonical digests.

A text is brought to a canonical form: A-Z lower-cased, copyright lines dropped, punctuation and white space as
single spaces, equivalent spellings as one. Its md5 is joined with those of known licence texts and notices. What
is looked up are entire texts: the document, its paragraphs (divided by empty lines) and its lines.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.work import LOWER, is_small, whole_text

# Public licence texts and notices.
MIT = """MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License

Copyright (c) <year> <copyright holders>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
ZLIB = """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
# British and other spellings, and the one they count as.
SPELLINGS = [
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"),
    ("sublicence", "sublicense"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("non infringement", "noninfringement"),
    ("noncommercial", "non commercial"), ("organisation", "organization"), ("authorised", "authorized"),
    ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("v", "version"), ("ver", "version"),
    ("creative commons", "cc"), ("sharealike", "sa"),
]


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of everything that is looked for."""
    texts = [("MIT", MIT), ("ISC", ISC), ("Zlib", ZLIB), ("Apache-2.0", APACHE_NOTICE)]
    names = [("MIT", "MIT License"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("Apache-2.0", "Apache License, Version 2.0"),
             ("Apache-2.0", "Apache License 2.0"), ("Unlicense", "Unlicense"), ("BSD-2-Clause", "BSD 2-Clause License"),
             ("BSD-3-Clause", "BSD 3-Clause License"), ("MPL-2.0", "Mozilla Public License, Version 2.0")]
    for family, long_ in (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"),
                          ("AGPL", "GNU Affero General Public License")):
        for version in ("2", "2.1", "3") if family == "LGPL" else ("2", "3") if family == "GPL" else ("3",):
            names += [(f"{family}-{version}", f"{long_}, version {version}"), (f"{family}-{version}", f"{long_} {version}"),
                      (f"{family}-{version}", f"{family} {version}")]
    for terms in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        names += [(f"CC-{terms}-{v}", f"CC {terms} {v}") for v in ("2.0", "2.5", "3.0", "4.0")]
    names.append(("CC0-1.0", "CC0 1.0"))
    frames = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under {}",
              "Distributed under the {}", "This work is licensed under {}", "This work is licensed under the {}",
              "Available under the {}", "License: {}", "SPDX-License-Identifier: {}"]
    texts += [(key, frame.format(name)) for key, name in names for frame in frames]
    texts += [(key, f"SPDX-License-Identifier: {key}") for key in dict.fromkeys(k for k, _ in names)]
    return texts


COPYRIGHT = r"(?im)^[\x20\x09]*(copyright|\(c\)|©)[^\x0A]*$"
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NOTHING = hashlib.md5(b"").hexdigest()
# The first word of a text, and what it means that a dropped copyright line can stand before the first word that
# is kept: the word begins such a line, or runs over an end of line that is not ASCII.
FIRST_WORD = r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
MAY_BE_DROPPED = "(?i)copyright|^c$|[\u00a9\u0085\u2028\u2029]"


def canonical(text: Column) -> Column:
    """The canonical form of an entire text."""
    lower = F.translate(F.regexp_replace(text, COPYRIGHT, ""), *LOWER)
    out = F.concat(F.lit(" "), F.regexp_replace(lower, PUNCTUATION, " "), F.lit(" "))
    for other, one in SPELLINGS:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {one} "))
    return F.trim(out)


def _one_for_all() -> dict[str, str]:
    """A common word for first words that spellings can turn into one another."""
    one: dict[str, str] = {}
    for pair in SPELLINGS:
        a, b = (one.get(w, w) for w in (t.split()[0] for t in pair))
        one = {w: b if to == a else to for w, to in one.items()} | {a: b}
    return one


def head(text: Column) -> Column:
    """The first word of a text, one word for all its spellings: texts of one canonical form have one head, or
    `""` where a dropped line may stand before the first word. Reads no further than that word."""
    word = F.regexp_extract(text, FIRST_WORD, 1)
    lower = F.translate(word, *LOWER)
    spelled = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in _one_for_all().items() for x in kv]), lower), lower)
    return F.when(word.rlike(MAY_BE_DROPPED), F.lit("")).otherwise(spelled)


def known(spark, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """`digest, licence, head` of known texts; of two licences with one text the first by name."""
    rows = spark.createDataFrame(texts if texts is not None else known_texts(), "licence string, text string")
    plain = rows.select("licence", canonical(F.col("text")).alias("t"))
    return plain.select("licence", F.md5("t").alias("digest"), head(F.col("t")).alias("head")).where(
        F.col("digest") != NOTHING).groupBy("digest", "head").agg(F.min("licence").alias("licence")).select("digest", "licence", "head")


def licence_hits(documents: DataFrame, licences: DataFrame) -> DataFrame:
    """`doc_id, licence, scope, n_units`: licences that a document is or holds.

    `licences` is `digest, licence`, and may have the `head` of the canonical texts: then only units with one of
    these heads, or the head `""`, are brought to canonical form. `n_units` counts the lines, paragraphs and whole text (each once where they are the
    same) with that digest, `scope` is the widest of them: text, paragraph or line. Empty units are none. One row per
    doc_id and licence; rows that repeat a doc_id, or have none, count together. Documents without a hit have no row.
    """
    text = whole_text()
    unit = lambda scope, t: F.struct(F.lit(scope).alias("scope"), t.alias("t"))
    lines = F.split(text, "\n")
    paragraphs = F.split(text, r"\n[\x20\x09\x0D]*\n")
    units = F.concat(
        F.array(unit("text", text)),
        F.when(F.size(paragraphs) > 1, F.transform(paragraphs, lambda t: unit("paragraph", t))).otherwise(F.array().cast("array<struct<scope:string,t:string>>")),
        F.when(F.size(lines) > 1, F.transform(lines, lambda t: unit("line", t))).otherwise(F.array().cast("array<struct<scope:string,t:string>>")))
    each = documents.select("doc_id", F.explode(units).alias("u")).select(
        "doc_id", F.col("u.scope").alias("scope"), F.col("u.t").alias("t"))
    if "head" in licences.columns:
        heads = licences.select("head").union(documents.sparkSession.createDataFrame([("",)], "head string")).distinct()
        each = each.withColumn("head", head(F.col("t")))
        each = each.join(F.broadcast(heads) if is_small(heads) else heads, "head", "left_semi")
    # never null: Spark would look for nulls, and make every canonical form, before the heads are compared
    each = each.select("doc_id", "scope", F.coalesce(F.md5(canonical(F.col("t"))), F.lit("")).alias("digest"))
    licences = licences.select("digest", "licence")
    table = F.broadcast(licences) if is_small(licences) else licences
    found = each.join(table, "digest")
    rank = {"text": 0, "paragraph": 1, "line": 2}
    order = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    return found.groupBy("doc_id", "licence").agg(
        F.min(F.struct(F.element_at(order, F.col("scope")).alias("r"), "scope"))["scope"].alias("scope"),
        F.count(F.lit(1)).alias("n_units"))

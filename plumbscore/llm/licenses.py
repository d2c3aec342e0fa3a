"""License scans by digest: canonical texts joined with the digests of known licences.

A text is put into lower case, lines that only state a copyright go, everything but letters
and digits becomes one space, and equivalent spellings become one. Digests of whole texts,
and of single lines for the usual notices, are joined by hash. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbscore.llm.registered import query, table, text_of
from plumbscore.session import materialize

# Equivalent spellings, each replaced by the second.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("copyright holder", "copyright owner"),
    ("copyright holders", "copyright owners"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("fulfil", "fulfill"),
    ("merchantibility", "merchantability"),
    ("non commercial", "noncommercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("sub license", "sublicense"),
    ("whilst", "while"),
    ("wilful", "willful"),
)

# Texts of known licences, as published, without their copyright lines.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
}

# Usual one-line notices and what they stand for.
NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This project is licensed under the MIT License.": "MIT",
    "SPDX-License-Identifier: MIT": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the Apache License, Version 2.0 (the \"License\").": "Apache-2.0",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This program is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "SPDX-License-Identifier: GPL-3.0-only": "GPL-3.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
}

# A line that begins with a copyright mark and a year, or with all rights reserved.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©]*(?:(?:©|\(c\)|copyright)[^\p{L}\p{N}\n]*(?:\(c\)|©|c )?[^\p{L}\p{N}\n]*[0-9]{4}|all rights reserved)[^\n]*$"
NOT_WORDS = r"[^\p{L}\p{N}]+"
# Titles that stand above a licence text.
TITLES = ("the mit license", "mit license", "the mit license mit", "isc license", "bsd 2 clause license", "zlib license", "bsd zero clause license")


def canonical(text: Column) -> Column:
    """The canonical form: words between single spaces, with a space at either end."""
    found = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    found = F.concat(F.lit(" "), F.btrim(F.regexp_replace(found, NOT_WORDS, " "), F.lit(" ")), F.lit(" "))
    for a, b in SPELLINGS:
        found = F.replace(found, F.lit(f" {a} "), F.lit(f" {b} "))
    return found


def canonical_text(text: str) -> str:
    """The same in Python, for the few known texts."""
    found = re.sub(r"(?m)^[^\w\n©]*(?:(?:©|\(c\)|copyright)[^\w\n]*(?:\(c\)|©|c )?[^\w\n]*[0-9]{4}|all rights reserved)[^\n]*$", "", text.lower())
    found = f" {re.sub(r'[\W_]+', ' ', found).strip()} "
    for a, b in SPELLINGS:
        found = found.replace(f" {a} ", f" {b} ")
    return found


def digest(canonical_form: Column) -> Column:
    """What is looked up."""
    return F.md5(canonical_form.cast("binary"))


def known_digests(texts: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> list[tuple[str, str, str]]:
    """``(digest, kind, license)`` of the known texts, also under their usual titles, and notices."""
    found = {}
    for name, text in (LICENSES if texts is None else texts).items():
        for title in ("", *TITLES):
            found[hashlib.md5(canonical_text(f"{title}\n{text}").encode()).hexdigest(), "text"] = name
    for text, name in (NOTICES if notices is None else notices).items():
        found[hashlib.md5(canonical_text(text).encode()).hexdigest(), "notice"] = name
    return [(d, kind, name) for (d, kind), name in sorted(found.items())]


def scan(docs: DataFrame, keep: list[str], text: str = "text", known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """``keep`` plus ``digest`` of the canonical whole text, ``license`` and ``notices``.

    ``license`` is the known licence or notice that the entire text is, else null. ``notices``
    has the licences that single lines stand for, in order and joined by commas, else null.
    Null texts count as empty, whose canonical form has no words and is nothing known.
    The list of known digests is a parameter in memory, so it can go to every task.
    """
    spark = docs.sparkSession
    rows = known_digests() if known is None else known
    lookup = spark.createDataFrame(rows, "digest string, kind string, name string")
    whole = lookup.groupBy("digest").agg(F.min("name").alias("license"))
    lines = lookup.where("kind = 'notice'").select(F.col("digest").alias("line_digest"), "name")
    own = docs.select(*keep, text_of(text).alias("__text"))
    marked = own.withColumn("digest", digest(canonical(F.col("__text")))).withColumn("__raw", F.md5(F.col("__text").cast("binary")))
    # Equal texts have equal notices, so what is found is kept once per text.
    cut = marked.select("__raw", F.explode(F.split("__text", "\n")).alias("__line")).where("__line <> ''")
    hits = cut.select("__raw", digest(canonical(F.col("__line"))).alias("line_digest")).join(F.broadcast(lines), "line_digest")
    named = materialize(hits.groupBy("__raw").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("notices")), "notices")
    found = marked.drop("__text").join(F.broadcast(whole), "digest", "left").join(named, "__raw", "left")
    return found.select(*keep, "digest", "license", "notices")


def _sql_canonical(text: str) -> str:
    line = COPYRIGHT_LINE.removeprefix("(?m)").replace("'", "''")
    found = f"regexp_replace(lower({text}), '(?m){line}', '', 'g')"
    found = f"(' ' || trim(regexp_replace({found}, '{NOT_WORDS}', ' ', 'g')) || ' ')"
    for a, b in SPELLINGS:
        found = f"replace({found}, ' {a} ', ' {b} ')"
    return found


def _oracle() -> str:
    rows = ", ".join(f"('{d}', '{kind}', '{name}')" for d, kind, name in known_digests())
    return f"""
WITH known(digest, kind, name) AS (VALUES {rows}),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
whole AS (SELECT doc_id, text, md5({_sql_canonical('text')}) AS digest FROM docs),
lines AS (SELECT DISTINCT text, unnest(string_split(text, chr(10))) AS line FROM docs),
hits AS (
  SELECT text, string_agg(DISTINCT name, ',' ORDER BY name) AS notices
  FROM lines JOIN known ON kind = 'notice' AND digest = md5({_sql_canonical('line')}) GROUP BY text
)
SELECT doc_id, whole.digest, license, notices
FROM whole LEFT JOIN (SELECT digest, min(name) AS license FROM known GROUP BY digest) AS k ON k.digest = whole.digest LEFT JOIN hits USING (text)
"""


@query("op4_license_scan", _oracle())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the licence that it is and those it mentions."""
    return scan(table(spark, folder, "documents"), ["doc_id"])

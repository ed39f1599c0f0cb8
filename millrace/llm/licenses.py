"""Licence scans by canonical digests.

Texts become canonical: lower case, no title lines, no copyright notices, one
spelling for equivalent ones, punctuation and white space as single spaces. The
digest of the whole text is hash-joined to the digests of known licences. In
passing, licences inside longer texts are looked up, too: notices by every line and
every block between empty lines, taken whole, if it is as long as a known one;
full licences wherever their opening words stand, by the digest of as many
characters from there on as the licence has, however its lines are wrapped. The known licences are
a fixed list, which bounds what is broadcast.

A copyright notice is a line that begins with "copyright", "(c)" or the sign and
has a year, "(c)", the sign or "by", or "all rights reserved" alone; where more
sentences follow that name a licence, only its own sentence goes. "copyright
notice ..." at the start of a wrapped line is no notice. A title, as "MIT
License", goes where it is the first line or follows an empty one.

Result: doc_id, text_digest (sha256 of the canonical whole text), whole_licence
(null if the whole text is none), licences (all found, sorted and joined by
commas) and n_licences. A row for each row of the input.

Defined results: a null text counts as empty, is no licence and has the digest
of the empty string. Of the places where an opening stands, those after which the
whole licence follows before the opening stands again are looked up. Repeated
rows are scanned each on its own. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, sha256, texts

#: Spellings that count as one.
SPELLINGS = {
    "licence": "license",
    "licenced": "licensed",
    "sub-license": "sublicense",
    "sub license": "sublicense",
    "acknowledgement": "acknowledgment",
    "non-commercial": "noncommercial",
    "favour": "favor",
    "fulfilment": "fulfillment",
    "honour": "honor",
    "judgement": "judgment",
    "organisation": "organization",
    "per cent": "percent",
    "programme": "program",
    "https:": "http:",
    "copyright owner": "copyright holder",
    "©": "(c)",
    "&": "and",
}
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Notices and licences with their names.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>"),
    ("BSD-2-Clause", f"{_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD_START} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]
#: Long licences by name, opening of the canonical text, its length and its digest.
LONG: list[tuple[str, str, int, str]] = [
    ("Apache-2.0", "apache license version 2 0 january 2004 http www apache org ", 9866, "84ed161685d232dab5187a7a7101279668d583e8fcead2d41433e4fd4a1dbe68"),
    ("CC0-1.0", "creative commons legal code cc0 1 0 universal creative commo", 6692, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GPL-1.0", "gnu general public license version 1 february 1989 51 frankl", 11763, "98db0b473e0a45a62b04a39b6b864b4e079a58d513e2196f94fe7252fa8574a6"),
    ("GPL-2.0", "gnu general public license version 2 june 1991 51 franklin s", 17115, "e95eb1718f9f373d56cc586a5f7d1bfa11668867f6e85e982d2b6108b97d90a1"),
    ("GPL-3.0", "gnu general public license version 3 29 june 2007 everyone i", 33404, "5e06bcb7b8c914d3ffb433229937b503a624ae6c7bb9ac1cad01e35a324bcb6d"),
    ("LGPL-2.0", "gnu library general public license version 2 june 1991 51 fr", 24066, "ca88a167d481bc99831aab1ae52903c7b926ac8e49bd138ceb9213fd167eda81"),
    ("LGPL-2.1", "gnu lesser general public license version 2 1 february 1999 ", 25153, "ede2b00a7c3823a62ef837da1b2e848d4151187ba307a2f23aebaeebbc80bf7c"),
    ("LGPL-3.0", "gnu lesser general public license version 3 29 june 2007 eve", 7104, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "mozilla public license version 1 1 1 definitions 1 0 1 comme", 22319, "fcb579371133afd771fed87cd5d8c6dc5648746c9945d4adf08ec5c79aba5c61"),
    ("MPL-2.0", "mozilla public license version 2 0 1 definitions 1 1 contrib", 14272, "9e79a7d513376f6fa1500e4df4f6276c6e7e61c5c3e28dcdb1acee24033acc56"),
    ("GFDL-1.2", "gnu free documentation license version 1 2 november 2002 51 ", 19578, "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "gnu free documentation license version 1 3 3 november 2008 h", 22013, "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("Artistic-1.0", "the artistic license preamble the intent of this document is", 5833, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
]
#: Java and RE2 read these alike, but for how they name a group in the replacement.
_NOTICE = r"(?:copyright|\(c\)|©)[^\n]{0,40}?(?:\(c\)|©|\bby\b|[0-9]{4})"
SENTENCE = rf"(?m)^[^\p{{L}}\p{{N}}\n]*{_NOTICE}[^\n.]*\.[\x20]+([^\n]*licen[cs]e[^\n]*)$"
COPYRIGHT_LINE = rf"(?m)^[^\p{{L}}\p{{N}}\n]*(?:{_NOTICE}[^\n]*|(?:\(c\)|©)[^\n]*|all\x20rights\x20reserved[^\p{{L}}\p{{N}}\n]*)$"
TITLE_LINE = r"(\A|\n[\x20\t]*\n)[^\p{L}\p{N}\n]*(?:the\x20)?(?:mit|isc|zlib|bsd|(?:new|simplified|revised|modified)\x20bsd|bsd[\x20-][0-9][\x20-]clause|[0-9][\x20-]clause\x20bsd)(?:\x20licen[cs]e)(?:\x20\([^\n()]{1,40}\))?[^\p{L}\p{N}\n]*(\n|\z)"
MARKS = r"[^\p{L}\p{N}\n]+"
#: Characters of a full licence's opening; entries of at least LEAST characters are looked for wherever it stands.
OPENING, LEAST = 60, 400


def _lines(text: Column) -> Column:
    """The canonical text, its lines still apart."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), SENTENCE, "$1"), COPYRIGHT_LINE, ""), TITLE_LINE, "$1$2")
    for a, b in SPELLINGS.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(out, MARKS, " "), " *\n *", "\n")


def _whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "\n+", " "))


def known(spark: SparkSession, entries: list[tuple[str, str]] = KNOWN, long: list[tuple[str, str, int, str]] = LONG) -> DataFrame:
    """licence, digest, length and opening of the known licences, made canonical by the same expressions."""
    of = spark.createDataFrame(entries, "licence string, text string").select("licence", _whole(_lines(F.col("text"))).alias("t"))
    short = of.groupBy(sha256(F.col("t")).alias("digest")).agg(F.min("licence").alias("licence"), F.max(F.length("t")).cast("int").alias("length"), F.max(F.substring("t", 1, OPENING)).alias("opening"))
    if not long:
        return short
    return short.unionByName(spark.createDataFrame(long, "licence string, opening string, length int, digest string"))


def _reach(opening: str, length: int) -> Callable[[Column], Column]:
    """As many characters from an opening on as a licence has, from what follows it."""
    return lambda after: F.concat(F.lit(opening), F.substring(after, 1, length - len(opening)))


def scan(docs: DataFrame, entries: list[tuple[str, str]] = KNOWN, long: list[tuple[str, str, int, str]] = LONG) -> DataFrame:
    spark = docs.sparkSession
    table = known(spark, entries, long)
    found = table.collect()  # as many as the fixed list has
    names = F.create_map(*[F.lit(x) for r in found for x in (r["digest"], r["licence"])])
    lengths = [F.lit(r["length"]) for r in found if r["length"] < LEAST]
    full = defaultdict(set)
    for r in found:
        if r["length"] >= LEAST:
            full[r["opening"]].add(r["length"])
    rows = texts(docs).select("doc_id", _lines(F.col("text")).alias("lines")).withColumn("whole", _whole(F.col("lines")))
    units = F.concat(F.split("lines", "\n"), F.transform(F.split("lines", "\n{2,}"), _whole))
    hits = F.transform(F.filter(F.transform(units, lambda u: F.trim(u)), lambda u: F.length(u).isin(lengths)), lambda u: F.try_element_at(names, sha256(u)))
    for opening, sizes in sorted(full.items()):
        after = F.slice(F.split("whole", opening), 2, 2**30)  # what follows each place of the opening, which has letters, digits and spaces alone
        looked = [F.transform(F.transform(after, _reach(opening, n)), lambda t: F.try_element_at(names, sha256(t))) for n in sorted(sizes)]
        hits = F.concat(hits, F.when(F.col("whole").contains(opening), F.concat(*looked)).otherwise(F.array().cast("array<string>")))
    rows = rows.select("doc_id", sha256(F.col("whole")).alias("text_digest"), hits.alias("hits"))
    whole = F.broadcast(table.select("digest", F.col("licence").alias("whole_licence")))
    out = rows.join(whole, F.col("text_digest") == F.col("digest"), "left")
    all_ = F.array_sort(F.array_distinct(F.array_compact(F.concat("hits", F.array("whole_licence")))))
    return out.withColumn("all", all_).select("doc_id", "text_digest", "whole_licence", F.array_join("all", ",").alias("licences"), F.size("all").cast("long").alias("n_licences"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


def _sql() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    lines = f"regexp_replace(lower(coalesce(text, '')), {quoted(SENTENCE)}, '\\1', 'g')"
    lines = f"regexp_replace(regexp_replace({lines}, {quoted(COPYRIGHT_LINE)}, '', 'g'), {quoted(TITLE_LINE)}, '\\1\\2', 'g')"
    for a, b in SPELLINGS.items():
        lines = f"replace({lines}, {quoted(a)}, {quoted(b)})"
    lines = f"regexp_replace(regexp_replace({lines}, {quoted(MARKS)}, ' ', 'g'), ' *\\n *', chr(10), 'g')"
    values = ", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in KNOWN)
    longer = ", ".join(f"({quoted(n)}, {quoted(o)}, {m}, {quoted(d)})" for n, o, m, d in LONG)
    whole = r"trim(regexp_replace({}, '\n+', ' ', 'g'))"
    return rf"""
WITH entries(licence, text) AS (VALUES {values}),
short AS (SELECT licence, {whole.format('l')} AS t FROM (SELECT licence, {lines} AS l FROM entries)),
longer(licence, opening, length, digest) AS (VALUES {longer}),
known AS (
  SELECT sha256(t) AS digest, min(licence) AS licence, max(length(t)) AS length, max(left(t, {OPENING})) AS opening FROM short GROUP BY 1
  UNION ALL SELECT digest, licence, length, opening FROM longer),
rows AS (SELECT r, doc_id, l, {whole.format('l')} AS w FROM (SELECT row_number() OVER () AS r, doc_id, {lines} AS l FROM documents)),
units AS (
  SELECT r, trim(u) AS u FROM (SELECT r, unnest(list_concat(string_split(l, chr(10)), [{whole.format('b')} FOR b IN string_split_regex(l, '\n{{2,}}')])) AS u FROM rows)),
spots AS (
  SELECT r, opening || left(t, length - {OPENING}) AS u
  FROM (SELECT r, opening, length, unnest(string_split(w, opening)[2:]) AS t FROM rows JOIN (SELECT DISTINCT opening, length FROM known WHERE length >= {LEAST}) ON contains(w, opening))),
found AS (
  SELECT r, sha256(u) AS d FROM units WHERE length(u) < {LEAST} UNION SELECT r, sha256(u) FROM spots UNION SELECT r, sha256(w) FROM rows),
hits AS (SELECT r, list_sort(list_distinct(list(licence))) AS a FROM found JOIN known ON d = digest GROUP BY r)
SELECT doc_id, sha256(w) AS text_digest, k.licence AS whole_licence, coalesce(array_to_string(a, ','), '') AS licences, coalesce(len(a), 0)::BIGINT AS n_licences
FROM rows LEFT JOIN known k ON k.digest = sha256(w) LEFT JOIN hits USING (r)
"""


SQL = _sql()

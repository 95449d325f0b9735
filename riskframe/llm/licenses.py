"""License scan by canonical digest lookup, DataFrame functions only.

A text's canonical form is lower case, without copyright lines, with one
spelling of equivalent words and single spaces for punctuation and white
space. Its SHA-256 is looked up among the digests of known licences (a hash
join over entire texts; the known side is a fixed list). A text that begins
with title or copyright lines, comment marks in front or not, is looked up
without that beginning too. Single lines that
speak of a licence are looked up the same way among known notices.
"""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_or_empty

#: Spellings that count as the same, applied in this order to
#: canonical text.
SPELLINGS = (
    ("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"), ("organisation", "organization"), ("favour", "favor"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("behaviour", "behavior"),
    ("whilst", "while"), ("https", "http"), ("copyright owner", "copyright holder"),
)

#: Licence texts without their copyright lines.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors
be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter
it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software.

3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License.""",
}

#: One-line notices.
NOTICES = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "Licensed under the MIT License.": "MIT",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "This program is licensed under the GNU General Public License, version 2.": "GPL-2.0",
    "Licensed under CC BY 4.0.": "CC-BY-4.0",
    "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "SPDX-License-Identifier: MIT": "MIT",
    "SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "SPDX-License-Identifier: GPL-3.0": "GPL-3.0",
}

#: Clause that makes the two-clause licence the three-clause one.
NO_ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse
or promote products derived from this software without specific prior written permission.

"""


def more_texts() -> dict[str, str]:
    """Text to id: the licences whose whole texts are files beside this module,
    the three-clause BSD licence, and common forms of the same texts (clauses
    with bullets for numbers, the Apache licence without its appendix or with
    the appendix filled in)."""
    out = {f.read_text(encoding="utf-8"): f.stem for f in sorted((Path(__file__).parent / "texts").glob("*.txt"))}
    apache = next(t for t, i in out.items() if i == "Apache-2.0")
    out[apache[:apache.index("APPENDIX:")]] = "Apache-2.0"
    out[re.sub(r"(?m)^ *Copyright \[yyyy\].*$", "", apache)] = "Apache-2.0"
    bsd = {"BSD-2-Clause": LICENSES["BSD-2-Clause"],
           "BSD-3-Clause": LICENSES["BSD-2-Clause"].replace("THIS SOFTWARE IS PROVIDED", NO_ENDORSEMENT + "THIS SOFTWARE IS PROVIDED")}
    for i, t in bsd.items():
        out |= {t: i, re.sub(r"(?m)^[0-9]\. ", "", t): i}
    return out


# lines that only state a copyright: "Copyright (c) 2020 X", "(c) 2020 X", "© X", "All rights reserved."
COPYRIGHT = (r"(?m)^[ \t]*(?:copyright[ \t]+(?:\(c\)|©|[0-9])|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*$")
# a title, copyright or SPDX line, or one without letters and digits, of a
# lower-case text; marks of comments and headings may stand before and after
_NEW = r"[\"'“”]?(?:new|revised|modified|simplified)[\"'“”]?"
_TITLE = (r"(?:the[ \t]+)?(?:mit(?:/x11|/expat)?|x11|expat|isc|0bsd|zlib(?:[ /]libpng)?|unlicense|software|"
          rf"(?:(?:{_NEW}|(?:[023]|zero|two|three)-clause) )?bsd(?:[ -](?:[023]|zero|two|three)[ -]clause)?(?: {_NEW}(?: or {_NEW})?)?)"
          r"(?:[ \t]+licen[cs]e)?(?:[ \t]*\([^()\n]{1,60}\))?|licen[cs]e")
_MARKS = r"[^\p{L}\p{N}\n]*"
_SAYS = (rf"{_MARKS}(?:(?:portions )?copyright\b|c\)[ \t]*[0-9]|all rights reserved|spdx-license-identifier)[^\n]*|"
         rf"{_MARKS}©[ \t]{{0,4}}[\p{{L}}\p{{N}}][^\n]*|{_MARKS}(?:{_TITLE}){_MARKS}")
HEADER_LINE = rf"^(?:{_SAYS}|{_MARKS})$"
#: The first line with a letter or digit is a header line.
HEADED = rf"^[^\p{{L}}\p{{N}}]*\n(?:{_SAYS})(?:\n|$)|^(?:{_SAYS})(?:\n|$)"
PUNCTUATION = r"[^\p{L}\p{N}]+"
LICENSE_LINE = "licen"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, ""), PUNCTUATION, " ")
    return F.trim(reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), SPELLINGS, out))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """``digest``, ``id`` of a fixed list of texts (text to id), as a local relation."""
    return spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("text"), F.lit(i).alias("id")) for t, i in texts.items()])).alias("k")) \
        .select(digest(F.col("k.text")).alias("digest"), F.col("k.id").alias("id"))


def known_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """``digest``, ``license_id`` of the texts as they are and without header."""
    t = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(t).alias("text"), F.lit(i).alias("id")) for t, i in texts.items()])).alias("k")).select("k.text", "k.id")
    forms = F.array(digest(F.col("text")), digest(without_header(F.col("text"))))
    return t.select(F.explode(forms).alias("digest"), "id").groupBy("digest").agg(F.min("id").alias("license_id"))


def without_header(text: Column) -> Column:
    """The lower-case text from its first line on that is no header line."""
    lines = F.split(F.lower(text), "\n")
    first = F.array_position(F.transform(lines, lambda x: ~F.regexp_like(x, F.lit(HEADER_LINE))), True).cast("int")
    return F.when(first > 0, F.array_join(F.slice(lines, first, F.size(lines)), "\n")).otherwise(F.lit(""))


def license_scan(docs: DataFrame, *, licenses: dict[str, str] | None = None,
                 notices: dict[str, str] | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``text_digest`` (of the canonical
    whole text), ``license_id`` (NULL if the text is no known licence),
    ``notices`` (ids of known notice lines, sorted, joined by commas; empty if
    none), ``license_lines`` (lines that speak of a licence).

    NULL text is empty. Repeated rows each give a row; an empty table gives
    none; other columns are not read. Nothing but the fixed lists is broadcast
    and nothing is shuffled."""
    spark = docs.sparkSession
    texts = {t: i for i, t in (licenses or LICENSES).items()} | ({} if licenses else more_texts())
    known = known_texts(spark, texts)
    lines_known = known_digests(spark, notices or NOTICES).groupBy("digest").agg(F.min("id").alias("id")).collect()
    ids = F.create_map(*[F.lit(x) for r in lines_known for x in (r["digest"], r["id"])])  # a dozen constants
    # split only the few texts that speak of a licence at all
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    lines = F.when(F.contains(F.lower("text"), F.lit(LICENSE_LINE)), F.filter(
        F.split("text", "\n"), lambda x: F.contains(F.lower(x), F.lit(LICENSE_LINE)))).otherwise(F.array().cast("array<string>"))
    headed = F.when(F.regexp_like(F.lower("text"), F.lit(HEADED)), digest(without_header(F.col("text"))))
    d = d.select("doc_id", digest(F.col("text")).alias("text_digest"), headed.alias("body_digest"), lines.alias("lines"))
    found = F.array_sort(F.array_distinct(F.filter(
        F.transform("lines", lambda x: F.try_element_at(ids, digest(x))), lambda x: x.isNotNull())))
    body = known.select(F.col("digest").alias("b_digest"), F.col("license_id").alias("b_id"))
    return d.join(F.broadcast(known), d.text_digest == known.digest, "left") \
        .join(F.broadcast(body), d.body_digest == body.b_digest, "left").select(
        "doc_id", "text_digest", F.coalesce("license_id", "b_id").alias("license_id"), F.array_join(found, ",").alias("notices"),
        F.size("lines").cast("long").alias("license_lines"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({x}), '{COPYRIGHT}', '', 'g'), '{PUNCTUATION}', ' ', 'g')"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out})"


def _sql_without_header(x: str) -> str:
    """Lines from the first one on that is no header line."""
    lines = f"string_split(lower({x}), chr(10))"
    first = f"list_position(list_transform({lines}, lambda y: regexp_matches(y, {_sql_text(HEADER_LINE)})), false)"
    return f"CASE WHEN {first} IS NULL THEN '' ELSE array_to_string(list_slice({lines}, {first}, len({lines})), chr(10)) END"


_SQL_HEADED = f"regexp_matches(lower(text), {_sql_text(HEADED)})"
_SQL_TEXTS = ", ".join(f"({_sql_text(t)}, {_sql_text(i)})" for t, i in ({t: i for i, t in LICENSES.items()} | more_texts()).items())

ORACLE = f"""
WITH texts AS (SELECT t, i FROM (VALUES {_SQL_TEXTS}) AS v(t, i)),
known AS (SELECT digest, min(i) AS license_id FROM (SELECT sha256({_sql_canonical('t')}) AS digest, i FROM texts
  UNION ALL SELECT sha256({_sql_canonical('b')}), i FROM (SELECT {_sql_without_header('t')} AS b, i FROM texts)) AS v GROUP BY 1),
notice AS (SELECT sha256({_sql_canonical('t')}) AS digest, min(i) AS id FROM (VALUES
  {', '.join(f'({_sql_text(t)}, {_sql_text(i)})' for t, i in NOTICES.items())}) AS v(t, i) GROUP BY 1),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT r, doc_id, text, sha256({_sql_canonical('text')}) AS text_digest FROM d),
h AS (SELECT r, sha256({_sql_canonical('b')}) AS body_digest FROM (SELECT r, {_sql_without_header('text')} AS b FROM d
  WHERE {_SQL_HEADED}) AS x),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) AS s
      WHERE contains(lower(line), '{LICENSE_LINE}')),
n AS (SELECT r, count(*) AS license_lines, string_agg(DISTINCT id, ',' ORDER BY id) AS notices
      FROM l LEFT JOIN notice ON notice.digest = sha256({_sql_canonical('line')}) GROUP BY r)
SELECT doc_id, text_digest, coalesce(known.license_id, body.license_id) AS license_id, coalesce(notices, '') AS notices,
  coalesce(license_lines, 0) AS license_lines
FROM g LEFT JOIN n USING (r) LEFT JOIN h USING (r) LEFT JOIN known ON known.digest = text_digest
LEFT JOIN known AS body ON body.digest = body_digest"""

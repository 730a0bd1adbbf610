"""License scans by canonical digest: entire texts, normalised, are hash-joined to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as the same, after lower-casing (fixed values, as in the matching guidelines for licence lists).
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "centre": "center",
    "emphasise": "emphasize",
    "favour": "favor",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "organisation": "organization",
    "organised": "organized",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sub-license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
    "http://": "https://",
}

_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{0}.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

#: Public licence texts and notices (fixed values); a caller may give a larger table.
KNOWN = {
    "0BSD": _ISC.format(""),
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": f"{_BSD_START}\n{_BSD_END}",
    "BSD-3-Clause": f"{_BSD_START}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_END}",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies"),
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-notice": "Released under the MIT License.",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
#: A table of known licences up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that begins as a copyright line, or a line of reserved rights.
_COPYRIGHT = r"\n[^a-z0-9\n(©]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
_NEITHER = r"[\x00-/:-`{-\x7F]+"


def canonical(text: Column) -> Column:
    """Lower case (A-Z), without copyright lines, in one spelling, words of letters and digits joined by blanks."""
    x = F.translate(F.coalesce(text, F.lit("")), _UPPER + "\r", _LOWER + "\n")
    x = F.regexp_replace(F.concat(F.lit("\n"), x), _COPYRIGHT, "\n")
    for old, new in SPELLINGS.items():
        x = F.replace(x, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(x, _NEITHER, " "))


def known_digests(spark: SparkSession, licenses: dict[str, str] | None = None) -> DataFrame:
    """license, digest of each known text; of two with one digest the first by name stays."""
    items = sorted((KNOWN if licenses is None else licenses).items())
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in items])
    table = spark.range(1).select(F.explode(rows).alias("x")).select("x.*") if items else spark.range(0).select(F.lit("").alias("license"), F.lit("").alias("text"))
    return table.select("license", F.sha2(canonical(F.col("text")), 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, licenses: dict[str, str] | None = None) -> DataFrame:
    """doc_id, digest (sha256 of the canonical text), n_canonical (its characters), license (null if unknown).

    Null text counts as empty; an empty canonical text is no licence. Repeated rows stay repeated, other
    columns are ignored.
    """
    made = docs.select("doc_id", canonical(F.col("text")).alias("_canonical")).select("doc_id", F.sha2("_canonical", 256).alias("digest"), F.length("_canonical").cast("long").alias("n_canonical"))
    known = known_digests(docs.sparkSession, licenses)
    if len(KNOWN if licenses is None else licenses) <= BROADCAST_ROWS:
        known = F.broadcast(known)
    return made.join(known, "digest", "left").select("doc_id", "digest", "n_canonical", F.when(F.col("n_canonical") > 0, F.col("license")).alias("license"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    x = f"translate(coalesce({text}, ''), '{_UPPER}' || chr(13), '{_LOWER}' || chr(10))"
    x = f"regexp_replace(chr(10) || {x}, {_quoted(_COPYRIGHT)}, chr(10), 'g')"
    for old, new in SPELLINGS.items():
        x = f"replace({x}, {_quoted(old)}, {_quoted(new)})"
    return f"trim(regexp_replace({x}, {_quoted(_NEITHER)}, ' ', 'g'))"


ORACLE = f"""
WITH known AS (
  SELECT digest, min(license) AS license FROM (
    SELECT license, sha256({_sql_canonical("text")}) AS digest FROM (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in sorted(KNOWN.items()))}) AS v(license, text))
  GROUP BY digest),
made AS (SELECT doc_id, {_sql_canonical("text")} AS c FROM documents)
SELECT m.doc_id, sha256(m.c) AS digest, length(m.c)::BIGINT AS n_canonical, CASE WHEN length(m.c) > 0 THEN k.license END AS license
FROM made m LEFT JOIN known k ON sha256(m.c) = k.digest
"""

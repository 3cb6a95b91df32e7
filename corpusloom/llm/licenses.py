"""Licence scan: whole texts, brought to a canonical form, are looked up by digest.

The canonical form follows the usual matching guidelines: case, punctuation and
blanks don't count, copyright notices are left out, equivalent spellings become
one. A notice is a line that begins with the word or mark and has a mark, a year
or a placeholder behind it, or that says no more than that all rights are
reserved; a line of a wrapped licence that happens to begin with "copyright
holder" stays. The same expressions make the digests of the known licences, a
table of some dozen rows that is broadcast; documents are never shuffled.

Defined results: a null or empty text has the digest of the empty canonical
form and no licence; very long texts are taken whole; repeated rows give
repeated results; extra columns of the input ride along, but those named like a
result give way to it.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

# Equivalent spellings, left one read as the right one.
SPELLINGS = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "licencing": "licensing",
    "licencor": "licensor",
    "sub license": "sublicense",
    "sub licence": "sublicense",
    "sublicence": "sublicense",
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "behaviour": "behavior",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "merchantability": "merchantability",
    "non commercial": "noncommercial",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "utilise": "utilize",
    "whilst": "while",
    "wilful": "willful",
    "https": "http",
}

# Texts of known licences, without their copyright lines.
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
LICENCES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n" + _AS_IS,
    "MIT-0": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n" + _AS_IS,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_AS_IS,
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD + _BSD_3 + _BSD_TAIL,
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n"
    "3. This notice may not be removed or altered from any source distribution.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\n"
    "http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
}

#: A copyright notice: a whole line of a text in lower case.
_NOTICE = r"^[ \t]*(?:(?:copyright[ \t]*(?:\(c\)|©|[<\[{])|copyright[^\n]*[0-9]{4}|\(c\)[^\n]*[0-9]{4}|©)[^\n]*|all rights reserved[.]?[ \t\r]*)$"

#: Lines that usually stand above a body.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "MIT-0": ("MIT No Attribution", "MIT No Attribution License"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
    "Zlib": ("zlib License", "The zlib License"),
}
_END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> list[tuple[str, str]]:
    """Ids and texts: bodies with and without a title, and the long licences, with and without what follows their terms."""
    out = [*LICENCES.items(), *((k, f"{t}\n\n{LICENCES[k]}") for k, titles in TITLES.items() for t in titles)]
    for path in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
        body = path.read_text(encoding="utf-8")
        out.append((path.stem, body))
        if _END in body:
            out.append((path.stem, body[: body.index(_END) + len(_END)]))
    return out


def canonical(text: Column) -> Column:
    """The canonical form: words of letters and digits, one blank between them."""
    lines = F.regexp_replace(F.concat(F.lit("\n"), F.lower(F.coalesce(text, F.lit("")))), f"(?md){_NOTICE}", "")
    # Two blanks between and around words, so that spellings side by side are each replaced.
    out = F.concat(F.regexp_replace(lines, r"[^\p{L}\p{N}]+", "  "), F.lit("  "))
    for old, new in SPELLINGS.items():
        if old != new:
            out = F.replace(out, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return F.trim(F.replace(F.replace(out, F.lit("  "), F.lit(" ")), F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known_licences(spark: SparkSession, licences: dict[str, str] | None = None) -> DataFrame:
    """license_id and license_digest, one row for each digest (the first id by name, should two agree)."""
    out = spark.createDataFrame(list(licences.items()) if licences else whole_texts(), "license_id string, body string")
    return out.groupBy(digest(F.col("body")).alias("license_digest")).agg(F.min("license_id").alias("license_id"))


def license_scan(docs: DataFrame, text: str = "text", licences: dict[str, str] | None = None) -> DataFrame:
    """``docs`` with text_digest and, where the whole text is a known licence, its license_id.

    The known licences are written in code or handed over as a parameter, so their table is small enough to broadcast.
    """
    known = known_licences(docs.sparkSession, licences).withColumnRenamed("license_digest", "text_digest")
    out = docs.drop(*[c for c in ("text_digest", "license_id") if c != text]).withColumn("text_digest", digest(F.col(f"`{text}`")))
    return out.join(F.broadcast(known), "text_digest", "left")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text_digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def _sql_digest(text: str) -> str:
    out = f"regexp_replace(chr(10) || lower(coalesce({text}, '')), '(?m){_NOTICE}', '', 'g')"
    out = f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || '  '"
    for old, new in SPELLINGS.items():
        if old != new:
            out = f"replace({out}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    return f"sha256(trim(regexp_replace({out}, ' +', ' ', 'g')))"


def _sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in whole_texts())
    return f"""
WITH known AS (SELECT min(license_id) AS license_id, text_digest FROM (SELECT license_id, {_sql_digest("body")} AS text_digest FROM (VALUES {quoted}) v(license_id, body)) GROUP BY 2)
SELECT doc_id, d.text_digest, license_id, license_id IS NOT NULL AS is_license
FROM (SELECT doc_id, {_sql_digest("text")} AS text_digest FROM documents) d LEFT JOIN known USING (text_digest)
"""


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLES = {"op3_license_scan": _sql()}

"""License scans by canonical digests.

A text is normalised (lower case, no copyright lines, no punctuation or blanks, one of several spellings of a word) and its
SHA-256 is joined, by hash, with the digests of known licence texts. Two units are looked up: the entire text, and each
entire line (for the one-line notices that documents carry). The catalogue is a DataFrame (license_id, text): here the
full texts in `licenses/` (each also as it ends before its appendix), short licences with any of their usual titles or
none, and one-line notices. Catalogues of up to MAX_KNOWN rows are broadcast, larger ones are joined by a shuffle.

A copyright line begins with the word or sign and goes on with the sign or a year, or names a holder and a year, or authors as a
group; "all rights reserved" is one too.

Defined cases: null and empty texts, and texts without letters or digits, match nothing; repeated rows each get their own
result; a catalogue with two ids for one canonical text gives the smaller id. A text of any length is
one row, of which one task holds a few copies as it is respelled.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import stored

#: Most digests of a catalogue that are broadcast; a row is under 200 bytes, so at most 2 MB.
MAX_KNOWN = 10_000

# Words, and phrases, that licence matching treats as equal, the first as the second.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
PHRASES = {
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "per cent": "percent",
}

#: All that isn't a letter, a digit or a line break, in lower-cased text.
PUNCTUATION = r"[\x{0}-\x{9}\x{B}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{A9}\x{AB}-\x{B4}\x{B6}-\x{B9}\x{BB}-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{3003}\x{FEFF}]+"
#: What stands for a year, and who holds rights together.
YEAR = "([0-9]{4}|yyyy|year)"
HOLDERS = "(authors|contributors|developers|maintainers|team|project|foundation)"
#: A copyright line: words with single spaces between them, once punctuation is gone and the signs are words.
COPYRIGHT_LINE = rf"(?m)\n (copyright( by)?( copyright| {YEAR})|copyright( [^ \n]+){{1,8}} {YEAR} $|copyright the [^\n]*{HOLDERS} $|all rights reserved)[^\n]*"

# Public licence texts, their usual titles and one-line notices.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
#: License and body; list numbers are as good as bullets.
SHORT = [
    ("0BSD", f"{ISC_GRANT}. {ISC_END}"),
    ("BSD-2-Clause", BSD_START + BSD_END),
    ("BSD-3-Clause", BSD_START + BSD_NAMES + BSD_END),
    ("ISC", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_END}"),
    ("ISC", f"{ISC_GRANT.replace('and/or', 'and')}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_END}"),
    ("MIT", MIT),
    ("Zlib", ZLIB),
]
BODIES = sorted({(i, body) for i, text in SHORT for body in (text, re.sub(r"(?m)^[0-9]\. ", "", text))})
TITLES = [
    ("0BSD", "BSD Zero Clause License"),
    ("0BSD", "Zero-Clause BSD"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", 'BSD 2-Clause "Simplified" License'),
    ("BSD-2-Clause", "BSD License"),
    ("BSD-2-Clause", "Simplified BSD License"),
    ("BSD-2-Clause", "The 2-Clause BSD License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License'),
    ("BSD-3-Clause", "BSD License"),
    ("BSD-3-Clause", "New BSD License"),
    ("BSD-3-Clause", "The 3-Clause BSD License"),
    ("BSD-3-Clause", "The BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("ISC", "ISC License (ISC)"),
    ("ISC", "The ISC License"),
    ("MIT", "Expat License"),
    ("MIT", "MIT License"),
    ("MIT", "MIT License (MIT)"),
    ("MIT", "The Expat License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Zlib", "The zlib License"),
    ("Zlib", "zlib License"),
    ("Zlib", "zlib/libpng License"),
]
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
]
END_OF_TERMS = "END OF TERMS AND CONDITIONS"


def long_texts() -> list[tuple[str, str]]:
    """The files' texts, whole and without what follows the terms."""
    found = []
    for file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        found.append((file.stem, text))
        if END_OF_TERMS in text:
            found.append((file.stem, text[: text.index(END_OF_TERMS) + len(END_OF_TERMS)]))
    return found


def known_texts() -> list[tuple[str, str]]:
    titled = [(i, f"{title}\n\n{body}") for i, body in BODIES for j, title in [("", ""), *TITLES] if j in ("", i)]
    return titled + NOTICES + long_texts()


def spaced(text: Column) -> Column:
    """Lines of lower-case words, each with a space on either side and a line break before; without copyright lines, in one spelling."""
    text = F.replace(F.replace(F.lower(text), F.lit("©"), F.lit(" copyright copyright ")), F.lit("(c)"), F.lit(" copyright "))
    text = F.replace(F.concat(F.lit("\n"), text, F.lit("\n")), F.lit("\n"), F.lit(" \n "))
    text = F.regexp_replace(F.regexp_replace(text, PUNCTUATION, " "), COPYRIGHT_LINE, "\n ")
    # with blanks doubled each word has two of its own, so that of neighbours both are met
    return spelled(F.replace(text, F.lit(" "), F.lit("  ")), SPELLINGS)


def doubled(pairs: dict[str, str]) -> list[tuple[str, str]]:
    """Spellings as they stand in texts whose blanks are doubled."""
    return [(f" {a.replace(' ', '  ')} ", f" {b.replace(' ', '  ')} ") for a, b in pairs.items()]


def spelled(text: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), doubled(pairs), text)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text; null if nothing is left of it."""
    return F.when(text != "", F.sha2(text, 256))


def joined(lines: Column) -> Column:
    """The canonical form of a text of spaced(); a phrase may go over two lines."""
    return F.replace(spelled(F.replace(lines, F.lit("\n  "), F.lit("")), PHRASES), F.lit(" "), F.lit(""))


def catalogue(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(known_texts() if known is None else known, "license_id string, text string")


def known_digests(known: DataFrame) -> DataFrame:
    """digest, license_id, size (characters of the canonical text) of each text."""
    canonical = known.select("license_id", joined(spaced(F.col("text"))).alias("c"))
    return canonical.select("license_id", digest(F.col("c")).alias("digest"), F.length("c").alias("size")).where("digest is not null").groupBy("digest", "size").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, canonical_sha256, license_id (of the entire text), n_notices and notice_ids (of its lines)."""
    table = stored(known_digests(known), "license-digests")
    small = table.count() <= MAX_KNOWN
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", spaced(F.coalesce("text", F.lit(""))).alias("lines"))
    # only a line as long as a known text can be one
    sizes = [r.size for r in table.select("size").distinct().collect()] if small else None
    fits = lambda x: F.length(x).isin(sizes) if small else x != ""
    lines = F.filter(F.transform(F.split(spelled(F.col("lines"), PHRASES), "\n"), lambda x: F.replace(x, F.lit(" "), F.lit(""))), fits)
    unit = lambda entire, d: F.struct(F.lit(entire).alias("entire"), d.alias("digest"))
    units = F.concat(F.array(unit(True, digest(joined(F.col("lines"))))), F.transform(lines, lambda x: unit(False, digest(x))))
    found = (
        rows.select("row", "doc_id", F.explode(units).alias("u"))
        .select("row", "doc_id", "u.entire", "u.digest")
        .join(F.broadcast(table.drop("size")) if small else table.drop("size"), "digest", "left")
        .where("entire or license_id is not null")
    )
    of_text, of_line = (lambda c: F.when(F.col("entire"), c)), (lambda c: F.when(~F.col("entire"), c))
    return (
        found.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max(of_text(F.col("digest"))).alias("canonical_sha256"),
            F.max(of_text(F.col("license_id"))).alias("license_id"),
            F.count(of_line(F.lit(1))).alias("n_notices"),
            F.array_join(F.sort_array(F.collect_set(of_line(F.col("license_id")))), ",").alias("notice_ids"),
        )
        .drop("row")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), catalogue(spark))


def canonical(text: str) -> str:
    """The canonical form in plain Python."""
    text = text.lower().replace("©", " copyright copyright ").replace("(c)", " copyright ")
    text = f"\n{text}\n".replace("\n", " \n ")
    code_points = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: re.escape(chr(int(m[1], 16))), PUNCTUATION)
    text = re.sub(COPYRIGHT_LINE, "\n ", re.sub(code_points, " ", text)).replace(" ", "  ")
    for a, b in doubled(SPELLINGS):
        text = text.replace(a, b)
    text = text.replace("\n  ", "")
    for a, b in doubled(PHRASES):
        text = text.replace(a, b)
    return text.replace(" ", "")


def _oracle() -> str:
    rows = lambda pairs: ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in pairs)
    lowered = lambda t: f"replace(replace(lower({t}), '©', ' copyright copyright '), '(c)', ' copyright ')"
    lined = lambda t: f"replace(chr(10) || {lowered(t)} || chr(10), chr(10), ' ' || chr(10) || ' ')"
    plain = lambda t: f"regexp_replace(regexp_replace({lined(t)}, '{PUNCTUATION}', ' ', 'g'), '{COPYRIGHT_LINE}', chr(10) || ' ', 'g')"
    spelled = lambda t, pairs: reduce(lambda x, pair: f"replace({x}, '{pair[0]}', '{pair[1]}')", doubled(pairs), t)
    lines = lambda t: spelled(f"replace({plain(t)}, ' ', '  ')", SPELLINGS)
    joined = lambda t: f"replace({spelled(f"replace({t}, chr(10) || '  ', '')", PHRASES)}, ' ', '')"
    digests = [(i, hashlib.sha256(canonical(t).encode()).hexdigest()) for i, t in long_texts()]
    return f"""
WITH b AS (SELECT * FROM (VALUES {rows(BODIES)}) AS v(i, t)), h AS (SELECT * FROM (VALUES {rows(TITLES)}) AS v(i, t)),
t AS (SELECT i, t FROM b UNION ALL SELECT b.i, h.t || chr(10) || b.t FROM b JOIN h ON h.i = b.i UNION ALL SELECT * FROM (VALUES {rows(NOTICES)}) AS v(i, t)),
k AS (SELECT digest, min(i) AS license_id FROM (SELECT sha256({joined(lines('t'))}) AS digest, i FROM t UNION ALL SELECT d, i FROM (VALUES {rows(digests)}) AS v(i, d)) AS u GROUP BY digest),
d AS (SELECT doc_id, {lines("coalesce(text, '')")} AS lines FROM documents),
c AS (SELECT row_number() OVER () AS r, doc_id, lines, {joined("lines")} AS c FROM d),
x AS (SELECT r, doc_id, CASE WHEN c <> '' THEN sha256(c) END AS canonical_sha256 FROM c),
n AS (SELECT r, count(*) AS n_notices, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids
      FROM (SELECT r, replace(unnest(string_split({spelled("lines", PHRASES)}, chr(10))), ' ', '') AS c FROM c) l
      JOIN k ON c <> '' AND k.digest = sha256(c) GROUP BY r)
SELECT x.doc_id, canonical_sha256, license_id, coalesce(n_notices, 0) AS n_notices, coalesce(notice_ids, '') AS notice_ids
FROM x LEFT JOIN k ON k.digest = canonical_sha256 LEFT JOIN n ON n.r = x.r
"""


ORACLE = _oracle()

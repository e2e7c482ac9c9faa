"""License scans by canonical digest lookup, in DataFrame functions only.

A text is brought to a canonical form: lower case, notices of copyright dropped, punctuation and white
space as one space, equivalent spellings as one.  The SHA-256 of the whole canonical text as one line is
joined by hash to the digests of known licence texts; each canonical line is looked up among the digests
of known one-line notices.

A notice of copyright is a line that begins with the word or the sign, unless what follows, there or on
the next line, are words of a licence on its holders, notices and so on: a digest doesn't depend on
where a text is wrapped.

Cases: a null text is the empty text, which is no licence; repeated rows are scanned alike; texts of
any length are digested whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond so many known texts the table is joined by a shuffle, not sent to each executor.
BROADCAST_TEXTS = 10_000

# The wording of public licences.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
"""
_MIT_NOTICE = """
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.
"""
_MIT_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
"""
_BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""
_ISC_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE.
"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not
required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""

LICENSES: list[tuple[str, str]] = [
    ("MIT", _MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY),
    ("MIT", "MIT License\n\n" + _MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY),
    ("MIT", "The MIT License\n\n" + _MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT_GRANT + _MIT_NOTICE + _MIT_WARRANTY),
    ("MIT-0", _MIT_GRANT.replace(", subject to the following conditions:", ".") + _MIT_WARRANTY),
    ("BSD-2-Clause", _BSD_TERMS + _BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_TERMS + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_TERMS + _BSD_NAMES + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_TERMS + _BSD_NAMES + _BSD_WARRANTY),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("ISC", "ISC License\n\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_WARRANTY),
    ("0BSD", "BSD Zero Clause License\n\n" + _ISC_GRANT + ".\n" + _ISC_WARRANTY),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
]

# Digests of the canonical form of longer licences as published, with what follows their terms and without.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b"),
    ("GFDL-1.3", "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "b4fb601cd1d708fd4d48958cfaecb8bb919d60af95b4704afb85d1a886f8b303"),
    ("MPL-2.0", "12274540925f246f7614a52b7ebddfbe0463ff1ab194088c554c73552c45582d"),
]

# One-line notices in common use.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
]

# Spellings taken as one.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("licencing", "licensing"),
    ("sub license", "sublicense"),
    ("non infring", "noninfring"),
    ("non commercial", "noncommercial"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("authoris", "authoriz"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("per cent", "percent"),
    ("https", "http"),
]

#: What begins like a notice of copyright and is a licence's own text gets MARK behind that beginning.
LEGAL = (
    r"(^|\n)([ \t*#/;.-]*)(copyright[\s*#/;,.-]+(?:holders?|owners?|notices?|laws?|licen[cs]es?|statements?|interests?|and|or|in|to|patents?|trademarks?|permissions?|protection|status|is|on|as|for|under|by|if|treaty|treat(?:y|ies)|disclaimers?|works?|title|act|exceptions?|with|of|does|means|that|will|resulting|restrictions?|control|ownership|moral|related|statutes?|doctrines?|representations|the software|the library|the program)\b"
    r"|copyright\s*\z|\(c\)\s+(?:you|the|under|for|to|in|any|if|that|such|with|changes|modifications|representations|accompany|provide|by|must|give|is|it|each)\b)"
)
MARK = "\x01"
#: A line that begins like a notice and has a year or a sign is one, whatever the holder is called; so is what follows a licence's title on its line.
DATED = r"(^|\n)([^\n]{0,60}licen[cs]e(?: *\([a-z0-9 .-]{1,12}\))?[ \t*#/;.,:-]+)?[ \t*#/;.-]*copyright\b[^\n]*?(?:\b(?:19|20)[0-9][0-9]\b|\(c\)|©)[^\n]*"
NOTICE = r"(^|\n)[ \t*#/;.-]*(?:copyright[^\x01a-z0-9_\n][^\n]*|\(c\)[^\n]*|©[^\n]*|all rights reserved[^\n]*)"
PUNCTUATION = r"[\x00-\x09\x0b-\x20!-/:-@\[-`{-~“”‘’«»–—•©\x{a0}]+"
LINES = r" *\n[ \n]*"
EDGES = r"^[ \n]+|[ \n]+$"


def _python(pattern: str) -> str:
    return pattern.replace(r"\x{a0}", "\xa0").replace(r"\z", r"\Z")


def _plain(text: str) -> str:
    text = re.sub(DATED, r"\1\2", text.lower())
    text = re.sub(_python(LEGAL), rf"\1{MARK}\2\3", text)
    text = re.sub(NOTICE, r"\1", text)
    return re.sub(EDGES, "", re.sub(LINES, "\n", re.sub(_python(PUNCTUATION), " ", text)))


def _spelled(text: str) -> str:
    for a, b in SPELLINGS:
        text = text.replace(a, b)
    return text


def canonical_text(text: str) -> str:
    """The canonical form of a known text, lines kept."""
    return _spelled(_plain(text))


def _digest(text: str) -> str:
    return hashlib.sha256(_spelled(_plain(text).replace("\n", " ")).encode()).hexdigest()


def plain(text: Column) -> Column:
    """The canonical form but for spellings, lines kept."""
    dated = F.regexp_replace(F.lower(text), DATED, "$1$2")
    text = F.regexp_replace(F.regexp_replace(dated, LEGAL, f"$1{MARK}$2$3"), NOTICE, "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, PUNCTUATION, " "), LINES, "\n"), EDGES, "")


def spelled(text: Column) -> Column:
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def known(texts: list[tuple[str, str]] = LICENSES) -> dict[str, str]:
    return {_digest(text): name for name, text in texts}


def known_licenses() -> dict[str, str]:
    return known() | {digest: name for name, digest in DIGESTS}


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    digests: dict[str, str] | None = None,
    notices: list[tuple[str, str]] = NOTICES,
) -> DataFrame:
    """(doc_id, text_sha256, license, notices, n_notice_lines), a row for each document.

    ``license`` names the licence that the whole text is (null if none); ``notices`` the licences
    that its lines name, in order of name.  ``digests`` has licences by digest (default: the known ones).
    """
    table = known_licenses() if digests is None else digests
    right = docs.sparkSession.createDataFrame(list(table.items()), "known_sha256 string, license string")
    if len(table) <= BROADCAST_TEXTS:
        right = F.broadcast(right)
    lengths = F.array(*[F.lit(n) for n in sorted({len(canonical_text(t)) for _, t in notices})])
    names = F.create_map(*[F.lit(x) for pair in known(notices).items() for x in pair])
    lines = F.filter(F.split(spelled(F.col("plain")), "\n"), lambda x: F.array_contains(lengths, F.length(x)))
    named = F.filter(F.transform(lines, lambda x: F.try_element_at(names, F.sha2(x, 256))), lambda x: x.isNotNull())
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    scanned = docs.select(F.col(f"`{id_col}`").alias("doc_id"), plain(text).alias("plain"))
    whole = F.sha2(spelled(F.replace("plain", F.lit("\n"), F.lit(" "))), 256)
    found = scanned.select("doc_id", whole.alias("text_sha256"), named.alias("found"))
    joined = found.join(right, found["text_sha256"] == right["known_sha256"], "left")
    return joined.select(
        "doc_id",
        "text_sha256",
        "license",
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"),
        F.size("found").cast("long").alias("n_notice_lines"),
    )


def oracle_sql() -> str:
    """The default scan as DuckDB SQL over the view ``documents``."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def spelled(text: str) -> str:
        for a, b in SPELLINGS:
            text = f"replace({text}, {quoted(a)}, {quoted(b)})"
        return text

    text = f"regexp_replace(lower(coalesce(text, '')), {quoted(DATED)}, '\\1\\2', 'g')"
    text = f"regexp_replace({text}, {quoted(LEGAL)}, '\\1' || chr(1) || '\\2\\3', 'g')"
    text = f"regexp_replace(regexp_replace({text}, {quoted(NOTICE)}, '\\1', 'g'), {quoted(PUNCTUATION)}, ' ', 'g')"
    text = f"regexp_replace(regexp_replace({text}, {quoted(LINES)}, chr(10), 'g'), {quoted(EDGES)}, '', 'g')"
    rows = {k: ", ".join(f"({quoted(d)}, {quoted(n)})" for d, n in v.items()) for k, v in (("l", known_licenses()), ("n", known(NOTICES)))}
    return f"""
WITH licenses(known_sha256, license) AS (VALUES {rows["l"]}),
notices(line_sha256, notice) AS (VALUES {rows["n"]}),
scanned AS (SELECT row_number() OVER () AS row_id, doc_id, {text} AS plain FROM documents),
lines AS (SELECT row_id, sha256(unnest(string_split({spelled('plain')}, chr(10)))) AS line_sha256 FROM scanned),
found AS (SELECT row_id, string_agg(DISTINCT notice, ',' ORDER BY notice) AS notices, count(*) AS n
          FROM lines JOIN notices USING (line_sha256) GROUP BY row_id),
digests AS (SELECT row_id, doc_id, sha256({spelled("replace(plain, chr(10), ' ')")}) AS text_sha256 FROM scanned)
SELECT doc_id, text_sha256, license, coalesce(f.notices, '') AS notices, coalesce(f.n, 0) AS n_notice_lines
FROM digests LEFT JOIN licenses ON text_sha256 = known_sha256 LEFT JOIN found f USING (row_id)"""

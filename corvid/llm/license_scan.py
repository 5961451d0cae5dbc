"""License scans by canonical digests.

A text is canonical once A-Z is lower case, copyright lines (a year, a sign or a
placeholder follows "copyright", and at most 160 characters) are gone, all
characters but letters, digits and non-ASCII ones have become single blanks,
and equivalent spellings are one. Texts with one canonical form have one SHA-256
digest; a hash join with the digests of known licences identifies them. The
join looks up entire texts: the whole document, and each of its lines as a text
of its own, which is where licence notices stand. All of it are Spark SQL
expressions; only lines that hit are shuffled. The known licences are a list
in this module and the files in ``licenses``, which are broadcast (as digests), and a
table the caller may add, which is not.

Null and empty texts, and texts of copyright lines alone, have no canonical
form: digest null, nothing found. A text that equals two known licences (same
canonical form) gets the first name. Rows with equal doc_id share their
notices. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts of public licences and their notices.
_MIT = """MIT License

Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ISC = """ISC License

Copyright (c) <year> <holder>

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>
"""
_ZLIB = """zlib License

(C) <year> <holder>

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ENDORSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_BSD3 = _BSD2.replace("THIS SOFTWARE IS", _ENDORSE + "THIS SOFTWARE IS")
#: Longer texts, a file each.
_FILES = tuple((f.stem, f.read_text("utf-8")) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt")))
#: (name, text); notices of one line are found as lines of a document too.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", _MIT.split("\n", 1)[1]),
    ("ISC", _ISC),
    ("ISC", _ISC.split("\n", 1)[1]),
    ("Unlicense", _UNLICENSE),
    ("Zlib", _ZLIB),
    ("Zlib", _ZLIB.split("\n", 1)[1]),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", _BSD2),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD2),
    ("BSD-3-Clause", _BSD3),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD3),
    *_FILES,
)
#: Spellings that count as one, as words of the canonical form.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("recognise", "recognize"),
    ("non commercial", "noncommercial"),
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("https", "http"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RIGHTS = r"^[^a-z0-9]*((copyright|\(c\)|©)[ ,:]*(\(c\)|©|<|\[|[0-9]{4}|by )[^\n]{0,160}\z|\(c\) [^\n]{0,160}\z|all rights reserved[^a-z0-9]*\z)"
_BREAKS = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def canonical_line(line: Column) -> Column:
    """A line's canonical form, blanks around it; copyright lines become one blank."""
    low = F.translate(line, _UPPER, _LOWER)
    out = F.regexp_replace(F.concat(F.lit(" "), F.when(low.rlike(_RIGHTS), F.lit("")).otherwise(low), F.lit(" ")), _BREAKS, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return out


def canonical_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), canonical_line), lambda x: x != " ")


def _digest(form: Column) -> Column:
    return F.sha2(F.replace(form, F.lit("  "), F.lit(" ")), 256)


def _whole(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, _digest(F.array_join(lines, "")))


def known_digests(spark, more: DataFrame | None = None) -> DataFrame:
    """digest, license of the known texts: the list in this module, and those of ``more (license, text)``."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(KNOWN)], "place int, license string, text string")
    if more is not None:
        rows = rows.union(more.where("license is not null").select(F.lit(len(KNOWN)), F.col("license").cast("string"), F.col("text").cast("string")))
    return rows.where("text is not null").select("place", "license", _whole(canonical_lines(F.col("text"))).alias("digest")).groupBy("digest").agg(F.min(F.struct("place", "license"))["license"].alias("license")).where("digest is not null")


def scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license (of the whole text) and notices (licences of single lines, by name, comma-separated) of each row.

    ``more (license, text)`` are known texts besides the list in this module.
    """
    known = known_digests(docs.sparkSession, more)
    known = F.broadcast(known) if more is None else known
    lines = canonical_lines(F.coalesce(F.col("text").cast("string"), F.lit("")))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines.alias("lines"))
    whole = base.select("doc_id", _whole(F.col("lines")).alias("digest")).join(known, "digest", "left")
    hits = base.select("doc_id", F.explode(F.array_distinct("lines")).alias("line")).select("doc_id", _digest(F.col("line")).alias("digest")).join(known, "digest")
    notices = hits.where("doc_id is not null").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    return whole.join(notices, "doc_id", "left").select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))


def _oracle() -> str:
    low = f"translate(x, '{_UPPER}', '{_LOWER}')"
    line = f"regexp_replace(' ' || CASE WHEN regexp_matches({low}, '{_RIGHTS}') THEN '' ELSE {low} END || ' ', '{_BREAKS}', ' ', 'g')"
    for old, new in SPELLINGS:
        line = f"replace({line}, ' {old} ', ' {new} ')"
    lines = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {line}), lambda x: x != ' ')"
    known = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(KNOWN))
    return f"""
WITH k AS (SELECT place, license, {lines} AS lines FROM (VALUES {known}) AS t(place, license, text)),
known AS (SELECT sha256(replace(array_to_string(lines, ''), '  ', ' ')) AS digest, arg_min(license, place) AS license FROM k GROUP BY 1),
base AS (SELECT doc_id, {lines} AS lines FROM documents),
whole AS (SELECT doc_id, CASE WHEN len(lines) > 0 THEN sha256(replace(array_to_string(lines, ''), '  ', ' ')) END AS digest FROM base),
hits AS (
  SELECT DISTINCT doc_id, license
  FROM (SELECT doc_id, sha256(replace(unnest(lines), '  ', ' ')) AS digest FROM base) JOIN known USING (digest)),
notices AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM hits GROUP BY doc_id)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices
FROM whole LEFT JOIN known USING (digest) LEFT JOIN notices USING (doc_id)
"""


ORACLE = _oracle()

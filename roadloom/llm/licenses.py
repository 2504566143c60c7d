"""Licences found by the digest of a text's canonical form.

Case, punctuation, copyright lines and equivalent spellings are normalised away; what is left is hashed and
looked up among the digests of known licence texts and notices. The whole text of a document is looked up, and
so is each of its lines that could be a notice. The known texts are a fixed list, so they are broadcast.

Known are the full texts of MIT, MIT-0, BSD-2-Clause, BSD-3-Clause, ISC, 0BSD, Zlib, Apache-2.0, Artistic-1.0-Perl,
CC0-1.0, GFDL-1.2 and 1.3, GPL-1.0 to 3.0, LGPL-2.0, 2.1 and 3.0, MPL-1.1 and 2.0, and one-line notices (KNOWN).

Defined cases: a null or empty text has no licence; repeated rows get equal results; there are no ties, as a
digest has one identifier; an empty table gives no rows; further columns of the input are ignored; a long text is
read whole, in one row's expression.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equivalent spellings, to the first of each pair; applied to lower-case text.
SPELLINGS = (
    ("license", "licence"),
    ("sublicense", "sub-license"),
    ("sublicense", "sub license"),
    ("noncommercial", "non-commercial"),
    ("merchantability", "merchantibility"),
    ("favor", "favour"),
    ("organization", "organisation"),
    ("authorization", "authorisation"),
    ("copyright owner", "copyright holder"),
    ("http", "https"),
)
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*$|(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
MAY_BE_NOTICE = r"(?i)licen[cs]|copyright|public domain|creative commons|\bcc[ -]|permission"

_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
_BSD_TWO = (
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_THREE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    '.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_MIT_CONDITION = ", subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
    "from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to "
    "alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must "
    "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
    "appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software.\n3. This notice may not be removed or altered from any source distribution."
)
_APACHE_NOTICE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
    "copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software "
    'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the '
    "License for the specific language governing permissions and limitations under the License."
)
# Known texts: identifier, kind, text.
KNOWN = (
    ("MIT", "text", f"MIT License\n\nCopyright (c) 2000 A. Holder\n\n{_MIT_GRANT}{_MIT_CONDITION}{_WARRANTY_MIT}"),
    ("MIT", "text", f"The MIT License (MIT)\n\n{_MIT_GRANT}{_MIT_CONDITION}{_WARRANTY_MIT}"),
    ("MIT", "text", f"{_MIT_GRANT}{_MIT_CONDITION}{_WARRANTY_MIT}"),
    ("MIT-0", "text", f"MIT No Attribution\n\n{_MIT_GRANT}.\n\n{_WARRANTY_MIT}"),
    ("BSD-2-Clause", "text", f"{_BSD_START}{_BSD_ONE}{_BSD_TWO}{_BSD_END}"),
    ("BSD-2-Clause", "text", f"BSD 2-Clause License\n\n{_BSD_START}{_BSD_ONE}{_BSD_TWO}{_BSD_END}"),
    ("BSD-3-Clause", "text", f"{_BSD_START}{_BSD_ONE}{_BSD_TWO}{_BSD_THREE}{_BSD_END}"),
    ("BSD-3-Clause", "text", f"BSD 3-Clause License\n\n{_BSD_START}{_BSD_ONE}{_BSD_TWO}{_BSD_THREE}{_BSD_END}"),
    ("ISC", "text", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies{_ISC_END}"),
    ("ISC", "text", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies{_ISC_END}"),
    ("0BSD", "text", f"{_ISC_GRANT}{_ISC_END}"),
    ("Zlib", "text", _ZLIB),
    ("Zlib", "text", f"zlib License\n\n{_ZLIB}"),
    ("Apache-2.0", "notice", _APACHE_NOTICE),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "notice", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0-only", "notice", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0-only", "notice", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "notice", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "notice", "Released under the BSD License."),
    ("MPL-2.0", "notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

# SHA-256 of the canonical form of the full texts of long licences, as their publishers give them.
KNOWN_FULL = (
    ("Apache-2.0", "95f35d79ea3bab75c250549d6a03cef242e0547d78c99e26fcede49936fb0184"),
    ("Artistic-1.0-Perl", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "1844ed6d2b561fbfdd001112b0d54bf6641a3753759ca67c09c56216b5770d77"),
    ("GFDL-1.3", "07c8b0cfe8fdb678ea107b180b63db459696f643ebf58007f46e8c8592bbb6ed"),
    ("GPL-1.0", "c09d5046968ffc313f446a0e42ef24c680c3aa26b40e3d75b0ad987b918918ec"),
    ("GPL-2.0", "bd52b888e794f2388c02bf345e0acb98859286aeb15f5dcb1cd8e564083a65f9"),
    ("GPL-3.0", "b44192957f1deca3206424c07310ae70a8b59b51d87db45e1bc4487304b13dad"),
    ("LGPL-2.0", "62fbbadf77aa58d58c5faefddd29f63ecd0ff7c2f6ce2fb8c83ff136b68b574b"),
    ("LGPL-2.1", "19d5cec7cfb71e236cf47696f9e7cef4fd5504fb81a1f44dab64fa51d49e09a7"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for one, other in SPELLINGS:
        out = F.replace(out, F.lit(other), F.lit(one))
    return F.trim(F.regexp_replace(out, "[^a-z0-9\u0080-\U0010ffff]+", " "))


def canonical_text(text: str) -> str:
    """The same for a known text."""
    out = re.sub(COPYRIGHT_LINE.replace("|(?m)", "|"), "", text.lower())
    for one, other in SPELLINGS:
        out = out.replace(other, one)
    return re.sub("[^a-z0-9\u0080-\U0010ffff]+", " ", out).strip(" ")


def known_digests() -> list[tuple[str, str]]:
    """digest, identifier of every known text, each digest once."""
    found = {digest: name for name, digest in KNOWN_FULL}
    for name, _, text in KNOWN:
        found.setdefault(hashlib.sha256(canonical_text(text).encode()).hexdigest(), name)
    return sorted(found.items())


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, canonical_sha256, license of the whole text, notices (found in its lines, sorted), n_notices.

    One row for each row of docs (doc_id, text).
    """
    known = F.broadcast(docs.sparkSession.createDataFrame(known_digests(), "digest string, name string"))
    text = F.coalesce("text", F.lit(""))
    whole = docs.select("doc_id", text.alias("_text"), F.sha2(canonical(text), 256).alias("canonical_sha256"))
    # a line is a text of its own; only a few can be notices, and those meet the few known digests where they are
    lines = F.transform(F.filter(F.split("_text", "\n"), lambda x: x.rlike(MAY_BE_NOTICE)), lambda x: F.sha2(canonical(x), 256))
    names = F.create_map(*[F.lit(x) for pair in known_digests() for x in pair])
    found = F.filter(F.transform(lines, lambda d: F.try_element_at(names, d)), lambda x: x.isNotNull())
    scanned = whole.withColumn("_found", F.when(F.col("_text").rlike(MAY_BE_NOTICE), found).otherwise(F.array().cast("array<string>")))
    joined = scanned.join(known, F.col("canonical_sha256") == F.col("digest"), "left")
    return joined.select("doc_id", "canonical_sha256", F.col("name").alias("license"), F.array_join(F.array_sort(F.array_distinct("_found")), ",").alias("notices"), F.size("_found").cast("long").alias("n_notices"))


def scan_sql() -> str:
    """The same in DuckDB's SQL."""

    def sql(text: str) -> str:
        out = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g')"
        for one, other in SPELLINGS:
            out = f"replace({out}, '{other}', '{one}')"
        return f"sha256(trim(regexp_replace({out}, '[^a-z0-9\\x{{80}}-\\x{{10ffff}}]+', ' ', 'g'), ' '))"

    known = ", ".join(f"('{d}', '{n}')" for d, n in known_digests())
    return f"""
WITH known(digest, name) AS (VALUES {known}),
whole AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM whole WHERE regexp_matches(t, '{MAY_BE_NOTICE}')),
found AS (
  SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS notices, count(*) AS n
  FROM lines JOIN known ON digest = {sql('x')} WHERE regexp_matches(x, '{MAY_BE_NOTICE}') GROUP BY r)
SELECT doc_id, {sql('t')} AS canonical_sha256, name AS license, coalesce(notices, '') AS notices, coalesce(n, 0) AS n_notices
FROM whole LEFT JOIN known ON digest = {sql('t')} LEFT JOIN found USING (r)"""

"""License scan by canonical digests.

Texts that say the same license in other case, punctuation, copyright lines or spelling have one canonical form;
its digest is looked up among those of known license texts and notices by a hash join of entire texts. The
entire texts looked up are the document itself, each run of as many paragraphs as a known text has, and each of its lines, so a license
inside a document is found wherever it stands in paragraphs or lines of its own. Everything is SQL functions; the known
digests are a fixed table of a few hundred rows, which is broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.llm.common import let

#: Names of licenses as notices use them (fixed values).
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "BSD-3-Clause"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "EPL-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL-2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
}
#: Sentences around a name; each name makes one known notice with each.
NOTICES = ("Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}",
           "Distributed under the {}", "This project is licensed under the {}", "This software is licensed under the {}", "SPDX-License-Identifier: {}")

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."
_UNLICENSE = 'This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
#: Headers that files under the GNU licenses carry: name of the license, version and address of the text.
_GNU = "This {thing} is free software{mark} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{either}.\n\nThis {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.\n\nYou should have received a copy of the {name} along with this {thing}. If not, see <https://www.gnu.org/licenses/>."
_GNU_NAMES = (("GPL", "GNU General Public License", ("2", "3"), "program"), ("LGPL", "GNU Lesser General Public License", ("2.1", "3"), "library"), ("AGPL", "GNU Affero General Public License", ("3",), "program"))
#: Texts of licenses (fixed values).
TEXTS = (
    ("MIT", f"MIT License\n\n{_GRANT}"),
    ("MIT", _GRANT),
    ("ISC", f"ISC License\n\n{_ISC.format(', provided that the above copyright notice and this permission notice appear in all copies')}"),
    ("ISC", _ISC.format(", provided that the above copyright notice and this permission notice appear in all copies")),
    ("0BSD", _ISC.format("")),
    ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", f"{_BSD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_AS_IS}"),
    ("BSD-3-Clause", f"{_BSD}\n\n{_BSD_1}\n\n{_BSD_2}\n\n{_BSD_3}\n\n{_AS_IS}"),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", f"{_UNLICENSE}\n\nFor more information, please refer to <https://unlicense.org>"),
    ("MPL-2.0", _MPL),
    *(
        (f"{short}-{version if '.' in version else version + '.0'}", _GNU.format(thing=thing, mark=mark, name=name, either=f"{comma} either version {version} of the License, or (at your option) any later version"))
        for short, name, versions, own in _GNU_NAMES for version in versions for thing in dict.fromkeys((own, "program")) for mark, comma in ((":", ","), (";", ";"))
    ),
)
#: Numbers of paragraphs that texts have: runs of so many are units of a document, besides its lines and the whole of it.
RUNS = tuple(sorted({t.count("\n\n") + 1 for _, t in TEXTS} | {1, 2}))
#: Patterns and what they become, in this order (fixed values): copyright lines and marks of lists go, then equivalent spellings meet, then punctuation.
RULES = (
    (r"(^|\n)[ \t]*(copyright[^\n]*(\(c\)|©|[0-9]{4}|year|yyyy)|\(c\)|©|all rights reserved)[^\n]*", "\n"),
    (r"(^|\n)[ \t]*(\(?[0-9a-z][.)]|[*•-])[ \t]+", "\n"),
    (r"licence", "license"),
    (r"https?://", " "),
    (r"[^a-z0-9.]+", " "),
    (r"\.( |$)", " "),
    (r"\bsub license", "sublicense"),
    (r"\bnon commercial", "noncommercial"),
    (r"\bshare alike", "sharealike"),
    (r"\b(version|ver|v) ?([0-9])", "$2"),
    (r"\bcopyright owner", "copyright holder"),
    (r" +", " "),
)
#: Every known text holds one of these words, and no rule makes one of them from parts, so other units have no known digest and need
#: no normalising.
ANCHOR = r"(?i)licen[cs]e|permission|released|distributed|redistribut"


def canonical(text: Column) -> Column:
    """The canonical form of an entire text."""
    return F.btrim(reduce(lambda t, r: F.regexp_replace(t, *r), RULES, F.lower(text)))


def known_texts() -> list[tuple[str, str]]:
    """(license, text) of all known texts and notices."""
    return [*TEXTS, *((k, n.format(name)) for k, names in NAMES.items() for name in names for n in NOTICES)]


def known(spark: SparkSession) -> DataFrame:
    """license_id and digest of the known texts."""
    rows = spark.createDataFrame(known_texts(), "license_id string, text string")
    return rows.select("license_id", F.md5(canonical(F.col("text"))).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license_id, unit, n): how many units of each kind (text, paragraph, paragraphs, line) of a document are a known license.

    A document that is one line counts as text, paragraph and line. Null and empty texts have no unit, texts of any length are read whole, repeated
    rows add up, null ids count as one id, a digest that two licenses share goes to the first by name, other
    columns are ignored, an empty table gives an empty result.
    """
    given = docs.select("doc_id", "text").filter(F.col("text").rlike(ANCHOR))
    unit = lambda kind, texts: F.transform(texts, lambda t: F.struct(F.lit(kind).alias("unit"), t.alias("t")))
    paragraphs = F.filter(F.split("text", r"\n[ \t]*\n"), lambda t: F.trim(t) != "")

    def runs(k: int) -> Column:
        return let(paragraphs, lambda p: F.transform(F.slice(p, 1, F.greatest(F.size(p) - (k - 1), F.lit(0))), lambda t, i: F.array_join(F.slice(p, i + 1, k), "\n")))

    units = F.concat(unit("text", F.array("text")), *[unit("paragraph" if k == 1 else "paragraphs", runs(k)) for k in RUNS], unit("line", F.split("text", r"\n")))
    one = given.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.unit", "u.t").filter(F.col("t").rlike(ANCHOR))
    digests = one.select("doc_id", "unit", F.md5(canonical(F.col("t"))).alias("digest"))
    return digests.join(F.broadcast(known(docs.sparkSession)), "digest").groupBy("doc_id", "license_id", "unit").agg(F.count("*").alias("n"))


def oracle() -> str:
    """The same scan of ``documents`` in DuckDB's SQL, without the filters that save normalising."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    form = lambda c: f"trim({reduce(lambda t, r: f'regexp_replace({t}, {lit(r[0])}, {lit(r[1].replace("$2", chr(92) + "2"))}, {lit("g")})', RULES, f'lower({c})')})"
    rows = ", ".join(f"({lit(k)}, {lit(t)})" for k, t in known_texts())
    runs = " ".join(
        f"UNION ALL SELECT doc_id, '{'paragraph' if k == 1 else 'paragraphs'}', list_aggregate(p[i : i + {k - 1}], 'string_agg', chr(10)) FROM (SELECT doc_id, p, unnest(range(1, len(p) - {k - 2})) AS i FROM parts)" for k in RUNS
    )
    return f"""
        WITH known AS (SELECT md5({form('t')}) AS digest, min(k) AS license_id FROM (VALUES {rows}) v(k, t) GROUP BY 1),
        given AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL),
        parts AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n[ \t]*\n'), lambda t: trim(t, ' ') <> '') AS p FROM given),
        units AS (
            SELECT doc_id, 'text' AS unit, text AS t FROM given
            {runs}
            UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM given)
        SELECT doc_id, license_id, unit, count(*) AS n FROM (SELECT doc_id, unit, md5({form('t')}) AS digest FROM units) JOIN known USING (digest) GROUP BY ALL
    """

"""License scans: canonical digests of entire texts, hash-joined to the digests of known licences.

Only DataFrame functions run. A text is brought to a canonical form: A-Z lower-cased, equivalent spellings unified,
copyright lines dropped, everything but letters and digits turned into single spaces. The digest of the whole
canonical text is joined to the table of known texts; the canonical lines of the text are looked up in the same way
among the known one-line notices.

TEXTS holds the short licences and the file headers of some long ones. The long texts (Apache, GPL, MPL, CC, ...) aren't shipped:
`read_texts` reads a folder of them, a file each, named by licence, and `scan` takes that table beside the built-in one. A text
is known with and without its title line. A line is a copyright line if it begins like one and goes on with a sign, a
year or the place of one; so a sentence that a line break happens to start with "copyright holders" stays.

Defined results: a null text, or one that is empty in canonical form, has no digest and no licence; repeated rows are
judged alike; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from vexel.llm.common import ascii_lower
from vexel.shared import join_small

#: Equivalent spellings, applied in order to lower-cased text.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"), ("https:", "http:"), ("&", " and "),
    ("isation", "ization"), ("authoris", "authoriz"), ("recognis", "recogniz"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("favour", "favor"),
    ("labour", "labor"), ("programme", "program"), ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
]
#: A canonical line that begins like this isn't part of the licence.
COPYRIGHT = r"^(copyright|©|c) (c|©|yyyy|year)( |$)|^(copyright|©|c) (.* )?\d{4}( |$)|^(all|some) rights reserved$|^copyright$|^© "

#: One-line notices.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}

AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT,
OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

REDISTRIBUTION = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
"""
DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Other title lines.
TITLES = {"MIT": ["The MIT License (MIT)", "The MIT License", "MIT License (MIT)"], "BSD-3-Clause": ["The 3-Clause BSD License", "Revised BSD License"], "BSD-2-Clause": ["The 2-Clause BSD License"], "Unlicense": ["The Unlicense"]}
#: Entire licence texts.
TEXTS = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.

""" + AS_IS,
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

""" + AS_IS,
    "BSD-2-Clause": """BSD 2-Clause License

""" + REDISTRIBUTION + """
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.

""" + DISCLAIMER,
    "BSD-3-Clause": """BSD 3-Clause License

""" + REDISTRIBUTION + """
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.

""" + DISCLAIMER,
    "Zlib": """zlib License

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in
the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future
rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the
following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the
Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source
language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}


def canonical_lines(text: Column) -> Column:
    """The canonical lines of a text, without empty and copyright lines."""
    t = ascii_lower(text)
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    lines = F.split(F.regexp_replace(t, r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+", " "), r" *\n *")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(COPYRIGHT))


def variants(license: str, text: str) -> list[str]:
    """A text with each of its titles and without one; a first line of fewer than ten words that ends in no full stop is a title."""
    first, _, rest = text.lstrip().partition("\n")
    titled = len(first.split()) < 10 and not first.rstrip().endswith((".", ";", ":")) and rest.strip() != ""
    body = rest if titled else text
    return list(dict.fromkeys([text, body, *(f"{t}\n\n{body}" for t in TITLES.get(license, []))]))


def rows_known() -> list[tuple[str, bool, str]]:
    """(license, entire, text) of the texts and notices above."""
    texts = [(k, True, x) for k, t in TEXTS.items() for x in variants(k, t)]
    return texts + [(k, e, n) for k, ns in NOTICES.items() for n in ns for e in (True, False)]


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(license, text) of a folder of licence texts, a file each; the licence is the file's name without its ending."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.txt|\.md)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("license"), F.col("value").alias("text"))


def known(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """(license, entire, digest) of the texts and notices above, and of further texts (license, text), by the same functions as the corpus."""
    df = spark.createDataFrame(rows_known(), "license string, entire boolean, text string")
    if texts is not None:
        first = F.regexp_extract("text", r"^\s*([^\n]*)", 1)
        title = (F.size(F.split(F.trim(first), r"\s+")) < 10) & ~first.rlike(r"[.;:]\s*$")
        both = F.array("text", F.when(title, F.regexp_replace("text", r"^\s*[^\n]*\n", "")))
        df = df.unionByName(texts.select("license", F.lit(True).alias("entire"), F.explode(both).alias("text")).where("text is not null"))
    lines = df.select("license", "entire", canonical_lines(F.col("text")).alias("lines")).where(F.size("lines") > 0)
    return lines.select("license", "entire", F.md5(F.array_join("lines", " ")).alias("digest"))


def scan(docs: DataFrame, texts: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, digest, license, notices) for each row of docs: the digest of the whole canonical text, the licence whose text it
    is (else null), and the sorted licences, comma-joined, whose notices stand on lines of it. texts: further known texts
    (license, text)."""
    spark = docs.sparkSession
    table = known(spark, texts)
    lines = canonical_lines(F.col("text"))
    df = docs.select(id_col, F.coalesce(lines, F.array().cast("array<string>")).alias("__lines"))
    notices = [x for r in table.where("not entire").select("digest", "license").distinct().collect() for x in (F.lit(r[0]), F.lit(r[1]))]
    found = F.transform("__lines", lambda x: F.element_at(F.create_map(*notices), F.md5(x)))
    df = df.select(
        id_col,
        F.when(F.size("__lines") > 0, F.md5(F.array_join("__lines", " "))).alias("digest"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",").alias("notices"),
    )
    entire = table.where("entire").groupBy("digest").agg(F.min("license").alias("license"))
    return join_small(df, entire, ["digest"], "left").select(id_col, "digest", "license", "notices")

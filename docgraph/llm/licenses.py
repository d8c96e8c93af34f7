"""License scans: canonical digest lookup with DataFrame functions only.

A text is made canonical (lower case; copyright lines go; all but letters and digits parts words; whole words of equivalent
spellings become one) and its SHA-256 is hash-joined with the digests of known licence texts, which were made canonical by the same
expressions. Entire texts are looked up, and each line as an entire text of its own, which finds the notices that documents carry.
A line whose first word begins no known text is not one; all others are looked up. Known texts are a fixed list and what the
caller adds to it, up to ADDED texts, so their side of the join is of bounded size.

Null texts are empty; an empty canonical text matches nothing. A text that holds two licences matches neither as a whole.
Repeated rows get a result each. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts, names and the equivalent spellings of the public licence matching guidelines.
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("licencing", "licensing"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("non commercial", "noncommercial"), ("organisation", "organization"), ("organisations", "organizations"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("fulfil", "fulfill"),
    ("judgement", "judgment"), ("labour", "labor"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"), ("merchantability and fitness", "merchantability fitness"), ("https", "http"),
    ("version 1", "v1"), ("version 2", "v2"), ("version 3", "v3"), ("version 4", "v4"), ("version 5", "v5"),
)
NAMES = {
    "MIT": ("the MIT License", "MIT License", "the MIT license (MIT)"),
    "Apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache 2.0 License", "the Apache License, Version 2.0 (the \"License\")"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "GNU GPL License v2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "GNU GPL License v3"),
    "LGPL-2.1": ("the GNU Lesser General Public License, version 2.1", "the GNU Lesser General Public License v2.1"),
    "LGPL-3.0": ("the GNU Lesser General Public License, version 3", "the GNU Lesser General Public License v3.0"),
    "AGPL-3.0": ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3.0"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the New BSD License"),
    "ISC": ("the ISC License",),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "the Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "the Creative Commons Attribution-NoDerivatives 4.0 International License"),
}
FORMS = ("{}", "Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under {}", "This file is licensed under {}", "SPDX-License-Identifier: {}")
TEXTS = {
    "MIT": """MIT License
Copyright (c) <year> <holder>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License
Copyright (c) <year> <holder>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """BSD Zero Clause License
Copyright (c) <year> <holder>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib": """zlib License
Copyright (c) <year> <holder>
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "BSD-2-Clause": """BSD 2-Clause License
Copyright (c) <year>, <holder>
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """BSD 3-Clause License
Copyright (c) <year>, <holder>
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
}
#: Longer licences are files, named by licence: the texts as they are published.
FOLDER = Path(__file__).with_name("license_texts")
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|[<\[{]|by )|\(c\)[ \t]*[0-9]{4}|©|all rights reserved).*$"
FIRST_WORD = r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)"
#: Texts that a caller may add.
ADDED = 10_000


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of all known full texts, with and without their title line, and notices."""
    entire = TEXTS | {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(FOLDER.glob("*.txt"))}
    full = [(k, t) for k, text in entire.items() for t in (text, text.strip().split("\n", 1)[1])]
    return full + [(k, form.format(name)) for k, names in NAMES.items() for name in (*names, k) for form in FORMS]


def canonical(text: Column) -> Column:
    c = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    c = F.concat(F.lit("  "), F.regexp_replace(c, r"[^\p{L}\p{N}]+", "  "), F.lit("  "))  # each word has blanks of its own on either side
    for a, b in EQUIVALENT:
        c = F.replace(c, *(F.lit(f" {x.replace(' ', '  ')} ") for x in (a, b)))
    return F.trim(c)


def known(spark: SparkSession, added: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(license_digest, license_id), one row a digest."""
    return _canonical_known(spark, added).groupBy(F.sha2("c", 256).alias("license_digest")).agg(F.min("license_id").alias("license_id"))


def _canonical_known(spark: SparkSession, added: Sequence[tuple[str, str]]) -> DataFrame:
    if len(added) > ADDED:
        raise ValueError(f"{len(added)} texts were added; {ADDED} is the most")
    listed = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("t")) for k, t in [*known_texts(), *added]])
    return spark.range(1).select(F.explode(listed).alias("k")).select("k.license_id", canonical(F.col("k.t")).alias("c")).filter("c <> ''")


def first_words(spark: SparkSession, added: Sequence[tuple[str, str]] = ()) -> list[str]:
    """The words that known texts begin with, in all spellings, as they are before equivalent ones become one."""
    rows = _canonical_known(spark, added).select(F.substring_index("c", " ", 1).alias("w")).distinct().collect()  # of a fixed list
    words = {r["w"] for r in rows}
    return sorted(words | {a.split()[0] for a, b in EQUIVALENT if b.split()[0] in words})


def scan(docs: DataFrame, added: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """doc_id, text_sha256 (of the canonical text), license_id (of the entire text, or null), notices (sorted licences of lines). added: more
    known (licence, text) pairs."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    begins = first_words(spark, added)
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(F.regexp_extract(x, FIRST_WORD, 1)).isin(begins))
    whole = F.array(F.struct(F.lit(True).alias("entire"), F.sha2(canonical(text), 256).alias("digest")))
    of_lines = F.transform(lines, lambda x: F.struct(F.lit(False).alias("entire"), F.sha2(canonical(x), 256).alias("digest")))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.concat(whole, of_lines).alias("c"))
    rows = rows.select("doc_id", "_row", F.explode("c").alias("c"))
    rows = rows.select("doc_id", "_row", F.col("c.entire").alias("entire"), F.col("c.digest").alias("digest"))
    rows = rows.join(F.broadcast(known(spark, added)), F.col("digest") == F.col("license_digest"), "left")  # a fixed list
    found = rows.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max(F.when(F.col("entire"), F.col("digest"))).alias("text_sha256"),
        F.max(F.when(F.col("entire"), F.col("license_id"))).alias("license_id"),
        F.sort_array(F.collect_set(F.when(~F.col("entire"), F.col("license_id")))).alias("notices"),
    )
    return found.drop("_row")

"""License scans by canonical digests.

A text is put into canonical form: lower case, copyright lines gone, punctuation and white space to single blanks, equivalent
spellings to one. Its SHA-256 meets the digests of known licence texts and notices in a hash join. Entire texts are looked up, and
so is every line as an entire text of its own, for the notices that documents carry. Known texts are a fixed list, the short ones in
this module and published long ones in ``license_texts`` (or the caller's, whose size is checked), put into canonical form by the same expressions, and broadcast.

Null and empty texts, and texts of nothing but punctuation or copyright lines, match nothing; rows that repeat are each looked up;
a null doc_id is carried through; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import functools
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from syllabary.llm.common import text_of

#: (spelling, the one that stands for it), as whole words of a canonical text.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("organisation", "organization"), ("organisations", "organizations"), ("acknowledgement", "acknowledgment"), ("whilst", "while"),
    ("merchantibility", "merchantability"), ("wilful", "willful"), ("noncommercial", "non commercial"), ("favour", "favor"),
    ("analog", "analogue"), ("judgement", "judgment"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("v2 0", "version 2 0"),
)
COPYRIGHT = r"(^|\n)[ \t#*/;-]*((copyright[ \t]*)?(\(c\)|©)|copyright[ \t]*[0-9<\[{]|copyright by |all rights reserved)[^\n]*"
#: What a line must hold for the pattern above to be tried.
COPYRIGHT_MARKS = ("copyright", "(c)", "©", "all rights reserved")
PUNCTUATION = r"[!-/:-@\[-`{-~“”‘’«»–—\x00-\x1f\x{00A0}]+"
#: Known texts that a caller may give.
MOST_KNOWN = 20_000

_NAMES = (
    ("MIT", ("MIT License", "MIT licence", "MIT")),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GPL version 2", "GPL-2.0")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GPL version 3", "GPL-3.0")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "LGPL-3.0")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "AGPL-3.0")),
    ("MPL-2.0", ("Mozilla Public License, version 2.0", "MPL-2.0")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "BSD-3-Clause")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "BSD-2-Clause")),
    ("ISC", ("ISC License", "ISC")),
    ("CC0-1.0", ("CC0 1.0", "Creative Commons Zero 1.0 Universal")),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
)
_NOTICES = ("Licensed under {}", "Licensed under the {}", "Released under the {}", "Released under {}", "Distributed under the {}",
            "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}",
            "This file is licensed under the {}", "This program is licensed under the {}", "SPDX-License-Identifier: {}", "License: {}")
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_AUTHOR = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:
"""
_BSD_TERMS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this
software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_BSL = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and
to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to
the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such
copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_APACHE_HEAD = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at"""
_APACHE_END = """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License."""


def _bsd(terms: int, title: str) -> tuple[str, ...]:
    """The BSD text of so many terms: numbered or with bullets, with and without its title."""
    forms = ["\n".join([_BSD_HEAD, *(f"{mark.format(i)} {t}" for i, t in enumerate(_BSD_TERMS[:terms], 1)), _BSD_END]) for mark in ("{}.", "*")]
    return (*forms, *(f"{title}\n{x}" for x in forms))


_TEXTS = (
    ("MIT", _MIT + _WARRANTY),
    ("MIT", "MIT License\n" + _MIT + _WARRANTY),
    ("MIT", "The MIT License (MIT)\n" + _MIT + _WARRANTY),
    ("ISC", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_AUTHOR}"),
    ("ISC", f"ISC License\n{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_AUTHOR}"),
    ("0BSD", f"{_ISC}.\n{_AUTHOR}"),
    *(("BSD-2-Clause", x) for x in _bsd(2, "BSD 2-Clause License")),
    *(("BSD-3-Clause", x) for x in _bsd(3, "BSD 3-Clause License")),
    ("Zlib", _ZLIB), ("Zlib", "zlib License\n" + _ZLIB),
    *(("Unlicense", _UNLICENSE + f"For more information, please refer to <{at}unlicense.org{end}>") for at in ("http://", "https://") for end in ("", "/")),
    ("BSL-1.0", _BSL), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n" + _BSL),
    ("Apache-2.0", _APACHE_HEAD),
    *(("Apache-2.0", f"{_APACHE_HEAD}\n{at}://www.apache.org/licenses/LICENSE-2.0\n{_APACHE_END}") for at in ("http", "https")),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),
)


#: Where the appendix begins that tells how to apply a licence; texts are known with and without it.
TERMS_END = "END OF TERMS AND CONDITIONS"


@functools.cache
def full_texts() -> tuple[tuple[str, str], ...]:
    """(license id, text) of the published texts in ``license_texts``, one file each; the file's name is the id."""
    out = []
    for file in sorted((resources.files(__package__) / "license_texts").iterdir(), key=lambda f: f.name):
        key, text = file.name.removesuffix(".txt"), file.read_text("utf-8")
        terms, end, appendix = text.partition(TERMS_END)
        out += [(key, text)] + ([(key, terms + end), (key, terms)] if appendix else [])
    return tuple(out)


def known_texts() -> list[tuple[str, str]]:
    """(license id, text) of every known licence text and notice."""
    notices = [(key, form.format(name)) for key, names in _NAMES for name in names for form in _NOTICES]
    return [*_TEXTS, *full_texts(), *notices]


def _let(x: Column, body) -> Column:
    """``body(x)`` with x computed once, however often the body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def canonical(text: Column) -> Column:
    """The canonical form of a text."""

    def without_copyright(low: Column) -> Column:
        marked = F.contains(low, F.lit(COPYRIGHT_MARKS[0]))
        for mark in COPYRIGHT_MARKS[1:]:
            marked = marked | F.contains(low, F.lit(mark))
        return F.when(marked, F.regexp_replace(low, COPYRIGHT, "\n")).otherwise(low)

    out = F.concat(F.lit(" "), F.regexp_replace(_let(F.lower(text), without_copyright), PUNCTUATION, " "), F.lit(" "))
    out = F.regexp_replace(out, " {2,}", " ")
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelling} "), F.lit(f" {one} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null where that is empty."""
    return _let(canonical(text), lambda form: F.when(form != "", F.sha2(form, 256)))


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """``known_digest, license``; the first license in code point order where several share a text."""
    if len(known) > MOST_KNOWN:
        raise ValueError(f"{len(known)} known texts; a broadcast holds {MOST_KNOWN}")
    rows = spark.createDataFrame(known, "license string, text string").coalesce(1)
    return rows.groupBy(digest(F.col("text")).alias("known_digest")).agg(F.min("license").alias("license")).filter("known_digest is not null")


#: Between blocks: a line of nothing but blanks and comment marks.
BLANK_LINE = r"\n[ \t\r#*/;-]*\n"


def scan_blocks(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id, n_blocks, licenses``: the blocks between blank lines that are known texts or notices, however they are wrapped."""
    digests = F.broadcast(known_digests(docs.sparkSession, known_texts() if known is None else known))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("id0"), F.xxhash64("doc_id", "text").alias("h0"), text_of().alias("text"))
    blocks = keyed.select("id0", "h0", F.posexplode(F.transform(F.split("text", BLANK_LINE), digest)).alias("at", "block"))
    hits = blocks.join(digests, F.col("block") == F.col("known_digest")).groupBy("id0", "h0").agg(F.collect_set(F.struct("at", "license")).alias("found"))
    rows = keyed.drop("text").join(hits, ["id0", "h0"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<at:int,license:string>>")))
    return rows.select("doc_id", F.size("found").cast("long").alias("n_blocks"), F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"))


def scan(docs: DataFrame, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id, digest, license, n_notices, notices``: the digest and license of the entire text, the number of lines that are
    notices, and their licenses, sorted."""
    digests = F.broadcast(known_digests(docs.sparkSession, known_texts() if known is None else known))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(-1)).alias("id0"), F.xxhash64("doc_id", "text").alias("h0"), text_of().alias("text"))
    lines = keyed.select("id0", "h0", F.posexplode(F.transform(F.split("text", "\n"), digest)).alias("at", "line"))
    hits = lines.join(digests, F.col("line") == F.col("known_digest")).groupBy("id0", "h0").agg(F.collect_set(F.struct("at", "license")).alias("found"))
    rows = keyed.withColumn("digest", digest(F.col("text"))).drop("text").join(digests, F.col("digest") == F.col("known_digest"), "left")
    rows = rows.join(hits, ["id0", "h0"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<at:int,license:string>>")))
    notices = F.array_join(F.array_sort(F.array_distinct("found.license")), ",")
    return rows.select("doc_id", "digest", "license", F.size("found").cast("long").alias("n_notices"), notices.alias("notices"))

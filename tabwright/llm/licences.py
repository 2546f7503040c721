"""Licence scan by canonical digests: texts are normalised and whole texts joined to known licences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import renamed

# fixed values: public licence texts, and the names that usual notices give
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

{one} Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

{two} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

{three}THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NEITHER = """{three} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""
GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details.

You should have received a copy of the GNU {kind}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
# licence, its usual titles, its text
BODIES = [
    ("MIT", ("", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT"), MIT),
    ("ISC", ("", "ISC License", "The ISC License", "ISC License (ISC)"), ISC),
    ("BSD-2-Clause", ("", "BSD 2-Clause License", "The BSD 2-Clause License", "BSD License"), BSD.format(one="1.", two="2.", three="")),
    ("BSD-2-Clause", ("", "BSD 2-Clause License", "The BSD 2-Clause License", "BSD License"), BSD.format(one="*", two="*", three="")),
    ("BSD-3-Clause", ("", "BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License"),
     BSD.format(one="1.", two="2.", three=NEITHER.format(three="3."))),
    ("BSD-3-Clause", ("", "BSD 3-Clause License", "The BSD 3-Clause License", "BSD License", "New BSD License"),
     BSD.format(one="*", two="*", three=NEITHER.format(three="*"))),
    ("Apache-2.0", ("",), APACHE_NOTICE), ("MPL-2.0", ("",), MPL_NOTICE),
    ("GPL-2.0", ("",), GNU_NOTICE.format(kind="", version=2)), ("GPL-3.0", ("",), GNU_NOTICE.format(kind="", version=3)),
    ("LGPL-3.0", ("",), GNU_NOTICE.format(kind="Lesser ", version=3)), ("AGPL-3.0", ("",), GNU_NOTICE.format(kind="Affero ", version=3))]
# canonical digests of long published texts: whole, and up to the line that ends their terms, with and without that line
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809"),
    ("Apache-2.0", "4db164cc277b72e3d03f4161513c53b32de1cf3a402162a025e00d038383a74f"),
    ("Apache-2.0", "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93"),
    ("Artistic-1.0", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71"),
    ("GFDL-1.3", "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6"),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0", "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "ca11016cfa35488a51cd96aafc50e735c7f8da97b6bbad8a2ae1c5c4f641fc6d"),
    ("MPL-2.0", "263edff82d69a42f3742042ce624238051bd69fa2d4f817c192f63621765b324"),
]
END_OF_TERMS = "END OF TERMS AND CONDITIONS"
NAMES = [("MIT", "MIT License"), ("ISC", "ISC License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"),
         ("Apache-2.0", "Apache-2.0"), ("Apache-2.0", "Apache 2.0 License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
         ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-3.0", "GNU General Public License, version 3"), ("GPL-3.0", "GNU General Public License v3.0"),
         ("GPL-2.0", "GNU General Public License v2.0"), ("GPL-2.0", "GPLv2"), ("GPL-3.0", "GPLv3"),
         ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("AGPL-3.0", "GNU Affero General Public License, version 3"),
         ("MPL-2.0", "Mozilla Public License 2.0"), ("MPL-2.0", "Mozilla Public License, v. 2.0"), ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"),
         ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
         ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"), ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")]
SUBJECTS = ["", "This work is ", "This software is ", "This project is ", "This program is ", "This code is "]
VERBS = ["licensed", "released", "distributed", "available"]
ARTICLES = [" under ", " under the ", " under the terms of the "]
TAILS = [".", ". See LICENSE.", ". See the LICENSE file for details."]
# equivalent spellings, applied in this order to lower-cased words with single spaces; not across a line break
SPELLINGS = [("licence", "license"), ("licencing", "licensing"), ("sub licens", "sublicens"), ("copyright (owner|proprietor)", "copyright holder"),
             ("non infring", "noninfring"), ("whilst", "while"), ("favour", "favor"), ("organisation", "organization"), ("http ", "https ")]
COPYRIGHT = "(^|\\n)[^a-z0-9\\n]*(copyright [^a-z\\n]*(by |[0-9])|copyright *(\\(c\\)|©)|\\(c\\) *[0-9]|©|all +rights +reserved)[^\\n]*"
# a licence sentence behind a copyright statement starts a line of its own: groups 1 and 6 are kept
STATEMENT = f"({COPYRIGHT}?)((this [a-z]+ is )?({'|'.join(VERBS)}) under )"
PUNCTUATION = "[^a-z0-9\\n\\x{80}-\\x{10FFFF}]+"
MARKS = "“”„‘’«»–—•…©"


# without one of these a text has no copyright line, and no spelling to change
COPYRIGHT_SIGNS = ("copyright", "(c)", "©", "rights")
SPELLING_SIGNS = ("licenc", "sub licens", "copyright owner", "copyright proprietor", "non infring", "whilst", "favour", "organisation", "http ")


def _has(text: Column, signs: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(s) for s in signs])


def with_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``lines`` in place of a text column: its lines with words, canonical.

    Lower case, no copyright statements, one spelling, words only, single spaces.
    Every rule works inside a line, so the canonical form of an entire text is
    that of its lines, joined by a space (``canonical``): one pass serves both.
    """
    at = F.col(text)
    steps = [F.lower(at),
             F.when(_has(at, COPYRIGHT_SIGNS), F.regexp_replace(F.regexp_replace(at, STATEMENT, "$1\n$6"), COPYRIGHT, "\n")).otherwise(at),
             F.when(F.length(at) == F.octet_length(at), at).otherwise(F.translate(at, MARKS, " " * len(MARKS))),
             F.regexp_replace(at, PUNCTUATION, " "),
             F.when(_has(at, SPELLING_SIGNS), reduce(lambda t, s: F.regexp_replace(t, *s), SPELLINGS, at)).otherwise(at)]
    for step in steps:  # a column each, so that nothing is made again for each mention
        df = df.withColumn(text, step)
    lines = F.transform(F.split(at, "\n"), lambda x: F.trim(x))
    return df.withColumn("lines", F.filter(lines, lambda x: x != "")).drop(text)


def canonical(lines: Column) -> Column:
    """The canonical form of the entire text whose ``lines`` are given."""
    return F.array_join(lines, " ")


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): licence texts under their usual titles and, by rule, the one-line notices."""
    whole = [(name, f"{title}\n\n{body}") for name, titles, body in BODIES for title in titles]
    return whole + [(name, subject + verb + article + words + tail) for subject in SUBJECTS for verb in VERBS for article in ARTICLES
                    for name, words in NAMES for tail in TAILS]


def digests_of(texts: DataFrame) -> DataFrame:
    """(licence, digest) of a table (licence, text)."""
    return with_lines(texts).select("licence", F.sha2(canonical(F.col("lines")), 256).alias("digest")).distinct()


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(licence, digest) of ``texts``, or of the built-in texts, notices and ``DIGESTS``."""
    found = digests_of(spark.createDataFrame(known_texts() if texts is None else texts, "licence string, text string"))
    return found if texts is not None else found.union(spark.createDataFrame(DIGESTS, "licence string, digest string")).distinct()


def scan_licences(df: DataFrame, key: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(key, licence, notices): one row for each row of ``df``.

    ``licence`` is the known licence whose canonical digest the entire text has
    (the smallest name if several share one), else null; ``notices`` lists, in
    order and once each, the licences that an entire line of it has. ``known``
    (licence, digest) defaults to the built-in texts, and only it is broadcast:
    pass a bounded table. Texts that are blank once canonical match nothing, so
    null and empty texts have no licence. Rows of equal key and text get equal
    results, null keys too; other columns are ignored.
    """
    known = known_digests(df.sparkSession) if known is None else known
    docs = renamed(df, key=key, text=text).select("key", F.xxhash64("text").alias("text_id"), "text")
    docs_lines = with_lines(docs.filter("text is not null"))
    parts = F.concat(F.array(F.struct(F.lit(True).alias("whole"), canonical(F.col("lines")).alias("part"))),
                     F.transform(F.array_distinct("lines"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("part"))))
    # the outer form and the coalesce: without them Spark filters on the parts and digests before, and makes them a second time for it
    units = docs_lines.select("key", "text_id", F.explode_outer(parts).alias("unit")).filter("unit.part <> ''").select(
        "key", "text_id", "unit.whole", F.coalesce(F.sha2("unit.part", 256), F.lit("")).alias("digest"))
    found = units.join(F.broadcast(known), "digest").groupBy("key", "text_id").agg(
        F.min(F.when(F.col("whole"), F.col("licence"))).alias("licence"), F.collect_set(F.when(~F.col("whole"), F.col("licence"))).alias("notices"))
    a, b = docs.select("key", "text_id").alias("a"), found.alias("b")
    both = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.text_id") == F.col("b.text_id")), "left")
    notices = F.array_sort(F.coalesce("notices", F.array().cast("array<string>")))
    return both.select(F.col("a.key").alias(key), "licence", notices.alias("notices"))

"""Licence scan by canonical digests, in DataFrame functions only.

A text's canonical form drops copyright notices and "All rights reserved." lines, turns punctuation and white space into single spaces, folds case and writes
equivalent spellings one way. Its SHA-256 is joined with the digests of known licence texts, which pass through the same
form. Whole texts are looked up; so is each line that mentions a licence, as notices such as "Released under the MIT
License." stand alone in a document. Null and empty texts match nothing; repeated rows are each looked up. Very long texts are hashed whole. Other columns of any
name are not read, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import local_frame

# Spellings that count as equal when licence texts are compared.
EQUIVALENT = [("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("copyright holder", "copyright owner"),
              ("copyright holders", "copyright owners"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("favour", "favor"),
              ("behaviour", "behavior"), ("organisation", "organization"), ("whilst", "while"), ("wilful", "willful"), ("per cent", "percent"),
              ("gpl", "general public license"), ("version 2 0", "version 2"), ("version 3 0", "version 3")]
# Lines that are notices: copyright with a sign or year, or with a name; licence prose wrapped before the word stays.
COPYRIGHT_LINE = (r"(?im)^[ \t/*#;-]*(?:copyright\b[^\n]*(?:\(c\)|©|\b(?:19|20)[0-9]{2}\b)[^\n]*"
                  r"|copyright[,:]?[ \t]+(?:by[ \t]+)?(?!(?:notices?|holders?|owners?|laws?|licen[cs]e[sd]?|statements?|and|or|on|in|is|of|to|as)\b)(?-i:[A-Z<\[{]|[^\x00-\x7F])[^\n]*"
                  r"|©[^\n]*|\(c\)[ \t]*(?:copyright\b|[^\n]*\b(?:19|20)[0-9]{2}\b)[^\n]*|\(c\)(?:[ \t]+(?:(?-i:[A-Z])\S*|and|the|of|by|contributors|&))+[ \t*/#]*"
                  r"|all[ \t]+rights[ \t]+reserved\.?[ \t*/#]*)$")
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F‘’“”–—…©•·\u00A0]+"
NOTICE = r"(?i)licen[cs]e|creative commons|public domain|spdx|\bcc[ -]by\b|\bcc[ -]?0\b"

MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
# Public licence texts and notices.
KNOWN = [
    ("MIT", MIT_BODY), ("MIT", "MIT License\n\n" + MIT_BODY), ("MIT", "The MIT License (MIT)\n\n" + MIT_BODY),
    ("0BSD", f"{ISC_GRANT}.\n{ISC_WARRANTY}"), ("0BSD", f"BSD Zero Clause License\n{ISC_GRANT}.\n{ISC_WARRANTY}"),
    ("ISC", f"{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{ISC_WARRANTY}"),
    ("ISC", f"ISC License\n{ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{ISC_WARRANTY}"),
    ("BSD-2-Clause", f"{BSD_HEAD}\n{BSD_TAIL}"), ("BSD-2-Clause", f"BSD 2-Clause License\n{BSD_HEAD}\n{BSD_TAIL}"),
    ("BSD-3-Clause", f"{BSD_HEAD}\n{BSD_THIRD}\n{BSD_TAIL}"), ("BSD-3-Clause", f"BSD 3-Clause License\n{BSD_HEAD}\n{BSD_THIRD}\n{BSD_TAIL}"),
    ("Apache-2.0", APACHE_NOTICE), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", "Licensed under the GNU GPL, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."), ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
# Digests of the canonical forms of longer licence texts, as published, with their appendices. They hold for
# canonical() as it is: after a change there they have to be made again.
KNOWN_DIGESTS = [
    ("Apache-2.0", "c8d2aa544a47107a1313326d08631799d7732b4ea61f56a31a3092142a95dd37"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GPL-1.0", "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f"),
    ("GPL-2.0", "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6"),
    ("GPL-3.0", "50d8b0a9c1269d769a3055a9f07c2cc1380d7c0b5419a26e55aff1a3839cfafd"),
    ("LGPL-2.0", "548b377baab9abc6db389c5cb4f0a23dd569f7a693c975a404d5236cb931778a"),
    ("LGPL-2.1", "b46de8959b6f2dc5b6059998870dfa1cc3154e4462202209195f3b933d67559d"),
    ("LGPL-3.0", "af4f466bab5554afad60c219ff8bf29eddb00df6ef0f1fcf73fa05ad4b3289f5"),
    ("MPL-1.1", "9c38a92c43b96c05d7c74eae14658e08f767c6c8865f2bf2143a1fb58853f1f0"),
    ("MPL-2.0", "22c9324e5634aa07c32060365e6191d4f9ec61fafc6091ce7394333c6d7db95e"),
    ("GFDL-1.2", "bd8e32052e49e6b79fccbdd5dc03f7d40e45a8e895e3ecb79394b97961ffb127"),
    ("GFDL-1.3", "e7579a53c7b8214f091590d94bfe39deb978a080895ca5506448b8baf4f77985"),
    ("Artistic-1.0", "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93"),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty for null."""
    x = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), COPYRIGHT_LINE, " ")
    x = F.concat(F.lit(" "), F.regexp_replace(F.lower(x), PUNCTUATION, " "), F.lit(" "))
    for old, new in EQUIVALENT:
        for _ in range(2):                          # neighbours share a blank: the second pass meets every other one
            x = F.replace(x, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.btrim(x)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """license_id and digest of each known text and digest: as many rows as the lists have."""
    rows = local_frame(spark, known, "license_id string, known string").select("license_id", F.sha2(canonical(F.col("known")), 256).alias("digest"))
    return rows.unionByName(local_frame(spark, KNOWN_DIGESTS, "license_id string, digest string")).dropDuplicates(["digest"])


def scan(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """doc_id, license_id (of the whole text, or null), notices (sorted distinct ids of lines that are known notices, joined
    by commas) and n_notice_lines, one row per row.

    Both look-ups are joins on the digest. The lines' one touches only rows that hold a word of `NOTICE`, and its counts go
    back by a row number that lives for this job alone, so repeated and null doc_ids stay apart.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(NOTICE))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("t")), 256).alias("digest"), F.when(F.col("t").rlike(NOTICE), lines).alias("lines"))
    whole = rows.join(digests, "digest", "left").select("doc_id", "license_id", "lines")
    known = F.transform("lines", lambda x: F.sha2(canonical(x), 256))
    whole = whole.select("doc_id", "license_id", known.alias("line_digests"))
    plain = whole.filter(F.coalesce(F.size("line_digests"), F.lit(0)) <= 0).select("doc_id", "license_id", F.lit("").alias("notices"), F.lit(0).cast("long").alias("n_notice_lines"))
    some = whole.filter(F.size("line_digests") > 0).withColumn("row", F.monotonically_increasing_id())
    found = some.select("doc_id", "license_id", "row", F.explode("line_digests").alias("digest")).join(digests.withColumnRenamed("license_id", "notice"), "digest", "left")
    noticed = found.groupBy("row", "doc_id", "license_id").agg(F.array_join(F.sort_array(F.collect_set("notice")), ",").alias("notices"), F.count("notice").alias("n_notice_lines"))
    return plain.unionByName(noticed.drop("row"))

"""License scans by canonical digests (operator 1).

A text is brought into a canonical form - lower case, copyright lines removed,
punctuation and white space to single spaces, equivalent spellings unified -
and the digest of the whole form is looked up by a hash join in the table of
known licence texts. The same lookup over single lines finds short licence
notices, each line being an entire text of its own. Everything is built-in
functions; both tables of known digests are made from constants (the longer
texts in ``license_texts``), so their broadcast is bounded.

Null and empty texts match nothing. Repeated rows give repeated results, rows
without doc_id are looked up as well; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import pkgutil
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Patterns valid for Java and RE2 alike.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;.>-]*((copyright[ \t]*(\(c\)|©|[0-9]{4}|<|\[|:))|\(c\)[ \t]*[0-9]{4}|©|all rights reserved)[^\n]*"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Equivalent spellings, word starts included.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authoris", "authoriz"), ("behaviour", "behavior"), ("cancelled", "canceled"), ("catalogue", "catalog"),
    ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasis", "emphasiz"), ("favour", "favor"),
    ("fulfill", "fulfil"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"),
    ("merchantibility", "merchantability"), ("modelling", "modeling"), ("non commercial", "noncommercial"),
    ("offence", "offense"), ("organis", "organiz"), ("per cent", "percent"), ("practise", "practice"),
    ("programme ", "program "), ("recognis", "recogniz"), ("sub license", "sublicense"), ("utilis", "utiliz"),
    ("whilst", "while"), ("wilful", "willful"),
)

# Licence texts, without their copyright lines.
_WARRANTY_MIT = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
    "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL "
    "THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
    "DEALINGS IN THE SOFTWARE.")
_WARRANTY_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR "
    "PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION "
    "WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.")
_WARRANTY_BSD = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. ")
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
    "to permit persons to whom the Software is furnished to do so")
LICENSE_TEXTS = (
    ("MIT", _MIT_GRANT + ", subject to the following conditions: The above copyright notice and this permission "
     "notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY_MIT),
    ("MIT-0", _MIT_GRANT + ". " + _WARRANTY_MIT),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     + _WARRANTY_ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted. " + _WARRANTY_ISC),
    ("BSD-2-Clause", _BSD_START + _WARRANTY_BSD),
    ("BSD-3-Clause", _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be "
     "used to endorse or promote products derived from this software without specific prior written permission. "
     + _WARRANTY_BSD),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
     "be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
     "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
     "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not "
     "claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
     "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly "
     "marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed "
     "or altered from any source distribution."),
)
TITLES = (("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "MIT License (MIT)"), ("MIT", "The MIT License (MIT)"),
          ("ISC", "ISC License"), ("ISC", "The ISC License"), ("ISC", "ISC License (ISC)"), ("Zlib", "zlib License"),
          ("Zlib", "The zlib License"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "The BSD 2-Clause License"),
          ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", "The BSD 3-Clause License"))
# Signs before the clauses of a text: as they stand, bullets, letters, Roman numbers.
CLAUSES = ("123", "***", "abc", ("i", "ii", "iii"))
# Long texts, one file each; the part that follows these words is often left out.
LONG_TEXTS = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")
LAST_WORDS = "END OF TERMS AND CONDITIONS"

# Licence names as they stand in notices.
NAMES = (
    ("MIT", "MIT License"), ("MIT", "MIT"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"), ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("MPL-2.0", "Mozilla Public License, version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"),
    ("CC0-1.0", "CC0 1.0"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC-BY-ND-4.0", "CC BY-ND 4.0"), ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
)
NOTICES = ("Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.",
           "This work is licensed under {}.", "This work is licensed under the {}.", "License: {}")


# Identifiers of tag lines; those of the GNU licences also end in -only or -or-later.
TAGS = ("0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0",
        "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0",
        "MIT", "MIT-0", "MPL-2.0", "Unlicense", "Zlib")
MARK = "licen[cs]e|released"


def _clause_forms(body: str) -> list[str]:
    forms = [re.sub(r" ([1-3])\. ", lambda m, signs=signs: f" {signs[int(m[1]) - 1]} ", body) for signs in CLAUSES]
    return list(dict.fromkeys(forms))


def long_texts() -> list[tuple[str, str]]:
    out = []
    for name in LONG_TEXTS:
        text = pkgutil.get_data("metrolens.llm", f"license_texts/{name}.txt").decode()
        head, words, rest = text.partition(LAST_WORDS)
        out += [(name, text)] + ([(name, head + words)] if rest.strip() else [])
    return out


def known_texts() -> list[tuple[str, str]]:
    return [(name, text) for name, body in LICENSE_TEXTS for form in _clause_forms(body)
            for text in [form] + [f"{title}\n\n{form}" for i, title in TITLES if i == name]] + long_texts()


def known_notices() -> list[tuple[str, str]]:
    tags = [(tag, tag + end) for tag in TAGS for end in (("", "-only", "-or-later") if "GPL" in tag else ("",))]
    return ([(spdx, form.format(name)) for spdx, name in NAMES for form in NOTICES]
            + [(spdx, f"SPDX-License-Identifier: {tag}") for spdx, tag in tags])


def all_marked(notices: list[tuple[str, str]]) -> bool:
    """Whether the canonical form of every notice holds ``MARK``, so that lines without it are no notices."""
    plain = (re.sub(COPYRIGHT_LINE, "\n", text.translate(str.maketrans(UPPER, LOWER))) for _, text in notices)
    return all(re.search(MARK, text) for text in plain)


def canonical(text: Column) -> Column:
    t = F.translate(text, UPPER, LOWER)
    t = F.regexp_replace(t, COPYRIGHT_LINE, "\n")
    t = F.concat(F.lit(" "), F.regexp_replace(t, NOT_WORD, " "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(" " + a), F.lit(" " + b))
    return F.trim(t)


def digest(text: Column) -> Column:
    return F.md5(canonical(text).cast("binary"))


def digests(spark: SparkSession, known: list[tuple[str, str]], name: str) -> DataFrame:
    """(known_digest, ``name``): one row per digest."""
    table = spark.createDataFrame(known, f"{name} string, text string")
    return table.groupBy(digest(F.col("text")).alias("known_digest")).agg(F.min(name).alias(name))


def license_scan(spark: SparkSession, docs: DataFrame, texts: list | None = None, notices: list | None = None) -> DataFrame:
    """doc_id, text_digest, license_id (whole text), notice_ids (sorted, comma
    separated; empty if none) and n_notices (lines) of every row."""
    whole = F.broadcast(digests(spark, texts or known_texts(), "license_id"))
    notices = notices or known_notices()
    short = F.broadcast(digests(spark, notices, "notice_id"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row_digest", F.md5(F.col("text").cast("binary")))
    base = rows.select("doc_id", "row_digest", digest(F.col("text")).alias("text_digest"))
    base = base.join(whole, F.col("text_digest") == F.col("known_digest"), "left").drop("known_digest")
    marked = (lambda c: F.lower(c).rlike(MARK)) if all_marked(notices) else (lambda c: F.lit(True))
    lines = (rows.where(marked("text"))
             .select("doc_id", "row_digest", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
             .where(marked("line")))
    found = (lines.join(short, digest(F.col("line")) == F.col("known_digest"))
             .groupBy(F.col("doc_id").alias("d"), F.col("row_digest").alias("r"))
             .agg(F.array_join(F.array_sort(F.collect_set("notice_id")), ",").alias("notice_ids"),
                  F.countDistinct("pos").alias("n_notices")))
    return base.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_digest") == F.col("r")), "left").select(
        "doc_id", "text_digest", "license_id", F.coalesce("notice_ids", F.lit("")).alias("notice_ids"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"))

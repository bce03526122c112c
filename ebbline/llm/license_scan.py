"""Licence scan: canonical digests of whole texts and whole lines, hash-joined with known ones.

A unit of text (the document, and each of its lines) is brought to a canonical
form: lower case, no copyright lines, all but letters and digits (of any script)
as single blanks, equivalent spellings made one. Two units with equal form have equal digests, so
a join on the digest finds the licence texts and notices however they are set.
The known texts are a fixed table of this module and small; the documents are
not shuffled for the join, only the few units that matched are grouped.
Column functions only.

Defined cases: null and empty texts have no licence; repeated rows get equal
results; a null ``doc_id`` keeps its row; only ``doc_id`` and ``text`` are read; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licences use for the same word, after punctuation became blanks.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("whilst", "while"),
    ("https", "http"),
)

#: Lines that state whose work it is; they differ from copy to copy.
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright[ \t]+(\(c\)|©|[0-9]{4})|\(c\)|©|all rights reserved)[^\n]*"

#: Notices of one line.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)

#: Whole licence texts, without their copyright lines.
TEXTS = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF '
        "ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR "
        "A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        '\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
        "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE "
        'COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
        "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN "
        "ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software."
        "\n\n3. This notice may not be removed or altered from any source distribution.",
    ),
)

#: Title lines that stand above the texts of this module.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License"),
    "Zlib": ("zlib License", "The zlib License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
}

_TWO = next(text for name, text in TEXTS if name == "BSD-2-Clause")
_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n\n"
)
#: Long texts, word for word, one file each in ``licenses``.
FILES = (
    "Apache-2.0 CC-BY-4.0 CC0-1.0 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 MPL-1.1 MPL-2.0 Unlicense"
).split()


def _variants(name: str, text: str) -> list[str]:
    """The text, without its appendix on how to apply it, and without the line to fill in; each also with a title."""
    forms = [text]
    head, end, _ = text.partition("END OF TERMS AND CONDITIONS")
    if end:
        forms += [head, head + end]
    forms += [re.sub(r"\n[^\n]*Copyright \[yyyy\][^\n]*", "", text)]
    return [title + form for form in dict.fromkeys(forms) for title in ("", *(f"{t}\n\n" for t in TITLES.get(name, ())))]


def _read(name: str) -> str:
    return resources.files("ebbline.llm").joinpath("licenses", f"{name}.txt").read_text("utf-8")


#: Single texts, before their variants: what may stand inside a longer document.
BODIES = (*TEXTS, ("BSD-3-Clause", _TWO.replace("THIS SOFTWARE IS", _NAMES + "THIS SOFTWARE IS")), *((n, _read(n)) for n in FILES))
TEXTS = tuple((name, form) for name, text in BODIES for form in _variants(name, text))

#: Every known text and notice holds one of these in its canonical form, so a text without them, in any of their
#: spellings, holds none. Letters that stand together in a canonical form do so in the text.
TRIGGERS = ("license", "permission", "redistribution")
TRIGGER = r"(?iu)licen[sc]e|permission|redistribution"

#: How a comment line begins, and where blocks end: at lines without letters and digits, and at a comment's edges.
COMMENT = r"[ \t]*+(?:#|//|/\*|\*|--|;|%)"
EDGES = (rf"(?m)^({COMMENT}[^\n]*\n)(?!{COMMENT})", rf"(?m)^((?!{COMMENT})[^\n]*\n)(?={COMMENT})")
BLANK = r"\n(?:[^\p{L}\p{N}\n]*+\n)+"


def canonical(text: Column) -> Column:
    """The form in which copies of a licence are equal."""
    plain = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "\n")
    plain = F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))
    for spelling, one in SPELLINGS:
        plain = F.replace(plain, F.lit(spelling), F.lit(one))
    return plain


def known_licenses(spark: SparkSession, extra: list[tuple[str, str]] | None = None) -> DataFrame:
    """Digest and name of every known notice and text: a fixed table, and what the caller adds."""
    rows = spark.createDataFrame([*NOTICES, *TEXTS, *(extra or [])], "license string, text string")
    return rows.select("license", F.md5(canonical(F.col("text"))).alias("digest")).distinct()


def blocks(text: Column) -> Column:
    """The stretches of a text between blank lines and around comments."""
    for edge in EDGES:
        text = F.regexp_replace(text, edge, "$1\n")
    return F.split(text, BLANK, -1)


def _runs(own: DataFrame, bodies: list[tuple[str, str]]) -> DataFrame:
    """Known texts whose blocks stand one after the other in a document, and the block and lines where they begin."""
    form = F.filter(F.transform(blocks(F.col("text")), canonical), lambda x: x != "")
    known = own.sparkSession.createDataFrame(bodies, "license string, text string")
    known = known.withColumn("forms", form).select(
        "license", F.xxhash64("text").alias("body"), F.size("forms").alias("size"), F.posexplode("forms").alias("place", "form")
    )
    known = known.select("license", "body", "size", "place", F.md5("form").alias("digest"))
    raw = F.transform(blocks(F.col("text")), lambda x: F.struct(canonical(x).alias("form"), F.contains(F.trim(x), F.lit("\n")).alias("lines")))
    found = own.select("doc_id", "text_key", F.posexplode(F.filter(raw, lambda x: x["form"] != "")).alias("at", "block"))
    return (
        found.select("doc_id", "text_key", "at", "block.lines", F.md5("block.form").alias("digest"))
        .join(known, "digest")
        .groupBy("doc_id", "text_key", "license", "body", "size", (F.col("at") - F.col("place")).alias("begin"))
        .agg(F.count_distinct("place").alias("places"), F.bool_or("lines").alias("lines"))
        # A run of one line is a line's own unit already.
        .where((F.col("places") == F.col("size")) & ((F.col("size") > 1) | F.col("lines")))
        .select("doc_id", "text_key", "license", F.concat_ws(":", F.lit("block"), "begin").alias("unit"))
    )


def license_scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document: its licences, how many of its units are one, and whether all of it is one."""
    own_table = known is None
    bodies = [*NOTICES, *BODIES] if own_table else []
    known = known_licenses(docs.sparkSession) if known is None else known
    every = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))
    own = every.where(F.col("text").rlike(TRIGGER)) if own_table else every
    lines = F.split("text", "\n", -1)
    units = F.when(F.size(lines) > 1, F.concat(F.array("text"), lines)).otherwise(F.array("text"))
    forms = own.select("doc_id", "text_key", F.posexplode(units).alias("unit", "part")).withColumn(
        "form", canonical(F.col("part"))
    )
    hits = (
        forms.where(F.col("form") != "")
        .select("doc_id", "text_key", "unit", F.md5("form").alias("digest"))
        .join(known, "digest")
        .select("doc_id", "text_key", "license", F.col("unit").cast("string").alias("unit"))
        .unionByName(_runs(own, bodies))
        .groupBy("doc_id", "text_key")
        .agg(
            F.array_join(F.array_sort(F.collect_set("license")), ",").alias("found"),
            F.collect_set("unit").alias("units"),
        )
        .withColumn("whole", F.array_contains("units", "0"))
        # Blocks of a text that is a licence as a whole are that one unit.
        .withColumn("units", F.size(F.filter("units", lambda u: ~(F.col("whole") & u.startswith("block")))))
        .select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "found", "units", "whole")
    )
    key = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key"))
    return every.select("doc_id", "text_key").join(hits, key, "left").select(
        "doc_id",
        F.coalesce("found", F.lit("")).alias("licenses"),
        F.coalesce("units", F.lit(0)).cast("bigint").alias("n_units"),
        F.coalesce("whole", F.lit(False)).alias("whole_text"),
    )

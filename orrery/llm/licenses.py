"""Operator 10: licence scan by sentence rules (SQL functions only).

1. Normalising: lower case; marks that begin comment lines go (`//`, `#`, `*`, `;` and the
   like); full stops (but for those of `v.`, `Inc.` and the like), marks of exclamation and question
   before white space, and blank lines, end a sentence; a single line end is white space, so wrapped lines are joined; everything
   else than a-z and 0-9 is a space. Wordings that mean the same become one (VARIANTS): the
   spelling of licence, holders' and contributors' names, `released under the terms of the`.
2. Known sentences (those of RULES, and `licensed under` or `spdx license identifier` before
   each of NAMES) are found as whole runs of words inside one sentence, the leftmost and of
   these the longest first, without overlap, so a title, a list mark or a copyright line that
   was joined to a sentence doesn't hide it. A text becomes the sequence of their identifiers.
3. Each licence rule is a sequence of identifiers that must appear in it without another
   known sentence between. Rules are in order, longer ones first; where one matches, its
   identifiers are used up for those after it, with an `all rights reserved` right before.

Near-equal sentences are those that normalising makes equal, and no others. A name in
VARIANTS has at most 30 words.

Defined results: a null or empty text has no sentence and no rule; repeated rows are rows
of their own; texts are read whole; an empty table gives an empty table; other columns are
not read. There is no shuffle and no Python code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orrery.runtime import table

# The wording of public licences.
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
CLAIM = "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
SUBJECT = "subject to the following conditions"
INCLUDED = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_ADVERTISING = "All advertising materials mentioning features or use of this software must display the following acknowledgement"
BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"
BSD_CLAIM = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_NOTICE = "provided that the above copyright notice and this permission notice appear in all copies"
ISC_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"
ISC_CLAIM = "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"
APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"
APACHE_COPY = "You may obtain a copy of the License at"
APACHE_AS_IS = "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"
APACHE_SEE = "See the License for the specific language governing permissions and limitations under the License"
GNU_HOPE = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"


def gnu(name: str, version: str, later: bool) -> tuple[str, ...]:
    """The notice of a GNU licence."""
    what = f"you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
    which = f"either version {version} of the License, or (at your option) any later version" if later else f"version {version} of the License"
    return f"{what}, {which}", GNU_HOPE, f"See the GNU {name} for more details"


#: Licence rules in order. (licence, sentences)
RULES = (
    ("Apache-2.0", (APACHE, APACHE_COPY, APACHE_AS_IS, APACHE_SEE)),
    *((f"{i}-or-later", gnu(n, v, True)) for i, n, v in (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"))),
    *((f"{i}-only", gnu(n, v, False)) for i, n, v in (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"))),
    ("BSD-4-Clause", (BSD, BSD_SOURCE, BSD_BINARY, BSD_ADVERTISING, BSD_NAMES, BSD_AS_IS, BSD_CLAIM)),
    ("BSD-3-Clause", (BSD, BSD_SOURCE, BSD_BINARY, BSD_NAMES, BSD_AS_IS, BSD_CLAIM)),
    ("BSD-2-Clause", (BSD, BSD_SOURCE, BSD_BINARY, BSD_AS_IS, BSD_CLAIM)),
    ("BSD-3-Clause", (BSD, BSD_SOURCE, BSD_BINARY, BSD_NAMES)),
    ("BSD-3-Clause", (BSD, BSD_SOURCE, BSD_NAMES)),
    ("BSD-2-Clause", (BSD, BSD_SOURCE, BSD_BINARY)),
    ("BSD-2-Clause", (BSD, BSD_SOURCE)),
    ("MIT", (MIT, SUBJECT, INCLUDED, AS_IS, CLAIM)),
    ("MIT-0", (MIT, AS_IS, CLAIM)),
    ("MIT", (MIT, SUBJECT, INCLUDED)),
    ("ISC", (ISC_GRANT, ISC_NOTICE, ISC_AS_IS, ISC_CLAIM)),
    ("0BSD", (ISC_GRANT, ISC_AS_IS, ISC_CLAIM)),
    ("ISC", (ISC_GRANT, ISC_NOTICE)),
    ("Zlib", ("This software is provided 'as-is', without any express or implied warranty", "In no event will the authors be held liable for any damages arising from the use of this software", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions")),
    ("BSL-1.0", ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",)),
    ("Unlicense", ("This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means")),
    ("Unlicense", ("This is free and unencumbered software released into the public domain",)),
    ("WTFPL", ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",)),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at")),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",)),
    ("EPL-2.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",)),
    ("PostgreSQL", ("Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",)),
    ("CC0-1.0", ("released into the public domain under CC0 1.0",)),
    ("CC0-1.0", ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",)),
)
#: Names of licences in notices. (licence, names)
NAMES = (
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0")),
    ("MIT", ("MIT License", "MIT")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause")),
    ("BSD", ("BSD License",)),
    ("ISC", ("ISC License", "ISC")),
    ("GPL-3.0-only", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPL-3.0-only", "GPLv3")),
    ("GPL-2.0-only", ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPL-2.0-only", "GPLv2")),
    ("GPL-3.0-or-later", ("GPL-3.0-or-later",)),
    ("GPL-2.0-or-later", ("GPL-2.0-or-later",)),
    ("AGPL-3.0-only", ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0-only", "AGPLv3")),
    ("LGPL-3.0-only", ("GNU Lesser General Public License, version 3", "LGPL-3.0-only", "LGPLv3")),
    ("LGPL-2.1-only", ("GNU Lesser General Public License, version 2.1", "LGPL-2.1-only")),
    ("MPL-2.0", ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "MPL-2.0")),
    ("EPL-2.0", ("Eclipse Public License 2.0", "EPL-2.0")),
    ("Unlicense", ("Unlicense",)),
    ("Zlib", ("zlib License", "Zlib")),
    ("BSL-1.0", ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0")),
    ("CC-BY-NC-4.0", ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License")),
    ("CC-BY-SA-4.0", ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License")),
    ("CC-BY-4.0", ("CC BY 4.0", "Creative Commons Attribution 4.0 International License")),
    ("CC0-1.0", ("CC0 1.0",)),
)
RESERVED = "All rights reserved"
#: Steps of normalising, in order. (pattern, replacement; \1 the first group)
LEADERS = r"(^|\n)[ \t]*(?:/\*+|\*+/|//+|<!--|--+|#+|;+|%+|\*+|>+)[ \t]*"
ABBREVIATED = r"\b(v|ver|inc|ltd|co|corp)\.([ \t\r\n])"
CUTS = r"[.!?]+(?:[ \t\n\r\f]|\z)|\n[ \t\r\f]*\n"
VARIANTS = (
    (r"\blicence", "license"),
    (r"\bhttps? (?:www )?", ""),
    (r"\bcopyright (?:holders|owners|owner)\b", "copyright holder"),
    (r"\bneither the names? of (?:[a-z0-9]+ ){1,30}?nor the names of (?:its|their|any|other) contributors\b", "neither the name of the copyright holder nor the names of its contributors"),
    (r"\bin no event shall (?:[a-z0-9]+ ){1,30}?be liable\b", "in no event shall the author be liable"),
    (r"\bthis software is provided by (?:[a-z0-9]+ ){1,30}?as is\b", "this software is provided by the copyright holder as is"),
    (r"\b(?:released|licensed|distributed|published|(?:made )?available) under (?:the )?(?:terms of (?:the )?)?", "licensed under "),
)


def normal(text: str) -> list[str]:
    """The normalised sentences of a text, as the SQL below makes them."""
    out = re.sub(LEADERS, r"\1", text.lower())
    out = re.sub(ABBREVIATED, r"\1\2", out)
    out = re.sub("[^a-z0-9\x01]+", " ", re.sub(CUTS.replace(r"\z", r"\Z"), "\x01", out))
    for pattern, put in VARIANTS:
        out = re.sub(pattern, put, out)
    return [s.strip() for s in out.split("\x01") if s.strip()]


def numbered() -> tuple[dict[str, str], tuple[tuple[str, tuple[str, ...]], ...]]:
    """({normalised sentence: identifier}, rules as sequences of identifiers), from RULES and NAMES."""
    known: dict[str, str] = {}
    rules = []

    def add(name: str, sentence: str) -> str:
        parts = normal(sentence)
        if len(parts) != 1:
            raise ValueError(f"not one sentence: {sentence}")
        return known.setdefault(parts[0], f"{name}.{len(known)}")

    for licence, sentences in RULES:
        rules.append((licence, tuple(add(licence, s) for s in sentences)))
    for licence, names in NAMES:
        for n in names:
            rules += [(licence, (add(licence, f"{before} {n}"),)) for before in ("licensed under", "SPDX-License-Identifier")]
    rules.append(("proprietary", (add("reserved", RESERVED),)))
    return known, tuple(rules)


KNOWN, SEQUENCES = numbered()
OWN = KNOWN[normal(RESERVED)[0]]
#: Any known sentence as a run of words; of those that begin at one place the longest.
ANY = r"\b(?:" + "|".join(sorted(KNOWN, key=lambda s: (-len(s), s))) + r")\b"
#: A text without any of these has no known sentence (a test holds every known sentence and variant against it).
GATE = r"licen|reserved|redistribut|permission|warrant|domain|software|spdx|\b(?:under|subject|mpl)\b"


def sentence_ids(text: Column) -> Column:
    """array<string>: the identifiers of the known sentences, in the text's order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    plain = F.regexp_replace(F.regexp_replace(low, LEADERS, "$1"), ABBREVIATED, "$1$2")
    plain = F.regexp_replace(F.regexp_replace(plain, CUTS, "\u0001"), "[^a-z0-9\u0001]+", " ")
    for pattern, put in VARIANTS:
        plain = F.regexp_replace(plain, pattern, put)
    names = F.create_map(*(F.lit(x) for s, i in KNOWN.items() for x in (s, i)))
    found = F.transform(F.regexp_extract_all(plain, F.lit(ANY), F.lit(0)), lambda s: F.element_at(names, s))
    return F.when(F.rlike(low, F.lit(GATE)), found).otherwise(F.array().cast("array<string>"))


def rules(ids: Column) -> Column:
    """array<string>: licences of the rules that match, in the rules' order, each once."""
    every = F.array(*(F.struct(F.lit(licence).alias("licence"), F.lit(f" {'  '.join(sequence)} ").alias("part")) for licence, sequence in SEQUENCES))
    begin = F.struct(F.concat(F.lit("  "), F.array_join(ids, "  "), F.lit("  ")).alias("left"), F.array().cast("array<string>").alias("found"))

    def step(s: Column, rule: Column) -> Column:
        rest = F.replace(F.replace(s["left"], F.concat(F.lit(f" {OWN} "), rule["part"]), F.lit(" | ")), rule["part"], F.lit(" | "))
        more = F.struct(rest.alias("left"), F.array_union(s["found"], F.array(rule["licence"])).alias("found"))
        return F.when(F.contains(s["left"], rule["part"]), more).otherwise(s)

    return F.when(F.size(ids) > 0, F.aggregate(every, begin, step, lambda s: s["found"])).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, sentence_ids array<string>, licences array<string> of every row."""
    out = docs.select(F.col(id_col), sentence_ids(F.col(text_col)).alias("sentence_ids"))
    return out.select(id_col, "sentence_ids", rules(F.col("sentence_ids")).alias("licences"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", " ").alias("sentences"), F.array_join("licences", ",").alias("licences"))


def oracle() -> str:
    """The same in DuckDB, sentence by sentence: the longest known one at each place, then joins with the rules."""
    plain = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{LEADERS}', '\\1', 'g'), '{ABBREVIATED}', '\\1\\2', 'g'), '{CUTS}', chr(1), 'g'), '[^a-z0-9\\x01]+', ' ', 'g')"
    for pattern, put in VARIANTS:
        plain = f"regexp_replace({plain}, '{pattern}', '{put}', 'g')"
    names = ", ".join(f"('{s}', '{i}')" for s, i in KNOWN.items())
    steps, left = [], "('  ' || replace(sentences, ' ', '  ') || '  ')"
    steps.append(f"s0 AS (SELECT *, {left} AS rest, CAST([] AS VARCHAR[]) AS found FROM joined)")
    for k, (licence, sequence) in enumerate(SEQUENCES):
        part = f" {'  '.join(sequence)} "
        steps.append(f"s{k + 1} AS (SELECT * REPLACE (replace(replace(rest, ' {OWN} {part}', ' | '), '{part}', ' | ') AS rest, CASE WHEN contains(rest, '{part}') AND NOT list_contains(found, '{licence}') THEN list_append(found, '{licence}') ELSE found END AS found) FROM s{k})")
    return f"""
WITH known(sentence, id) AS (VALUES {names}),
hits AS (SELECT doc_id, regexp_extract_all({plain}, '{ANY}') AS parts FROM documents),
each AS (SELECT doc_id, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS i FROM hits),
joined AS (SELECT d.doc_id, count(k.id) AS n_sentences, coalesce(string_agg(k.id, ' ' ORDER BY i), '') AS sentences FROM documents d LEFT JOIN each USING (doc_id) LEFT JOIN known k USING (sentence) GROUP BY d.doc_id),
{', '.join(steps)}
SELECT doc_id, n_sentences, sentences, array_to_string(found, ',') AS licences FROM s{len(SEQUENCES)}
"""


QUERIES = {"op10_licenses": op10_licenses}
ORACLE = {"op10_licenses": oracle()}

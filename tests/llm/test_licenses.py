"""Full licence texts as they stand in files: wrapped, commented, titled, with other names and spellings."""

import re

import duckdb
import pytest

from orrery.llm import licenses

MIT = """MIT License

Copyright (c) 2019 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE = """# Copyright 2020 The Authors. All Rights Reserved.
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
"""
GPL = """/*
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {name} as published by
 * the Free Software Foundation, {version}.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU {name} for more details.
 *
 * You should have received a copy of the GNU {name}
 * along with this program.  If not, see <http://www.gnu.org/licenses/>.
 */
"""
LATER = "either version {} of the License, or\n * (at your option) any later version"
BSD = """Copyright (c) 2015, Some Company, Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{one}Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.

{two}Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution.
{names}
THIS SOFTWARE IS PROVIDED BY {who} "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL {whom} BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
NAMES = """
* Neither the name of Some Company, Inc. nor the names of its contributors
  may be used to endorse or promote products derived from this software
  without specific prior written permission.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted{notice}.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""
NOTICE = ", provided that the above\ncopyright notice and this permission notice appear in all copies"
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; ...
"""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
WTFPL = """            DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
                    Version 2, December 2004

 Everyone is permitted to copy and distribute verbatim or modified
 copies of this license document, and changing it is allowed as long
 as the name is changed.
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
EPL = "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"
POSTGRES = """Permission to use, copy, modify, and distribute this software and its documentation for any
purpose, without fee, and without a written agreement is hereby granted, provided that the above
copyright notice and this paragraph and the following two paragraphs appear in all copies.
"""
CC0 = "To the extent possible under law, the author(s) have dedicated all copyright\nand related and neighboring rights to this software to the public domain worldwide."
WHO = "THE COPYRIGHT HOLDERS AND CONTRIBUTORS"
BSD3 = BSD.format(one="* ", two="* ", names=NAMES, who=WHO, whom="THE COPYRIGHT HOLDER OR CONTRIBUTORS")
BSD2 = BSD.format(one="1. ", two="2. ", names="", who="SOME COMPANY AND CONTRIBUTORS", whom="SOME COMPANY OR ITS SUPPLIERS")
CASES = [
    (MIT, ["MIT"]), (MIT.replace("\n", " "), ["MIT"]), ("\n".join(f" * {x}" for x in MIT.split("\n")), ["MIT"]), (MIT.split("THE SOFTWARE IS")[0], ["MIT"]),
    (re.sub(r", subject to(.|\n)*Software\.\n\nTHE", ".\n\nTHE", MIT), ["MIT-0"]), (MIT.upper(), ["MIT"]), (MIT.replace("\n", "\r\n"), ["MIT"]),
    (APACHE, ["Apache-2.0"]), (APACHE.replace("# ", "").replace("#", ""), ["Apache-2.0"]), (APACHE.replace(" All Rights Reserved.", "").replace("#", "//"), ["Apache-2.0"]),
    *((GPL.format(name=n, version=LATER.format(v)), [f"{i}-or-later"]) for i, n, v in (("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3"))),
    *((GPL.format(name=n, version=f"version {v} of the License"), [f"{i}-only"]) for i, n, v in (("GPL-2.0", "General Public License", "2"), ("AGPL-3.0", "Affero General Public License", "3"))),
    (BSD3, ["BSD-3-Clause"]), (BSD2, ["BSD-2-Clause"]), ("\n".join(f"# {x}" for x in BSD3.split("\n")), ["BSD-3-Clause"]), (BSD3.split("THIS SOFTWARE")[0], ["BSD-3-Clause"]),
    (ISC.format(notice=NOTICE), ["ISC"]), (ISC.format(notice=""), ["0BSD"]), (ZLIB, ["Zlib"]), (BOOST, ["BSL-1.0"]), (UNLICENSE, ["Unlicense"]), (WTFPL, ["WTFPL"]), (MPL, ["MPL-2.0"]), (EPL, ["EPL-2.0"]), (POSTGRES, ["PostgreSQL"]), (CC0, ["CC0-1.0"]),
    ("Some prose without an end\nReleased under the MIT Licence", ["MIT"]), ("SPDX-License-Identifier: GPL-2.0-or-later", ["GPL-2.0-or-later"]), ("This work is licensed\nunder the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ("available under the terms of the Apache License 2.0, see below", ["Apache-2.0"]), ("Copyright (c) 2020 X. All rights reserved.", ["proprietary"]), ("distributed under the\n\nMIT License", []), ("Licensed under the Apache. License, Version 2.0.", []),
    (f"All rights reserved.\nNot free. Licensed under MIT.\n\n{UNLICENSE}", ["Unlicense", "MIT"]), (f"All rights reserved.\n\n{MIT}\nAll rights reserved.", ["MIT", "proprietary"]), (f"{MIT}\n{BSD2}", ["BSD-2-Clause", "MIT"]), ("We licensed the software to no one; permission was never granted.", []), (None, []), ("", []), ("x " * 200_000 + "\n\n" + MIT, ["MIT"]), (MIT + MIT, ["MIT"]),
]


@pytest.fixture(scope="module")
def judged(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("licences"))
    rows = [(i, t, "clash", 1) for i, (t, _) in enumerate(CASES)] + [(0, MIT, "clash", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, licences string, sentence_ids int").write.parquet(f"{d}/documents.parquet")
    return d, [r.asDict() for r in licenses.op10_licenses(spark, d).collect()]


def test_full_texts(judged):
    got = {r["doc_id"]: r["licences"] for r in judged[1]}
    assert {i: got[i] for i in got} == {i: ",".join(want) for i, (_, want) in enumerate(CASES)}
    assert len({x for _, want in CASES for x in want}) >= 20 and len(judged[1]) == len(CASES) + 1


def test_equals_sql(judged):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT DISTINCT doc_id, text FROM '{judged[0]}/documents.parquet/*.parquet'")
    made = con.execute(licenses.ORACLE["op10_licenses"])
    names = [c[0] for c in made.description]
    assert sorted(map(str, made.fetchall())) == sorted({str(tuple(r[n] for n in names)) for r in judged[1]})


def test_gate_holds_for_every_known_sentence():
    assert all(re.search(licenses.GATE, s) for s in licenses.KNOWN)
    assert all(re.search(licenses.GATE, x.lower()) for _, names in licenses.NAMES for n in names for x in (f"available under the terms of the {n}", f"Released under {n}", f"SPDX-License-Identifier: {n}"))
    assert len({i for i, _ in licenses.SEQUENCES}) >= 25

"""License scans: planted license texts and notices among prose, and the license lines of the test documents."""

import re
from pathlib import Path

import pytest

from paperstrata.llm import licenses, queries

MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
BSD = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are met:
//  1. Redistributions of source code must retain the above copyright notice, this list.
//  2. Redistributions in binary form must reproduce the above copyright notice.
{}// THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS". IN NO EVENT SHALL THE
// COPYRIGHT OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DAMAGES."""
ENDORSE = "//  3. Neither the name of the X nor the names of its contributors may be used to endorse or promote products.\n"
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at

#     http://www.apache.org/licenses/LICENSE-2.0

# Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.
# See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY. See the GNU {}General Public License for more details.
You should have received a copy of the GNU {}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
CASES = [
    (MIT, ["MIT"]),
    (BSD.format(""), ["BSD-2-Clause"]),
    (BSD.format(ENDORSE), ["BSD-3-Clause"]),
    (APACHE, ["Apache-2.0"]),
    (GPL.format("", 3, "", ""), ["GPL-3.0-or-later"]),
    (GPL.format("Lesser ", "2.1", "Lesser ", "Lesser "), ["LGPL-2.1-or-later"]),
    (MPL, ["MPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"]),
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", ["CC-BY-SA-3.0"]),
    ("Released under the MIT License.", ["MIT"]),
    ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("SPDX-License-Identifier: BSD-3-Clause", ["SPDX:bsd-3-clause"]),
    ("GPLv2+", ["GPL-2.0-or-later"]),
    ("Released under the MIT License\nLicensed under CC BY 4.0\n", ["MIT", "CC-BY-4.0"]),
    ("Released under the Foo Bar License.", ["UNKNOWN"]),
    ("Licensed under the MIT License and the Foo Bar License.", ["MIT", "UNKNOWN"]),
    ("Copyright 1999 Nobody. All rights reserved.", []),
    ("Lob und Tadel mit Maß. Rien.", []),
    ("", []),
    (None, []),
]


@pytest.mark.parametrize("around", [False, True])
def test_planted(spark, around):
    front, back = ("Prosa über Bäume 🌳 ohne Ende\n\n" + "wörter und mehr. " * 700, " Danach mehr. " + "x y z. " * 50) if around else ("", "")
    rows = [(i, None if t is None else front + t + back) for i, (t, _) in enumerate(CASES)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert {i: [x["license"] for x in got[i]["licenses"]] for i in got} == {i: want for i, (_, want) in enumerate(CASES)}
    for i, t in rows:
        for x in got[i]["licenses"]:
            part = t[x["start"] : x["end"]]
            assert part in t and re.search(r"(?i)licen|permission|redistribution|gplv2", part) and "wörter" not in part


def test_sentences_have_a_gate_word(spark):
    """No known sentence is lost to the search for words that comes first."""
    gate = re.compile(licenses.GATE)
    for text, want in CASES:
        assert not want or gate.search(text)
    assert len(set(licenses.ORDER)) == len(licenses.SENTENCES)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").is_dir(), reason="no test tables")
def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.queries()["op2_license_scans"](spark, sf).collect()}
    names = {"GNU General Public License, version 3.": "GPL-3.0-only", "CC BY-NC 4.0.": "CC-BY-NC-4.0", "MIT License.": "MIT", "Apache License, Version 2.0.": "Apache-2.0"}
    docs, n = spark.read.parquet(f"{sf}/documents.parquet").collect(), 0
    assert len(got) == len(docs)
    for r in docs:
        want = [names[m] for m in re.findall("|".join(map(re.escape, names)), r["text"] or "")]
        assert [x.split(":")[0] for x in got[r["doc_id"]]["licenses"].split(",") if x] == want
        n += len(want)
    assert n

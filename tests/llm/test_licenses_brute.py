"""License scans against a plain reimplementation, over all test documents and over shuffled license sentences."""

import os
import random
import re
from pathlib import Path

import pytest

from paperstrata.llm import common, licenses

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
RX = {k: re.compile(f"^(?:{p})$", re.A) for k, p in licenses.KNOWN.items()}
ANY, GATE, LEFT, END = (re.compile(p, re.A) for p in (licenses.ANY, licenses.GATE, licenses.LEFT, licenses.END))
RULE = re.compile("|".join(f"(?:{p})" for p, _ in licenses.RULES))
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
MARKS = re.compile("[\\s,;:()\\[\\]{}\"'“”„‘’`/*#<>!?|=_]+|\\.(?=[\\s)\\]\"'>/]|$)|(?:^|(?<=\\n))[^\\S\\n]*-+[^\\S\\n]", re.A)


def dotted(v):
    return v if not v or "." in v else f"{v}.0"


def detail(k, m):
    g = lambda i: (m.group(i) or "") if i <= m.re.groups else ""
    name = licenses.SENTENCES[k][0]
    if k in "agl":
        v = g(1) + g(4)
        return name if not v else f"{name}-{dotted(v)}" + ("-or-later" if g(3) + g(5) else "-only")
    if k in "poes":
        v = dotted("".join(g(i) for i in range(1, 4 if k == "p" else 3)))
        return f"{name}-{v}" if v else name
    if k in "cC":
        kind = g(1)
        for long, short in (("attribution", "by"), ("non-?commercial", "nc"), ("share-?alike", "sa"), ("no-?deriv(?:ative)?s?", "nd"), (" ", "-")):
            kind = re.sub(long, short, kind)
        return f"CC-{kind.upper()}" + (f"-{g(2)}" if g(2) else "")
    if k == "b":
        return f"BSD-{g(1) + g(2)}-Clause" if g(1) + g(2) else "BSD"
    return f"SPDX:{g(1)}" if k == "x" else "UNKNOWN"


def brute(text):
    text = text or ""
    found, at = [], 0
    ends = [m.group(0) for m in END.finditer(text)] + [""]
    for sentence, end in zip(END.split(text), ends, strict=True):
        start, stop = at, at + len(sentence)
        at = stop + len(end)
        if not GATE.search(sentence) or not GATE.search(text):
            continue
        norm = re.sub(" +", " ", MARKS.sub(" ", sentence).translate(UP)).strip(" ")
        for part in ANY.finditer(norm):
            k = next((k for k, rx in RX.items() if rx.match(part.group(0))), "u")
            found.append((k, detail(k, RX[k].match(part.group(0))) if k != "u" else "UNKNOWN", start, stop))
        if LEFT.search(ANY.sub("|", norm)):
            found.append(("u", "UNKNOWN", start, stop))
    own = [f for f in found if f[0] not in "RK"]
    out = []
    for m in RULE.finditer("".join(f[0] for f in own)):
        first, last = own[m.start()], own[m.end() - 1]
        name = next(name for p, name in licenses.RULES if re.fullmatch(p, m.group(0)))
        out.append((name or first[1], first[2], last[3], m.group(0)))
    return "".join(f[0] for f in found), out


def compare(spark, texts):
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    n = 0
    for r in got:
        ids, want = brute(texts[r["doc_id"]])
        assert (r["ids"], [tuple(x) for x in r["licenses"]]) == (ids, want), texts[r["doc_id"]][:300]
        n += len(want)
    assert len(got) == len(texts)
    return n


SENTENCES = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files, to whom it is furnished to do so.
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice.
Redistributions in binary form must reproduce the above copyright notice.
Neither the name of the owner nor others may be used to endorse or promote products.
Licensed under the Apache License, Version 2.0.
You may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0.
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.
See the License for the specific language governing permissions and limitations under the License.
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.
It is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.
You should have received a copy of the GNU General Public License along with this program.
SPDX-License-Identifier: MIT OR Apache-2.0
Released under LGPL v2.1 only.
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
// dual-licensed, see the other licence
Published under the 3-clause BSD license.
Copyright (c) 2019 Someone. All rights reserved.
Dieser Text ist gemeinfrei.
No license is said here at all.
A plain sentence about nothing.""".split("\n")


def test_shuffled_sentences(spark):
    rng = random.Random(21)
    join = lambda: "".join(rng.choice(["", "# ", "- ", " * "]) + rng.choice(SENTENCES) + rng.choice([" ", "\n", "\n\n", "  \n \n"]) for _ in range(rng.randint(0, 9)))
    texts = [None, "", *[join() for _ in range(400)], "\n\n".join(rng.choice(SENTENCES) for _ in range(3000))]
    assert compare(spark, texts) > 500


@pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")
def test_documents(spark):
    texts = [r[0] for r in common.documents(spark, SF).select("text").collect()]
    assert compare(spark, texts) > 20

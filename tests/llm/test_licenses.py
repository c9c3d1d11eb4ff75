import math
import re
from collections import Counter

from pyspark.sql import functions as F

from caselode.llm.licenses import FILE, FILE_NAME, HEADER, TEMPLATES, TRIGGER, scan


def bag(text):
    return Counter(re.findall("[a-z0-9]+", text.lower()))


SEEN = Counter(w for _, t in TEMPLATES for w in bag(t))
IDF = lambda w: math.log((1 + len(TEMPLATES)) / (1 + SEEN.get(w, 0))) + 1


def cosine(a, b):
    dot = sum(n * b[w] * IDF(w) ** 2 for w, n in a.items())
    return dot / math.sqrt(sum((n * IDF(w)) ** 2 for w, n in a.items()) * sum((n * IDF(w)) ** 2 for w, n in b.items())) if dot else 0.0


def best(text):
    return min((-round(cosine(bag(text), bag(t)), 4), name) for name, t in TEMPLATES)


def brute(rows):
    header, files = {}, {}
    for key, path, text in rows:
        low = (text or "").lower()
        if re.search(TRIGGER, low):
            parts = [p for p in re.split("[\r\n]+", re.sub(r"([.!?;])[ \t\r\n\f]+", "\\1\n", low)) if re.search(TRIGGER, p)]
            found = min(map(best, parts))
            if -found[0] >= HEADER:
                header[key] = found
            whole = best(low)
            if -whole[0] >= (HEADER if re.match(FILE_NAME, (path or "").rpartition("/")[2]) else FILE):
                above = (path or "").rpartition("/")[0]
                files[above] = min(files.get(above, (1,)), (*whole, path or ""))
    out = {}
    for key, path, _ in rows:
        up = (path or "").rpartition("/")[0]
        while up not in files and up:
            up = up.rpartition("/")[0]
        f = files.get(up)
        if key in header:
            out[key] = (header[key][1], -header[key][0], "header", path or "")
        elif f:
            out[key] = (f[1], -f[0], "file" if f[2] == (path or "") else "inherited", f[2])
        else:
            out[key] = (None, None, "none", None)
    return out


MIT, APACHE = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
ROWS = [
    (1, "a/LICENSE", MIT + " Copyright 2020 someone"), (2, "a/x.py", "code"), (3, "a/b/y.py", "deep code"), (4, "a/b/c/COPYING", APACHE),
    (5, "a/b/c/d/z.py", None), (6, "a/b/c/w.py", "# this file is licensed under CC BY-NC 4.0.\nmore " + "words " * 500), (7, "other/q.py", ""),
    (8, None, "text"), (9, "a2/x.py", "not in a"), (10, "a/b/license.md", "about copyright law in general and nothing else at all"), (11, "a/b/c/NOTICE", APACHE),
    (12, "x/y", "Of prose. The GNU General Public License, version 3! And " + "prose " * 30_000),
]


def test_scan_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "k") for r in ROWS], "doc_id long, where_ string, text string, path string")
    rows = scan(df, F.col("where_")).collect()
    assert {r.doc_id: (r.licence, r.score, r.how, r.from_path) for r in rows} == brute(ROWS) and len(rows) == len(ROWS)
    got = {r.doc_id: (r.licence, r.how) for r in rows}
    assert got[2] == got[3] == ("MIT", "inherited") and got[5] == ("Apache-2.0", "inherited") and got[6] == ("CC-BY-NC-4.0", "header") and got[9] == (None, "none")


def test_null_repeated_and_no_rows(spark):
    df = spark.createDataFrame([(None, None, None), (None, None, MIT), (3, "d/e", MIT), (3, "d/e", MIT)], "doc_id long, p string, text string")
    rows = scan(df, F.col("p")).collect()
    assert len(rows) == 4 and {r.licence for r in rows} == {"MIT"}
    assert scan(df.limit(0), F.col("p")).count() == 0


def test_documents(spark):
    from caselode.llm.common import documents

    docs = documents(spark, "/root/testdata/sf0.01")
    path = F.concat_ws("/", "source", "lang", "doc_id")
    rows = [(r.doc_id, r.path, r.text) for r in docs.select("doc_id", path.alias("path"), "text").collect()]
    got = {r.doc_id: (r.licence, r.score, r.how, r.from_path) for r in scan(docs, path).collect()}
    print(Counter(v[2] for v in got.values()))
    assert got == brute(rows)


BSD3 = """Copyright (c) 2011, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of Acme nor the names of its contributors may be used to
   endorse or promote products derived from this software without specific
   prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
FULL_MIT = """Copyright (c) 2014 Any Body

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
GPL3 = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
SYSTEM_TEXTS = [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("BSD", "BSD-3-Clause")]


def test_complete_texts_tags_and_wrapped_headers(spark):
    comment = lambda mark, text: "".join(f"{mark} {x}".rstrip() + "\n" for x in text.splitlines())
    wide = lambda x: (x, "inherited")
    rows = [
        ("m/LICENSE", FULL_MIT, ("MIT", "file")), ("m/a.py", "code", wide("MIT")), ("b/LICENSE.txt", BSD3, ("BSD-3-Clause", "file")), ("b/c/a.py", "code", wide("BSD-3-Clause")),
        ("s/1.c", "// SPDX-License-Identifier: MIT\nint x;", ("MIT", "header")), ("s/2.c", "/* SPDX-License-Identifier: GPL-2.0-only */\nint x;", ("GPL-2.0", "header")),
        ("s/3.c", "# spdx-license-identifier: (apache-2.0 OR MIT)\n", ("Apache-2.0", "header")), ("s/4.c", "// SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0", ("GPL-2.0", "header")),
        ("s/5.c", "// SPDX-License-Identifier: Zlib", ("Zlib", "header")), ("w/1.c", "/*\n" + GPL3 + "\n */\nint main() {}\n", ("GPL-3.0", "header")),
        ("w/2.py", comment("#", FULL_MIT) + "import os\n" + "x = 1\n" * 900, ("MIT", "header")), ("w/3.py", "# Released under\n# the MIT\n# License\nimport os\n" + "x = 1\n" * 9, ("MIT", "header")),
        ("n/a.md", "This note on licences and on the copyright of the works of others is\nnot one itself.\nNor is the rest of it.\n" * 30, (None, "none")),
    ]
    for file, name in SYSTEM_TEXTS:
        try:
            with open(f"/usr/share/common-licenses/{file}") as f:
                rows += [(f"t{file}/x", f.read(), None), (f"t{file}/y", "code", wide(name))]
        except FileNotFoundError:
            pass
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows)], "doc_id long, p string, text string")
    got = {r.p: (r.licence, r.how) for r in scan(df, F.col("p")).withColumnRenamed("path", "p").collect()}
    want = {p: w for p, _, w in rows if w}
    # a notice inside a licence file may be taken for its header; the licence and what is inherited have to be right
    assert {p: got[p][0] for p in want} == {p: w[0] for p, w in want.items()}
    assert all(got[p][1] == w[1] for p, w in want.items() if w[1] != "file")

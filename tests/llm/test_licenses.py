import math
import re

from pyspark.sql import functions as F

from quillet.llm import licenses

GPL = "This work is licensed under the GNU General Public License, version 3."
ROWS = [
    (1, "/a/x/LICENSE", "Released under the MIT License."),
    (2, "a/x/y/z/doc", "nothing to say here\nat all"),
    (3, "a/LICENSE", f"{GPL}\n"),
    (4, "a/other/doc", "plain prose. more prose"),
    (5, "a/x/own", "Some prose goes before it. Licensed under the Apache License, Version 2.0. And prose after it goes on for some more words"),
    (6, "b/c", "no licence"),
    (7, None, None),
    (8, "a/x/long", "word " * 60000 + "\n" + GPL.upper()),
    (9, "a/x/", ""),
    (None, "a/q", "general words in public"),
    (1, "/a/x/LICENSE", "Released under the MIT License."),
]


def brute(rows):
    toks = lambda s: re.findall(licenses.TOKEN, (s or "").lower())
    n = len(rows)
    idf = {v: math.log((n + 1) / (sum(v in toks(t) for _, _, t in rows) + 1)) + 1 for v in licenses.VOCABULARY}
    far = math.log(n + 1) + 1

    def vec(words):
        words = [w for w in words if w not in licenses.STOP]
        return {w: words.count(w) * idf.get(w, far) for w in set(words)}, words

    def best(text):
        top = None
        for s in re.split(licenses.BREAK, text or ""):
            v, words = vec(toks(s))
            if not any(w in idf for w in words):
                continue
            # terms of no template are dimensions of weight one each occurrence
            norm = math.sqrt(sum(x * x if w in idf else words.count(w) * far * far for w, x in v.items()))
            for name, t in licenses.TEMPLATES:
                u, _ = vec(toks(t))
                c = round(sum(x * v.get(w, 0) for w, x in u.items()) / norm / math.sqrt(sum(x * x for x in u.values())), 6)
                key = (-c, name, -len(words))
                top = min(top, key) if top else key
        return top

    found = []
    for i, p, t in rows:
        p = (p or "").strip("/")
        d = p.rpartition("/")[0]
        b = best(t)
        own = b and -b[0] >= licenses.THRESHOLD
        file = bool(own and 2 * -b[2] >= len(vec(toks(t))[1]))
        found.append((i, p, d, b[1] if own else None, -b[0] if own else None, file))
    files = {}
    for _, _, d, own, _, file in found:
        if file:
            files.setdefault(d, []).append(own)
    given = {d: min(set(m), key=lambda x: (-m.count(x), x)) for d, m in files.items()}
    out = []
    for i, p, d, own, score, file in found:
        above, parts = None, d.split("/") if d else []
        for k in range(len(parts), -1, -1):
            if "/".join(parts[:k]) in given:
                above = "/".join(parts[:k])
                break
        scope = "file" if file else "header" if own else "inherited" if above is not None else "none"
        out.append((i, p, own or (given[above] if above is not None else None), score, scope, None if own else above))
    return out


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, p string, text string").withColumn("path", F.lit("clash")).withColumn("dir", F.lit("clash"))
    got = [tuple(r) for r in licenses.scan(df, F.col("p")).collect()]
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, got)) == sorted(map(key, brute(ROWS)))
    by = {r[0]: r for r in got}
    assert by[2][2:] == ("MIT", None, "inherited", "a/x") and by[5][2] == "Apache-2.0" and by[8][2] == "GPL-3.0" and by[4][2] == "GPL-3.0"


def test_plan_is_native(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, p string, text string")
    plan = licenses.scan(df, F.col("p"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan.split("== Initial Plan ==")[0])


def test_empty(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, p string, text string"), F.col("p")).count() == 0


def test_families_and_bodies(spark):
    says = {
        "All rights reserved.": "Proprietary",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
        "Copyright X. All rights reserved.\nPermission is hereby granted, free of charge, to any person obtaining a copy": "MIT",
        "Permission to use, copy, modify, and/or distribute this software for any": "ISC",
        "Redistribution and use in source and binary forms, with or without": "BSD-2-Clause",
        "Licensed under CC BY 4.0.": "CC-BY-4.0",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under CC0 1.0.": "CC0-1.0",
        "Licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "GNU Lesser General Public License, version 2.1": "LGPL-2.1",
        "GNU GENERAL PUBLIC LICENSE": "GPL",
        "GNU Affero General Public License, version 3": "AGPL-3.0",
        "Licensed under the BSD 2-Clause License.": "BSD-2-Clause",
    }
    rows = [(i, f"{i}/LICENSE", t) for i, t in enumerate(says)]
    got = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, p string, text string"), F.col("p")).collect()}
    assert [got[i] for i in range(len(rows))] == list(says.values())


def test_any_of_holds_the_words():
    pattern = re.compile(licenses._any_of(licenses.VOCABULARY))
    assert all(pattern.fullmatch(v) for v in licenses.VOCABULARY)
    assert not any(pattern.fullmatch(v + "q") or pattern.fullmatch(v[:-1]) and v[:-1] not in licenses.VOCABULARY for v in licenses.VOCABULARY)


WRAPPED = {  # as the files of repositories have them
    "MIT": """MIT License

Copyright (c) 2020 Somebody Else

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
""",
    "Apache-2.0": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.
""",
    "GPL-3.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc.
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
""",
    "LGPL-2.1": """                  GNU LESSER GENERAL PUBLIC LICENSE
                       Version 2.1, February 1999

 Everyone is permitted to copy and distribute verbatim copies
""",
    "AGPL-3.0": """                    GNU AFFERO GENERAL PUBLIC LICENSE
                       Version 3, 19 November 2007

 Everyone is permitted to copy and distribute verbatim copies
""",
    "MPL-2.0": """Mozilla Public License Version 2.0
==================================

1. Definitions
--------------

1.1. "Contributor"
    means each individual or legal entity that creates, contributes to
    the creation of, or owns Covered Software.
""",
    "CC-BY-SA-4.0": """Attribution-ShareAlike 4.0 International

=======================================================================

Creative Commons Corporation ("Creative Commons") is not a law firm and
does not provide legal services or legal advice.
""",
}


def test_licence_files_as_repositories_have_them(spark):
    import textwrap

    texts = {**WRAPPED, **{name: f"Copyright (c) 1999, X\n\n{textwrap.fill(body, 78)}\n" for name, body in licenses.BODIES if name != "MIT"}}
    filler = [(1000 + i, f"{i}/prose", "Some words of no licence at all\nand some more of them") for i in range(300)]
    rows = [(i, f"r{i}/LICENSE", t) for i, t in enumerate(texts.values())] + [(100 + i, f"r{i}/src/a.txt", "no words of licences") for i in range(len(texts))]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([*rows, *filler], "doc_id long, p string, text string"), F.col("p")).collect()}
    assert [(got[i].license, got[i].scope) for i in range(len(texts))] == [(name, "file") for name in texts]
    assert [(got[100 + i].license, got[100 + i].scope) for i in range(len(texts))] == [(name, "inherited") for name in texts]
    assert all(got[i].scope == "none" for i, _, _ in filler)


def test_short_bodies_are_files_under_any_name(spark):
    body = dict(licenses.BODIES)
    rows = [(1, "a/x", body["BSD-3-Clause"]), (2, "b/x", body["BSD-2-Clause"]), (3, "c/x", WRAPPED["MIT"]), (4, "d/x", "prose " * 900 + body["ISC"]), (5, "a/y", "prose")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, p string, text string"), F.col("p")).collect()}
    assert [(got[i].license, got[i].scope) for i in (1, 2, 3, 5)] == [("BSD-3-Clause", "file"), ("BSD-2-Clause", "file"), ("MIT", "file"), ("BSD-3-Clause", "inherited")]
    assert got[4].scope != "file"

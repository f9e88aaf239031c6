"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory. SQL only.

A text is cut into statements (at line and sentence ends); its first two lines together are a statement, too, as the
titles of licences run over two. A statement that holds any term of the templates is compared with every template: terms
are weighted by term frequency times inverse document frequency, the latter counted over all documents for the templates'
terms; a term of no template is a dimension of its own with the weight of a term of no document. A text that holds the
grant that a licence body begins with is compared as a whole with the bodies in the same way: if the best reaches
`threshold`, the text is that licence's file. Else the statement of the highest cosine, if it reaches `threshold`,
licenses the document; the document is a licence file if that statement, or all statements that reach the threshold
together, hold at least half of its terms, or if its name is that of one (LICENSE, COPYING, ...). A licence file licenses
its directory (most files win, then the name). A document without a licence of its own takes that of the nearest ancestor
directory that has one: directories, not documents, are joined with their ancestors' paths.

All of it is DataFrame expressions. Template and weight arrays have as many entries as the templates have terms, whatever
the corpus; statements never leave their row, texts are scored once; the joins are over directories, counted before
they move.

Defined cases: null and empty texts have no statement and may inherit; a null path is the root's; equal cosines go to
the template name that sorts first; repeated rows count each; a null doc_id gets its row; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash

THRESHOLD = 0.6
# Licence statements as headers and files word them, and the first words of licence bodies.
# A GNU licence without a version is its family; reserved rights have the name that sorts last, so an equal grant wins.
TEMPLATES = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-ND-4.0", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-ND-4.0", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("GPL", "This work is licensed under the GNU General Public License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL", "This work is licensed under the GNU Lesser General Public License."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-only"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("CC-BY-4.0", "Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International"),
    ("CC-BY-NC-ND-4.0", "Attribution-NonCommercial-NoDerivatives 4.0 International"),
    ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike 4.0 International"),
    ("CC-BY-ND-4.0", "Attribution-NoDerivatives 4.0 International"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("ISC", "ISC License"),
    ("Proprietary", "All rights reserved."),
)
# Public licence texts that are short enough to be compared as a whole.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. """
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. """
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT
SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BODIES = (
    ("BSD-2-Clause", _BSD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_DISCLAIMER),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL
WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE
FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject
to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
)
# The words that a body's grant begins with, whatever stands between them; names of licence files.
GRANT = "(?:permission[^a-z0-9]+(?:is[^a-z0-9]+hereby[^a-z0-9]+granted|to[^a-z0-9]+use)|redistribution[^a-z0-9]+and[^a-z0-9]+use)"
FILE_NAME = "^(?:licen[cs]e|unlicense|copying|copyright)(?:[.-][^/]*)?$"
TITLE = "^[ \t\r\n]*[^\n]*[^ \t\r\n][^\n]*\n[ \t\r\n]*[^\n]+"
# Words that say nothing about a licence.
STOP = ("a", "and", "by", "form", "in", "is", "of", "or", "the", "this", "to", "under", "v", "work", "for", "with")
TOKEN = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
BREAK = "[.!?]?\n|[.!?] "


def _terms(text: str) -> list[str]:
    return [t for t in re.findall(TOKEN, text.lower()) if t not in STOP]


SAID = {t for _, text in TEMPLATES for t in _terms(text)}
VOCABULARY = sorted(SAID.union(t for _, text in BODIES for t in _terms(text)))


def _any_of(words: list[str]) -> str:
    """A pattern of all words by common beginnings, so that a place is tried once for each letter and not for each word."""
    heads: dict[str, list[str]] = {}
    for w in filter(None, words):
        heads.setdefault(w[0], []).append(w[1:])
    some = "|".join(re.escape(c) + _any_of(rest) for c, rest in heads.items())
    return f"(?:{some})" + ("?" if "" in words else "") if some else ""


def _array(values, kind: str) -> Column:
    return F.expr("array(" + ", ".join(f"'{v}'" if kind == "string" else f"{v!r}D" for v in values) + ")")


def _tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*STOP))


def weights(docs: DataFrame) -> tuple[list[float], float]:
    """Inverse document frequency of each vocabulary term over all documents, and that of a term of no document."""
    own = F.array_intersect(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)), _array(VOCABULARY, "string"))
    held = {r.term: r["count"] for r in docs.select(F.explode(own).alias("term")).groupBy("term").count().collect()}
    n = docs.count()
    return [math.log((n + 1) / (held.get(t, 0) + 1)) + 1 for t in VOCABULARY], math.log(n + 1) + 1


def _weighed(texts, idf: list[float]) -> list[tuple[str, dict[int, float]]]:
    """Templates as unit vectors over the vocabulary."""
    out = []
    for name, t in texts:
        own = _terms(t)
        w = [own.count(v) * idf[i] for i, v in enumerate(VOCABULARY)]
        norm = sum(x * x for x in w) ** 0.5
        out.append((name, {i: x / norm for i, x in enumerate(w) if x}))
    return out


def strong(idf: list[float], threshold: float = THRESHOLD) -> list[str]:
    """The terms of statements without the most common ones, by which alone no template reaches the threshold: a
    statement of no other term need not be compared."""
    templates = _weighed(TEMPLATES, idf)
    weak: set[int] = set()
    for i in sorted(range(len(idf)), key=idf.__getitem__):
        if any(sum(w.get(j, 0.0) ** 2 for j in weak | {i}) >= (threshold - 0.001) ** 2 for _, w in templates) or threshold <= 0.001:
            break
        weak.add(i)
    return [v for i, v in enumerate(VOCABULARY) if v in SAID and i not in weak]


def best(text: Column, idf: list[float], unseen: float, threshold: float = THRESHOLD) -> Column:
    """struct(score, license, n_terms, said, whole) of a text, null if it holds nothing that can reach threshold: the
    best statement, the terms of all statements that reach it, and whether it is the text as a whole instead."""
    idf_array = _array(idf, "double")
    names = sorted({name for name, _ in (*TEMPLATES, *BODIES)})
    templates, bodies = _weighed(TEMPLATES, idf), _weighed(BODIES, idf)
    some = r"(?:^|[^a-z0-9.-])" + _any_of(strong(idf, threshold)) + r"(?:[^a-z0-9]|$)"
    # kinds: 0 a line's statement, 1 the title, 2 the whole text
    lines = F.transform(F.filter(F.split(text, BREAK, -1), lambda s: F.lower(s).rlike(some)), lambda s: F.struct(s.alias("s"), F.lit(0).alias("kind")))
    title = F.regexp_replace(F.regexp_extract(text, TITLE, 0), "[ \t\r\n]+", " ")
    others = F.array(
        F.struct(title.alias("s"), F.lit(1).alias("kind")), F.struct(F.when(F.lower(text).rlike(GRANT), text).otherwise(F.lit("")).alias("s"), F.lit(2).alias("kind"))
    )
    statements = F.concat(lines, F.filter(others, lambda x: F.lower(x["s"]).rlike(some)))

    # one transform for each step: an expression inside a lambda is computed anew wherever it is written
    listed = F.transform(statements, lambda x: F.struct(_tokens(x["s"]).alias("t"), x["kind"].alias("kind")))
    counted = F.transform(
        listed,
        lambda x: F.struct(
            F.transform(_array(VOCABULARY, "string"), lambda v: F.size(F.filter(x["t"], lambda w: w == v))).alias("tf"), F.size(x["t"]).alias("n"), x["kind"].alias("kind")
        ),
    )
    normed = F.transform(
        counted,
        lambda c: F.struct(
            F.zip_with(c["tf"], idf_array, lambda a, b: a * b).alias("line"), c["n"].alias("n"), c["kind"].alias("kind"),
            F.sqrt(
                F.aggregate(F.zip_with(c["tf"], idf_array, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b * b)
                + (c["n"] - F.aggregate(c["tf"], F.lit(0), lambda a, b: a + b)) * F.lit(unseen * unseen)
            ).alias("norm"),
        ),
    )

    def highest(s: Column, of: list[tuple[str, dict[int, float]]]) -> Column:
        def dot(w: dict[int, float]) -> Column:
            if len(w) > 30:
                dense = _array([float(w.get(i, 0.0)) for i in range(len(VOCABULARY))], "double")
                both = F.aggregate(F.zip_with(s["line"], dense, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
            else:
                both = sum((F.get(s["line"], F.lit(i)) * F.lit(x) for i, x in w.items()), F.lit(0.0))
            return F.round(F.when(s["norm"] > 0, both / s["norm"]).otherwise(F.lit(0.0)), 6)

        return F.array_max(F.array(*(F.struct(dot(w).alias("score"), F.lit(-names.index(name)).alias("name")) for name, w in of)))

    scored = F.transform(
        normed, lambda s: F.struct(F.when(s["kind"] == 2, highest(s, bodies)).otherwise(highest(s, templates)).alias("b"), s["n"].alias("n"), s["kind"].alias("kind"))
    )
    ranked = F.transform(
        scored,
        # a whole text that reaches the threshold comes before all statements, one that does not counts for nothing
        lambda x: F.struct(
            F.when((x["kind"] < 2) | (x["b"]["score"] >= threshold), F.when(x["kind"] == 2, 1).otherwise(0)).otherwise(-1).alias("first"),
            x["b"]["score"].alias("score"), x["b"]["name"].alias("name"), x["n"].alias("n"), x["kind"].alias("kind"),
        ),
    )
    top = F.transform(
        F.array(ranked),
        lambda every: F.struct(
            F.array_max(every).alias("m"),
            F.aggregate(F.filter(every, lambda x: (x["kind"] == 0) & (x["score"] >= threshold)), F.lit(0), lambda a, x: a + x["n"]).alias("said"),
        ),
    )
    return F.when(
        F.size(statements) > 0,
        F.get(
            F.transform(
                top,
                lambda t: F.struct(
                    t["m"]["score"].alias("score"), F.get(_array(names, "string"), -t["m"]["name"]).alias("license"), t["m"]["n"].alias("n_terms"),
                    t["said"].alias("said"), (t["m"]["first"] == 1).alias("whole"),
                ),
            ),
            0,
        ),
    )


def scan(docs: DataFrame, path: Column, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, license, score, scope, from_dir) for each row of docs(doc_id, text).

    scope: file (a licence file), header (a statement of its own), inherited, none. from_dir names the directory of an
    inherited licence, without slashes at its ends; the root is "".
    """
    idf, unseen = weights(docs)
    clean = F.regexp_replace(F.coalesce(path.cast("string"), F.lit("")), "^/+|/+$", "")
    # most texts hold no term that counts: telling that from their terms at once is cheaper than trying a pattern on every statement
    told = F.arrays_overlap(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)), _array(strong(idf, threshold), "string"))
    some = docs.select(F.col("doc_id").cast("long"), clean.alias("path"), F.when(told, F.col("text")).alias("hit"))
    found = some.select("doc_id", "path", "hit", best(F.col("hit"), idf, unseen, threshold).alias("b"))
    own = F.coalesce(F.col("b.score") >= threshold, F.lit(False))
    half = 2 * F.greatest("b.n_terms", "b.said") >= F.size(_tokens(F.col("hit")))
    named = F.lower(F.regexp_extract("path", "[^/]*$", 0)).rlike(FILE_NAME)
    # a table of its own, without the texts: they are scored once
    rows = stash(found.select(
        "doc_id", "path",
        F.regexp_replace("path", "/?[^/]*$", "").alias("dir"),
        F.when(own, F.col("b.license")).alias("own"),
        F.when(own, F.col("b.score")).alias("score"),
        F.coalesce(own & (F.col("b.whole") | half | named), F.lit(False)).alias("is_file"),
    ))
    counted = rows.where("is_file").groupBy("dir", "own").agg(F.count(F.lit(1)).alias("n"))
    # most files, then the name that sorts first
    first = F.min(F.struct((-F.col("n")).alias("less"), "own"))
    licensed = counted.groupBy("dir").agg(first.alias("m")).select(F.col("dir").alias("above"), F.col("m.own").alias("given"))
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))
    ancestors = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    # a table of its own: a join right above its aggregation could not be split where a directory holds a third of all rows
    inherited = stash(
        rows.select("dir").distinct().select("dir", F.posexplode(ancestors).alias("depth", "above"))
        .join(licensed, "above")
        .groupBy("dir").agg(F.max_by(F.struct("given", "above"), "depth").alias("from"))
    )
    scope = (
        F.when(F.col("is_file"), "file").when(F.col("own").isNotNull(), "header").when(F.col("from").isNotNull(), "inherited").otherwise("none")
    )
    return rows.join(inherited, "dir", "left").select(
        "doc_id", "path", F.coalesce("own", "from.given").alias("license"), "score", scope.alias("scope"),
        F.when(F.col("own").isNull(), F.col("from.above")).alias("from_dir"),
    )


def oracle() -> str:
    """The same over documents in DuckDB, with the path that the query gives them (none ends in a licence file's name)."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    stop = ", ".join(map(q, STOP))
    templates = ", ".join(f"({i}, {q(n)}, {q(t)}, {i >= len(TEMPLATES)})" for i, (n, t) in enumerate((*TEMPLATES, *BODIES)))
    brk = q(BREAK).replace("\n", "' || chr(10) || '")
    title = q(TITLE).replace("\t", "' || chr(9) || '").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '")
    blank = "'[ ' || chr(9) || chr(13) || chr(10) || ']+'"
    return f"""
WITH templates(k, name, body, whole) AS (VALUES {templates}),
template_terms AS (
  SELECT k, name, whole, term, count(*) AS tf FROM (SELECT k, name, whole, unnest(regexp_extract_all(lower(body), '{TOKEN}')) AS term FROM templates)
  WHERE term NOT IN ({stop}) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT term FROM template_terms),
n AS (SELECT count(*) AS n FROM documents),
doc_terms AS (
  SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{TOKEN}'))) AS term FROM documents),
idf AS (
  SELECT v.term, ln((SELECT n + 1 FROM n) / (count(d.term) + 1)) + 1 AS w
  FROM vocabulary v LEFT JOIN doc_terms d USING (term) GROUP BY v.term),
unseen AS (SELECT ln(n + 1) + 1 AS w FROM n),
statements AS (
  SELECT doc_id, unnest(string_split_regex(text, {brk})) AS s, generate_subscripts(string_split_regex(text, {brk}), 1) AS pos FROM documents
  UNION ALL SELECT doc_id, regexp_replace(regexp_extract(text, {title}, 0), {blank}, ' ', 'g'), 0 FROM documents
  UNION ALL SELECT doc_id, text, -1 FROM documents WHERE regexp_matches(lower(text), '{GRANT}')),
terms AS (
  SELECT doc_id, pos, unnest(list_filter(regexp_extract_all(lower(s), '{TOKEN}'), lambda t: t NOT IN ({stop}))) AS term FROM statements),
line_tf AS (SELECT doc_id, pos, term, count(*) AS tf FROM terms GROUP BY ALL),
line AS (
  SELECT l.doc_id, l.pos, sqrt(sum(CASE WHEN i.w IS NULL THEN l.tf * u.w * u.w ELSE l.tf * l.tf * i.w * i.w END)) AS norm, sum(l.tf) AS n_terms
  FROM line_tf l LEFT JOIN idf i USING (term) CROSS JOIN unseen u GROUP BY ALL),
template_norm AS (SELECT k, sqrt(sum(tf * tf * w * w)) AS norm FROM template_terms JOIN idf USING (term) GROUP BY k),
scores AS (
  SELECT l.doc_id, l.pos, t.k, t.name, round(sum(l.tf * i.w * t.tf * i.w) / any_value(x.norm) / any_value(m.norm), 6) AS score, any_value(x.n_terms) AS n_terms
  FROM line_tf l JOIN template_terms t USING (term) JOIN idf i USING (term)
  JOIN line x ON x.doc_id = l.doc_id AND x.pos = l.pos JOIN template_norm m ON m.k = t.k WHERE t.whole = (l.pos = -1) GROUP BY ALL),
best AS (
  SELECT doc_id, name, score, n_terms, pos = -1 AS whole FROM scores WHERE pos >= 0 OR score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos = -1 DESC, score DESC, name, n_terms DESC) = 1),
said AS (
  SELECT doc_id, sum(n) AS said FROM (SELECT doc_id, pos, any_value(n_terms) AS n FROM scores WHERE pos > 0 AND score >= {THRESHOLD} GROUP BY ALL) GROUP BY doc_id),
sized AS (SELECT doc_id, count(*) AS all_terms FROM terms WHERE pos > 0 GROUP BY doc_id),
found AS (
  SELECT d.doc_id, concat_ws('/', d.source, d.lang, d.doc_id) AS path, concat_ws('/', d.source, d.lang) AS dir, d.source AS top,
    CASE WHEN b.score >= {THRESHOLD} THEN b.name END AS own, CASE WHEN b.score >= {THRESHOLD} THEN b.score END AS score,
    coalesce(b.score >= {THRESHOLD} AND (b.whole OR 2 * greatest(b.n_terms, coalesce(w.said, 0)) >= s.all_terms), false) AS is_file
  FROM documents d LEFT JOIN best b USING (doc_id) LEFT JOIN said w USING (doc_id) LEFT JOIN sized s USING (doc_id)),
licensed AS (
  SELECT dir, own AS given FROM (SELECT dir, own, count(*) AS n FROM found WHERE is_file GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY n DESC, own) = 1)
SELECT f.doc_id, f.path, coalesce(f.own, a.given, t.given, r.given) AS license, f.score,
  CASE WHEN f.is_file THEN 'file' WHEN f.own IS NOT NULL THEN 'header' WHEN coalesce(a.given, t.given, r.given) IS NOT NULL THEN 'inherited' ELSE 'none' END AS scope,
  CASE WHEN f.own IS NULL THEN CASE WHEN a.given IS NOT NULL THEN a.dir WHEN t.given IS NOT NULL THEN t.dir WHEN r.given IS NOT NULL THEN '' END END AS from_dir
FROM found f LEFT JOIN licensed a ON a.dir = f.dir LEFT JOIN licensed t ON t.dir = f.top LEFT JOIN licensed r ON r.dir = ''
"""

import time
import html as stdlib
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillet.llm import html


def test_structure():
    m = html.default_model()
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Site</a></header>
    <nav><ul><li><a href=/a>one</a></li><li><a href=/b>two</a></li></ul></nav>
    <div class="cookie-notice">We use cookies. Accept them please.</div>
    <article><h1>A &amp;amp; B</h1><p><b>First.<br><p>Some   <i>inline</i>text
    here &lt;x&gt; &nbsp; end.</p><div class="ad">Buy this now. It is cheap.</div><ul><li>A point that is made.</li><li>Another point is made.</li></ul>
    <script>var a = "</p>";</script><p>Last one with a <a href=/c>link inside</a> of it.</article>
    <section id="comments"><h2>Comments</h2><ol><li><p>I liked this article very much. Thanks!</p></li></ol></section>
    <aside><p>Read our other stories too.</p></aside><form><label>Mail</label><input></form>
    <footer>&copy; Site &middot; All rights reserved.</footer></body></html>"""
    assert m.text(page) == "A &amp; B First. Some inlinetext here <x> end. A point that is made. Another point is made. Last one with a link inside of it."


def test_marginals_equal_enumeration():
    import itertools
    import math

    m = html.default_model()
    page = html.Page("<div><p>One sentence is here.</p><ul><li><a href=x>a</a></li></ul><p>two</p></div>")
    n = len(page.nodes)
    total, one = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        z = m.prior[y[0]]
        for i in range(1, n):
            up = page.nodes[i].parent
            z += m.edge[html.kind_of(page.nodes[up])][y[up]][y[i]]
            for f in html.features(page, i):
                z += m.power[f[0]] * (m.emission.get(f) or m.unseen[f[0]])[y[i]]
        w = math.exp(z)
        total += w
        for i in range(n):
            one[i] += w * y[i]
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(m.marginals(page), one, strict=True))


def test_unseen_layouts():
    m = html.default_model()
    right = runs = 0
    for p in html.training_pages(120, seed=77):
        page = html.Page(p)
        y = [0] * len(page.nodes)
        for i, n in enumerate(page.nodes):
            y[i] = int(n.label) if n.label in ("0", "1") else (y[n.parent] if i else 0)
        got = m.marginals(html.Page(re.sub(r' data-y="[01]"', "", p)))
        for node, parts in page.runs:
            if "".join(parts).strip():
                runs += 1
                right += (got[node] >= 0.5) == bool(y[node])
    assert right / runs > 0.97


def test_whole_table(spark):
    rows = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html.extract(df).collect()}
    for r in rows:
        a = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        a = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", a))
        assert got[r["page_id"]].text == " ".join(stdlib.unescape(a).split())
        assert got[r["page_id"]].n_chars == len(got[r["page_id"]].text) and got[r["page_id"]].url == r["url"]


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep text here." + "</div>" * 3000
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain text &amp; more"), (3, "u", "<p>" + "long text. " * 30000), (4, "u", "<!DOCTYPE [<!x>"), (5, "u", deep), (5, "u", "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {(r.page_id, r.url): r for r in got}
    assert len(got) == len(rows)
    assert by[(1, "u")].text == by[(2, None)].text == ""
    assert by[(None, "u")].text == "plain text & more"
    assert by[(3, "u")].n_chars == 330000 - 1
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_the_rest_of_the_page_stays():
    text = lambda page: " ".join("".join(r) for _, r in html.Page(page).runs)
    assert text("<p>One.</p><![foo bar]><p>Two.</p><![><p>Three.</p>") == "One. Two. Three."
    assert text("<p>One.</p><![foo") == "One."
    assert text("<html><head><title>T</title><meta charset=u><body><p>One.</p></body></html>") == "One."
    assert text("<head><title>T</title><link rel=x><p>One.</p>") == "One."
    assert text("<head><style>p{}</style>One.") == "One."
    assert text("<article><p>One.</p><svg class=i /><p>Two.</p><math/>Three.</article>") == "One. Two. Three."
    assert text("<svg><path d=x /><text>no</text></svg><p>One.</p>") == "One."


def test_broken_pages_lose_no_text():
    text = html.default_model().text
    both = "One is here. And two, after it."
    for broken in (
        "<html><head><title>T</title><meta><body><article><p>One is here.</p><p>And two, after it.</p></article>",
        "<article><p>One is here.</p><![foo[x]]><p>And two, after it.</p></article>",
        "<article><p>One is here.</p><button>Go<p>And two, after it.</p></article>",
        "<article><p>One is here.</p><select><option>Go<p>And two, after it.</p></article>",
        "<article><p>One is here.</p><p title=\"open>And two, after it.</p></article>",
        "<article><p>One is here.</p></td></li><p>And two, after it.</p></article>",
        "<article><p>One is here.</p><svg/><p>And two, after it.</p></article>",
    ):
        assert text(broken) == both, broken
    assert text("<title>T<article><p>One is here.</p><p>And two, after it.</p></article>").endswith(both)
    assert text("<article><p>One is here.</p><textarea>T<p>And two, after it.</p></article>").endswith("And two, after it.")
    assert text("<article><p>One is here.</p><!-- open <p>And two, after it.</p></article>").endswith("And two, after it.")
    assert [text(x) for x in ("<", "</", "<a", "a < b <c", "x</p", "<p>x</p><")] == ["<", "</", "<a", "a < b <c", "x</p", "x <"]


def test_comments_of_readers_by_other_names():
    page = "<article><p>The body of the article. It goes on and on.</p></article><div class='{}'><p>What I think of it, says one who read it.</p></div>"
    for name in ("reader-responses", "user_feedback", "talkback", "comments-area"):
        assert html.default_model().text(page.format(name)) == "The body of the article. It goes on and on."


def test_time_is_linear_in_hostile_pages():
    model = html.default_model()
    for unit, close in (("<div>", "</div>"), ("<div>", "</p>"), ("<!--", ""), ("<p><b><i>", ""), ("<textarea>", ""), ("<button><svg>", ""), ("<a b='", ">"), ("<title>", ""), ("</x", ">")):
        began = time.perf_counter()
        model.text(unit * 16_000 + "<p>x</p>" + close * 16_000)
        assert time.perf_counter() - began < 5, unit  # quadratic ways take minutes

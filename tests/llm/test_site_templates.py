"""Main text of pages: parser cases, counting against brute force, templates by host."""

import html
import re
import time
from collections import Counter

import pytest

from tunelake.llm import queries
from tunelake.llm import site_templates as S

SMALL = "/root/testdata/sf0.001"


def text(source, templates=frozenset()):
    return S.Page(source).text(templates)


@pytest.mark.parametrize("source, want", [
    ("", ""), ("plain &lt;text&gt; &amp;&eacute;&#65;&#x42;&nope;", "plain <text> &éAB&nope;"),
    ("<p>a</p>b<p>c", "a\nb\nc"), ("<p>a<b>b</b>c <i>d</i></p>", "abc d"), ("a<br>b<br/>c", "a b c"),
    ("<p>x<b>y<p>z</b> w", "xy\nz w"), ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "a\nb\nc\nd"),
    ("<table><tr><td>1<td>2<tr><th>3</table>4", "1 2\n3\n4"), ("<b><p>f</b> g</p> h", "f g\nh"),
    ("x<!-- c <p> -->y<!doctype html>< 3 <3 </ x> z<p", "xy< 3 <3 z"),
    ("<script>var a='</p>'<p></script>x<style>p{}</style><noscript>n</noscript>", "x"),
    ("<title>t</title><p>x", "x"), ("<script>never closed <p>x", ""), ("a<textarea><p>b</textarea>c", "ac"),
    ('<a title="a > b">x</a>', "x"), ('<p>tail <a href="x>y</a> z', "tail y z"),
    ("  \n a \t\r\n b  ", "a b"), ("<pre> a\n  b </pre>", "a b"), ("<P CLASS=ad>no</P><DIV>yes</DIV>", "yes"),
    ("<nav>n</nav><header>h</header><footer>f</footer><aside>s</aside><form>q</form><p>x", "x"),
    ("<div id='cookie-notice'>c</div><div class='reader comments'>r</div><div role=navigation>v</div>x", "x"),
    ("<form><article><p>a</article></form>", "a"), ("<div class=sidebar-layout><main>m</main><div>d</div></div>", "m\nd"),
    ("<article><header><h1>T</h1></header><p>a<footer>f</footer><section class=comments>c</section></article>", "T\na"),
    ("<h1 class=banner>T</h1>", "T"), ("\x00a퟿\U0001f600", "\x00a퟿\U0001f600"),
])
def test_parser(source, want):
    assert text(source) == want


def test_long_and_deep_pages():
    start = time.time()
    for source, size in (("<div>" * 60000 + "x", 1), ("<p>" * 60000 + "x", 1), ('<a "' * 60000, 0), ("<" * 100000, 100000),
                         ("<b>x</i>" * 30000, 30000), ("x" * 2000000, 2000000), ("<ul><li>a" * 30000, 30000)):
        assert len(text(source).replace("\n", "")) == size
    assert time.time() - start < 60


def test_equal_subtrees_share_a_hash():
    a, b = S.Page("<div><p>x <b>y</b></p></div>").hashes(), S.Page("<ul></ul><div><p>x  <b>y</b>\n</p></div>").hashes()
    assert a[1:] == b[2:] and b[1] is None
    for other in ("<div><p>x <i>y</i></p></div>", "<div><p>x y</p></div>", "<div class=q><p>x <b>y</b></p></div>",
                  "<div><p><b>y</b>x </p></div>"):
        assert S.Page(other).hashes()[1] != a[1]


def page(host, body, path="a"):
    return f"https://{host}/{path}", f"<html><body>{body}</body></html>"


def site_rows():
    """A host with a recurring strip, a host whose pages are too few, no host, nulls, repeated rows."""
    rows = []
    for i in range(40):
        strip = f"<div><span>All of</span> <em>our site {i % 4}</em></div>"
        rows.append((i, *page("BIG.example", f"{strip}<p>own words {i}</p><section><p>seen twice {i // 2}</p></section>")))
    rows += [(100 + i, *page("small.example", "<div>strip</div><p>body</p>")) for i in range(4)]
    rows += [(200 + i, *page("copy.example", "<div>Site name</div><article><h1>Same</h1><p>copied text</p></article>"))
             for i in range(9)]
    rows += [(300 + i, "no host at all", "<div>strip</div>") for i in range(8)]
    rows += [(400 + i, None, "<div>strip</div>") for i in range(8)]
    rows += [(500, "https://big.example/x", None), (501, "https://big.example/", ""), (None, None, None),
             (0, *rows[0][1:])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", 3, "host", "page", ["x"]) for i, u, h in rows],
                                 "page_id long, url string, html string, text string, n_chars int, host string, "
                                 "page string, templates array<string>").repartition(4)


def brute(rows, min_pages=S.MIN_PAGES, share=S.SHARE):
    def host(u):
        m = re.search("://([^/?#]*)", u or "")
        return (m.group(1).lower() or None) if m else None
    pages, found = Counter(), Counter()
    for _, u, h in rows:
        pages[host(u)] += 1
        p = S.Page(h or "")
        own = p.own()
        found.update({(host(u), x) for i, x in enumerate(p.hashes()) if x is not None and not own[i]})
    out = []
    for i, u, h in rows:
        known = frozenset(x for (name, x), n in found.items() if name == host(u) and name is not None
                          and n >= min_pages and n >= share * pages[name])
        out.append((i, u, text(h or "", known)))
    return sorted(out, key=str)


def collected(df):
    return sorted(((r["page_id"], r["url"], r["text"]) for r in df.collect()), key=str)


def test_templates_by_host(spark, monkeypatch):
    rows = site_rows()
    got = S.main_text(frame(spark, rows))
    assert got.columns == ["page_id", "url", "html", "host", "page", "templates", "text", "n_chars"]
    out = got.collect()
    assert len(out) == len(rows)
    assert collected(got) == brute(rows)
    of = {r["page_id"]: r for r in out}
    assert of[7]["text"] == "own words 7\nseen twice 3" and of[7]["n_chars"] == len(of[7]["text"])
    assert of[100]["text"] == "strip\nbody" and of[300]["text"] == of[400]["text"] == "strip"
    assert of[200]["text"] == "Same\ncopied text" and of[500]["text"] == of[501]["text"] == of[None]["text"] == ""
    assert of[7]["host"] == "host" and of[7]["page"] == "page" and of[7]["templates"] == ["x"]
    monkeypatch.setattr(S, "FLUSH", 3)
    assert collected(S.main_text(frame(spark, rows))) == brute(rows)


def test_thresholds(spark):
    rows = [(i, *page("h.example", f"<div>strip {i % 10}</div><p>{i}</p>")) for i in range(60)]
    for min_pages, share in ((7, 0.01), (6, 0.01), (6, 0.2), (1, 0.0)):
        assert collected(S.main_text(frame(spark, rows), min_pages=min_pages, share=share)) == brute(rows, min_pages, share)


def test_empty_table(spark):
    assert S.main_text(frame(spark, [])).collect() == []


def test_op11_whole_table(spark):
    """The given pages hold their article between its tags."""
    got = queries.op11_site_templates(spark, SMALL)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = {r["page_id"]: r for r in got.collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = re.search("<article>(.*?)</article>", p["html"], re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>|<br>", article))
        want = "\n".join(b for b in blocks if b)
        assert (rows[p["page_id"]]["text"], rows[p["page_id"]]["n_chars"]) == (want, len(want))

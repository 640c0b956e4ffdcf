"""Main text of pages with the faults that pages have."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strandwork.functions.html import main_text, parsed

LONG = "The maker of the arms says that it will ship a thousand of them, and that the plant is being built. " * 3

PAGES = {
    "nested": (f"<title>A &amp; B</title><body><div><p>{LONG}<p>{LONG}</div><div><a href=x>more</a> <a href=y>and more</a></div>", ("A & B", [LONG, LONG])),
    "quotes": (f"<body><div data-x='a > b' title=\"<p>no</p>\"><p class=\"a>b\">{LONG}</p></div>", (None, [LONG])),
    "scripts": (f"<head><title>T</title><script>if (a < b) document.write('<p>never</p>')</script></head><body><article><p>{LONG}</p><script>var t = \"</p><p>no\";</script><p>{LONG}</p><style>p > a {{}}</style></article>", ("T", [LONG, LONG])),
    "entities": (f"<body><p>Caf&eacute; &lt;b&gt; &#8364;5 &#x41;&nbsp;fish &unknown; AT&T {LONG}</p>", (None, [f"Caf\u00e9 <b> \u20ac5 A fish &unknown; AT&T {LONG}"])),
    "broken": (f"<body><div><b><p>{LONG}</b></i></span></table><p><em>{LONG}<br>end</div></div></p>", (None, [LONG, f"{LONG} end"])),
    "links": (f"<body><ul>{'<li><a href=z>a link to another page of the site</a>' * 30}</ul><main><p>{LONG}</p><p>{LONG} <a href=q>source</a></p></main><footer>{LONG}</footer>", (None, [LONG, LONG + " source"])),
    "aside": (f"<body><nav><p>{LONG * 4}</p></nav><section><h2>Head</h2><p>{LONG}</p></section><aside><p>{LONG * 4}</p></aside>", (None, ["Head", LONG])),
    "advert": (f"<body><div class='page-ad top'><p>{LONG * 4}</p></div><div id=Related-items>{LONG * 2}</div><article><p>Short text.</p></article><div class='adage'>Other words here</div>", (None, ["Short text."])),
    "comment": (f"<!-- <p>{LONG}</p> --><body><!--[if x]><p>no</p><![endif]--><div><p>{LONG}</p></div><!-- open <p>never", (None, [LONG])),
    "lists": (f"<body><article><ul><li>{LONG}<li>{LONG}<ul><li>inner</ul></ul><table><tr><td>{LONG}<td>cell<tr><td>x</table></article>", (None, [LONG, LONG, "inner", LONG, "cell", "x"])),
    "bare": ("only words, <b>no</b> page", (None, ["only words, no page"])),
    "nothing": ("<body><nav><a href=x>x</a></nav>", (None, [])),
    "empty": ("", (None, [])),
    "null": (None, (None, [])),
    "cut": (f"<body><p>{LONG}</p><p class=\"open", (None, [LONG])),
}


def lines(texts):
    return "\n".join(" ".join(t.split()) for t in texts)


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    html, (title, texts) = PAGES[name]
    assert main_text(html) == (title, lines(texts))


def test_over_a_table(spark):
    rows = [(k, html) for k, (html, _) in PAGES.items()]
    got = spark.createDataFrame(rows, "name string, html string").select("name", parsed(F.col("html")).alias("p")).collect()
    assert {r.name: (r.p.title, r.p.text) for r in got} == {k: (t, lines(x)) for k, (_, (t, x)) in PAGES.items()}


def test_depth():
    """Very many open elements."""
    assert main_text("<div>" * 20000 + f"<p>{LONG}")[1] == lines([LONG])


def test_cut_references(spark):
    """A reference that is cut before its semicolon is text, and a written title keeps all but ampersands."""
    page = f"<title>Q &quot;a&quot; &amp;&amp;&amp</title><article><h1>Q &quot;a&quot; &amp;&amp;&amp</h1><p>{LONG} &ampx; &lt</p></article>"
    assert main_text(page) == ('Q "a" &&&amp', lines(['Q "a" &&&amp', LONG + " &ampx; &lt"]))
    got = spark.createDataFrame([(page,)], "html string").select(parsed(F.col("html")).alias("p")).first().p
    assert (got.title, got.written) == ('Q "a" &&&amp', "Q &quot;a&quot; &&&amp")

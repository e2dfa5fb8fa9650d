"""Pages whose article stands in unusual elements, or has no landmark: no text of it is lost."""

import time

import pytest

from parcelgrid.llm import main_text

MENU = "<nav class='menu'><ul><li><a href='/a'>Home</a></li><li><a href='/b'>Maps</a></li></ul></nav>"
END = "<footer class='footer'><p>All rights reserved.</p></footer>"
P1, P2, P3 = (
    "The road along the river was widened in the spring of that year.",
    "Each plot behind it keeps its old number and gains a strip of land.",
    "The council will decide about the remaining lots in the autumn.",
)
PAGES = {
    "icon closed at once": (f"<article><p>One <svg class='i'/> two words</p><p>{P1}</p></article>", f"One two words {P1}"),
    "icon with a drawing": (f"<article><p>One <svg><path d='M0 0'/><g><circle r='1'></circle></g></svg> two</p><p>{P1}</p></article>", f"One two {P1}"),
    "icon never closed": (f"<article><p>One <svg><path d='M0'> two</p><p>{P1}</p></article>", f"One two {P1}"),
    "formula": (f"<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p><p>{P1}</p></article>", f"Let x=2 be. {P1}"),
    "custom elements": (f"<article><template-card><p>{P1}</p></template-card><select-box><p>{P2}</p></select-box><p>{P3}</p></article>", f"{P1} {P2} {P3}"),
    "script and template": (f"<article><p>{P1}</p><script>var a='<p>x</p>';</script ><template><p>no</p></template\n><p>{P2}</p></article>", f"{P1} {P2}"),
    "table": (f"<article><p>{P1}</p><table><tr><td>{P2}</td><td>Area in hectares.</td></tr></table><p>{P3}</p></article>", f"{P1} {P2} Area in hectares. {P3}"),
    "terms": (f"<article><p>{P1}</p><dl><dt>Plot</dt><dd>{P2}</dd></dl><p>{P3}</p></article>", f"{P1} Plot {P2} {P3}"),
    "code": (f"<article><p>{P1}</p><pre>SELECT 1\n  FROM plots</pre><p>{P3}</p></article>", f"{P1} SELECT 1 FROM plots {P3}"),
    "noscript and object": (f"<article><p>{P1}</p><noscript><p>{P2}</p></noscript><object><p>{P3}</p></object></article>", f"{P1} {P2} {P3}"),
    "no landmark": (f"<div class='c1'><p>{P1}</p><p>{P2}</p><p>{P3}</p></div>", f"{P1} {P2} {P3}"),
    "no name at all": (f"<div><h1>The road</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div>", f"The road {P1} {P2} {P3}"),
    "deep menu": (f"<article><p>{P1}</p></article><nav>{'<div>' * 40}<span>Deep</span>{'</div>' * 40}</nav>", P1),
    "deep menu of names": (
        f"<article><p>{P1}</p></article><nav>" + "".join(f"<div id='n{i}'>" for i in range(300)) + "Deep" + "</div>" * 300 + "</nav>", P1),
}


@pytest.fixture(scope="module")
def labeller(spark):
    return main_text.fit_labeller(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_unusual_parts(spark, labeller):
    rows = [(k, "u", f"<html><body>{MENU}{PAGES[name][0]}{END}</body></html>") for k, name in enumerate(PAGES)]
    got = main_text.extract_text(spark.createDataFrame(rows, "page_id int, url string, html string"), labeller).collect()
    texts = {list(PAGES)[r.page_id]: r.text for r in got}
    assert texts == {name: want for name, (_, want) in PAGES.items()}


def test_a_path_keeps_its_landmarks_and_stays_bounded():
    path = main_text.path_to((), "nav menu")
    for i in range(500):
        path = main_text.path_to(path, f"div n{i}" + (" comments" if i == 50 else ""))
    words = {w for step in path for w in step.split(" ")}
    assert {"nav", "menu", "comments", "n499"} <= words and len(path) < 70
    start = time.time()
    deep = "".join(f"<div id='n{i}'>" for i in range(20_000)) + "end"
    assert [b.text for b in main_text.blocks_of(deep)] == ["end"] and time.time() - start < 20

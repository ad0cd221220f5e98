"""Items of pages by selectors, on nested and broken markup, with results told by hand."""

import pytest
from pyspark.sql import functions as F

from tessella import fixed
from tessella.sources import markup


def found(html, items, **fields):
    return [tuple(r) for r in markup.found_items(html, [markup._compiled(i) for i in items], [markup._compiled(f) for f in fields.values()])]


def test_first_selector_with_hits():
    html = "<div class='b x'><i>1</i></div><p data-id><i>2</i></p><p class=b><i>3</i><i>4</i></p>"
    assert found(html, [".a", ".b", "[data-id]"], t="i") == [("1",), ("3",)]
    assert found(html, [".a", "[data-id]"], t="i") == [("2",)]
    assert found(html, [".a"], t="i") == [] == found("", [".a"], t="i")


@pytest.mark.parametrize("selector,hits", [
    ("div", "ad"), ("#m", "b"), ("div .k", "bc"), ("div > .k", "b"), (".k.l", "c"), ('[data-x="1 2"]', "c"), ("[data-x~='2']", "c"), ("[data-x^=1]", "cd"), ("[data-x$='3']", "d"), ("[data-x*=' ']", "c"), ("b, [href]", "be"),
    ("nothing", ""), ("span.k, b.k", "bc"), ("*", "abcde"), ("div > span > b", ""), ("[data-x='a,b'], a", "e"), ("section .k", ""), ("div b.k span", "c"),
])
def test_selectors(selector, hits):
    html = "<div title=a><b class=k id=m title=b><span class='l k' data-x='1 2' title=c></span></b></div><div data-x=13 title=d></div><a href=# title=e>x</a>"
    tree = markup._Tree()
    tree.feed(html)
    assert "".join(e.attrs["title"] for e in markup._select(tree.root, markup._compiled(selector))) == hits


@pytest.mark.parametrize("selector", ["a:hover", "a + b", "..x", "[x"])
def test_selectors_that_are_not_understood(selector):
    with pytest.raises(ValueError):
        markup._compiled(selector)


@pytest.mark.parametrize("html,texts", [
    ("<ul><li>one<li>two<ul><li>in two</ul><li>three</ul>", ["one", "two\nin two", "in two", "three"]),
    ("<ul><li>a</b></div> b<li><p>c<p>d</li></ul>", ["a b", "c\nd"]),
    ("<li>open <b>bold", ["open bold"]),
    ("<li>x<script>var t = '<li>no</li>';</script> y<!-- <li>no --> z</li>", ["x y z"]),
    ("<li>&lt;b&gt; &amp;amp; &eacute;&#x1F600;&nbsp;<br/>next\n line </li>", ["<b> &amp; é😀\nnext line"]),
    ("<table><tr><td><li>in a cell</td><td>out</table></li>", ["in a cell"]),
    ("<LI CLASS=x>upper</LI >", ["upper"]),
    ("<li><img src=x>after<hr>rule</li>", ["after\nrule"]),
    ("<li>a</ul></li><li", ["a"]),
])
def test_broken_markup(html, texts):
    tree = markup._Tree()
    tree.feed(html)
    tree.close()
    assert [markup.inner_text(e).replace("\xa0", "").replace(" \n", "\n") for e in markup._select(tree.root, markup._compiled("li"))] == texts


def test_very_deep_and_long_markup():
    html = "<div>" * 20_000 + "<p class=m><b>deep</b></p>" + "x " * 100_000
    assert found(html, [".m"], t="b") == [("deep",)]


def test_messages(spark):
    one = lambda sender, content, time="": f"<div class=message-item><span class=name>{sender}</span><div class='msg-content y'>{content}</div>{time}</div>"
    pages = [
        (1, one("Ann Lee", "first", "<i class=time> 9:00 </i>") + one("Bo", "other") + one("Ann", "second<br>line") + one("Ann", "  ") + one("Ann Lee", "third")),
        (2, "<p>no message</p>"), (3, None), (4, ""), (5, one("Ann", "[图片]") + "<div class=message-item>no parts</div>"), (6, "<div data-message-id=7><b class=sender-name>Ann</b><u class=text-content>by id"),
    ]
    df = spark.createDataFrame(pages, "page_id long, html string")
    read = lambda **o: {r.page_id: [tuple(m) for m in r.m] for r in df.select("page_id", markup.messages("html", fixed.PAGE_MESSAGES["browser"], "Ann", **o).alias("m")).collect()}
    all_ = read(placeholders=fixed.PLACEHOLDERS["api"])
    assert all_ == {1: [("Ann Lee", "first", "9:00"), ("Ann", "second\nline", ""), ("Ann Lee", "third", "")], 2: [], 3: [], 4: [], 5: [], 6: [("Ann", "by id", "")]}
    assert read(last=2)[1] == all_[1][1:] and read(last=2)[5] == [("Ann", "[图片]", "")]


def test_items_over_a_column(spark):
    df = spark.createDataFrame([("<ul><li><a>x</a><li>bare</ul>",)], "html string")
    assert [[tuple(x) for x in r.i] for r in df.select(markup.items(F.col("html"), ["li"], {"link": "a"}).alias("i")).collect()] == [[("x",), (None,)]]

"""HTML extraction: attributes as browsers read them, depth, visibility, time, and generated pages against html.parser."""

import random
import re
import time
from html.parser import HTMLParser

import pytest

from seqwright.llm import html_text


@pytest.mark.parametrize("page,text", [
    ("<a title=it's>x</a> don't <b>y</b> end", "x don't y end"),
    ('<a href="x>y</a> <b>z</b>', "y z"),                      # never closed: no quote
    ("<p class=a\"b id='c>d'>e", "e"), ("<p a = 'x>y' b>c", "c"), ("<img alt=a/>b<img alt='c'/>d", "a/bcd"),
    ("a <b", "a <b"), ("a < b > c", "a < b > c"), ("a<!-- x", "a"), ("a<!x>b<?y>c</>d", "abc</>d"), ("<b/>x", "x"),
    ("<div style='visibility:hidden'>a<span style='visibility: visible'>b</span>c</div>d", "b\nd"),
    ("<ul style='visibility:hidden'><li>a<li style='visibility:visible'>b</ul>c", "- b\n\nc"),
    ("<table><tr style='visibility:collapse'><td>a<td>b<tr><td>c<td>d</table>", "c | d"),
    ("<div>" * 250 + "<p hidden>secret</p><p>a</p><p>b</p>", "a\n\nb"),
    ("<blockquote>" * 400 + "<b hidden>no</b>x<p>y", None), ("<ul><li>" * 400 + "x<b style=display:none>no</b>", None),
    ("<table><tr><td>" * 300 + "x", None)])
def test_page(page, text):
    got = html_text.to_text(page)[0]
    if text is not None:
        assert got == text
    assert "no" not in re.findall(r"\w+", got) and "secret" not in got


def test_time_is_linear_in_the_page():
    def spent(page):
        t = time.process_time()
        html_text.to_text(page)
        return time.process_time() - t

    for unit in ('<a href="x" ', "<a b='", '<a b="x>', "<div>", "<p><b>x", "</p>", "<!", "<td><table>", "</script ", "<script>", "<li><p>", "<div a=b>t</div>"):
        small, large = unit * (36_000 // len(unit)), unit * (720_000 // len(unit))
        assert spent(large) < 20 * 6 * max(spent(small), 0.02), unit


VOIDS = {"br", "hr", "img", "input"}


class Plain(HTMLParser):
    """The words a page shows, in order, of well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.words = [], []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        style = re.sub(r"\s", "", a.get("style") or "")
        gone = self.open[-1][1] if self.open else False
        shown = self.open[-1][2] if self.open else True
        gone = gone or tag in ("script", "style", "template", "title") or "hidden" in a or "display:none" in style
        shown = True if "visibility:visible" in style else False if "visibility:hidden" in style else shown
        if tag not in VOIDS:
            self.open.append((tag, gone, shown))
        elif tag == "img" and not gone and shown:
            self.words += re.findall(r"\w+", a.get("alt") or "")

    def handle_endtag(self, tag):
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        if not self.open or (not self.open[-1][1] and self.open[-1][2]):
            self.words += re.findall(r"\w+", data)


def generated(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.4 or depth > 6:
            out.append(" ".join(rng.choice(["one", "zwei", "trés", "x&amp;y", "&lt;b&gt;", "it's", '"q"', "7"]) for _ in range(rng.randint(1, 5))) + " ")
            continue
        attrs = rng.choice(["", "", "", " hidden", " style='display: none'", ' style="visibility:hidden"', " style=visibility:visible", " title=it's",
                            " title='a > b'", ' data-x="<p>"'])
        if kind < 0.5:
            out.append(rng.choice(["<br>", "<!-- <b>no</b> -->", "<script>if (a < b) no()</script>", f"<img{attrs} alt=' pic '>", "<style>p > b</style>"]))
        elif kind < 0.6:
            out.append(f"<ul{attrs}>" + "".join(f"<li>{generated(rng, depth + 1)}</li>" for _ in range(rng.randint(1, 3))) + "</ul>")
        elif kind < 0.7:
            rows = "".join("<tr>" + "".join(f"<td>{rng.randint(1, 99)}</td>" for _ in range(2)) + "</tr>" for _ in range(2))
            out.append(f"<table{attrs}>{rows}</table>")
        else:
            tag = rng.choice(["div", "section", "b", "span", "em", "blockquote", "h2"])
            out.append(f"<{tag}{attrs}>{generated(rng, depth + 1)}</{tag}>")
    return "".join(out)


def test_generated_pages_show_the_words_of_a_plain_parser():
    rng = random.Random(11)
    for _ in range(400):
        page = generated(rng)
        p = Plain()
        p.feed(page)
        p.close()
        assert re.findall(r"\w+", html_text.to_text(page)[0]) == p.words, page

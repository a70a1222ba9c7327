"""HTML extraction against a plain walk of well-formed trees, and pages that are anything but."""

from __future__ import annotations

import html
import random
import time
from html.parser import HTMLParser

import pytest

from tasklattice.llm import html_text

class Words(HTMLParser):
    """The words of a page that are not inside of hidden elements, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        self.hidden.append(tag in ("script", "style", "template") or "hidden" in values or "none" in (values.get("style") or ""))

    def handle_endtag(self, tag):
        self.hidden.pop()

    def handle_data(self, data):
        if not any(self.hidden):
            self.words += data.split()


def random_tree(rng, depth=0):
    if depth > 5 or rng.random() < 0.3:
        return " ".join(rng.choice(["alpha", "beta & gamma", "x < y", "é", "1.", "-"]) for _ in range(rng.randint(0, 4))).replace("&", "&amp;").replace("<", "&lt;")
    name = rng.choice(("div", "section", "blockquote", "h2", "span", "b", "em", "select", "math", "svg", "script", "template"))
    given = rng.choice(["", "", "", " hidden", ' style="display: none"', ' class="a > b"', " data-x='\"'"])
    inner = "var words = 1;" if name == "script" else " ".join(random_tree(rng, depth + 1) for _ in range(rng.randint(0, 4)))
    return f"<{name}{given}> {inner} </{name}>"


@pytest.mark.parametrize("seed", range(30))
def test_all_visible_words_in_order(seed):
    page = " ".join(random_tree(random.Random(seed * 100 + k)) for k in range(6))
    plain = Words()
    plain.feed(page)
    plain.close()
    assert html_text.render(page).split() == plain.words


def test_tables_keep_every_cell_in_its_row_and_column():
    rng = random.Random(4)
    for _ in range(20):
        wide, tall = rng.randint(1, 5), rng.randint(1, 6)
        cells = [["x" * rng.randint(1, 12) for _ in range(wide)] for _ in range(tall)]
        page = "<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in cells) + "</table>"
        widths = [max(len(row[k]) for row in cells) for k in range(wide)]
        assert html_text.render(page).split("\n") == [" | ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip() for row in cells]


def test_lists_count_as_they_are_told():
    page = "<ol start=-3><li>a<li>b<li value=2020>c<li>d</ol><ol><li value='x'>e<li value=0>f</ol><ol start=1001><li>g</ol>"
    assert [x for x in html_text.render(page).split("\n") if x] == ["-3. a", "-2. b", "2020. c", "2021. d", "1. e", "0. f", "1001. g"]


def test_text_of_selections_formulas_and_drawings_is_visible():
    page = "<select><option>one<option selected>two</select><math><mi>x</mi><mo>=</mo></math><svg><text>label</text><script>no</script></svg>"
    assert html_text.render(page) == "one\ntwo\nx=label"


@pytest.mark.parametrize("part", ["<b ", "<!", "</", "<b '", '<b "', "<!--", "<", "<script", "</script ", "&", "<b =", "<p><b>", "<li>", "<td>", "<table><tr><td>", "<a b='", "<b\n"])
@pytest.mark.parametrize("end", ["", ">", "-->", "' \"> end"])
def test_malformed_pages_of_any_size_end(part, end):
    count = 300_000 // len(part)
    began = time.process_time()
    html_text.render(part * count + end)
    html_text.render("<script>" + part * count + end)
    assert time.process_time() - began < 30


def test_unclosed_comments_and_tags():
    assert html_text.render("a <!-- b > c") == "a"
    assert html_text.render("a <!-- b > c --> d") == "a d"
    assert html_text.render("<p>a</p> b <!-- c") == "a\n\nb"
    assert html_text.render("a <b c") == html.unescape("a <b c")
    assert html_text.render("<script>x > y") == ""
    assert html_text.render("<title>t</title><p>x") == "x"


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract(pages).collect() == []

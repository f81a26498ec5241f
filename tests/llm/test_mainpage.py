"""Main text of pages: hand-made pages of many kinds, and real ones against another parser."""

import html
from html.parser import HTMLParser

import pytest

from pourstat.llm import mainpage
from pourstat.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"
PROSE = [f"Sentence {i} tells a good deal about the subject at hand, at some length, and ends here." for i in range(8)]
BODY = "".join(f"<p>{p}</p>" for p in PROSE)
MENU = "<ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "home news sport about contact".split()) + "</ul>"


class ByParser(HTMLParser):
    """Blocks of the first article, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.inside, self.blocks, self.parts = False, [], []

    def cut(self):
        text = " ".join(html.unescape("".join(self.parts)).split())
        self.blocks += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = True
        if tag == "footer":
            self.cut()
            self.inside = False
        if tag in ("p", "h1"):
            self.cut()
        if tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.cut()
        if tag == "article":
            self.inside = False

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def test_real_pages_match_another_parser(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op12_main_text"](spark, SF).collect()
    assert len(got) == len(pages)
    whole = 0
    for r in got:
        assert r.n_chars == len(r.text)
        page = pages[r.page_id]
        if "</html>" in page:  # the other parser handles the end of broken pages in its own way
            p = ByParser()
            p.feed(page)
            p.close()
            assert r.text == "\n".join(p.blocks)
            whole += 1
    assert whole > 200


CASES = {
    "marked article": (f"<nav>{MENU}</nav><article><h1>Title</h1>{BODY}</article><footer>Imprint</footer>", ["Title", *PROSE]),
    "div soup": (
        f"<div>{MENU}</div><div><h1>Title</h1>{BODY}</div><div>{MENU}</div><div>All rights reserved</div>",
        ["Title", *PROSE],
    ),
    "notices and adverts": (
        f'<div class="cookie-notice">We use cookies {PROSE[0]}{PROSE[1]}</div><main>{BODY}<div class="ad">Buy now {PROSE[2]}</div></main>'
        f'<aside>{BODY}</aside><div id="sidebar">{BODY}</div>',
        PROSE,
    ),
    "reader comments": (
        f'<article>{BODY}<section class="comments"><article class="comment"><p>{PROSE[0]} I agree.</p></article></section></article>'
        f'<div id="comments"><p>{PROSE[1]} Me too.</p></div>',
        PROSE,
    ),
    "header inside and outside": (
        f"<header><h2>Site of many things</h2>{MENU}</header><article><header><h1>Title</h1></header>{BODY}</article>",
        ["Title", *PROSE],
    ),
    "forms and raw text": (
        f"<article><form><p>{PROSE[0]}</p><input name=q><button>Go</button></form><script>if (a < b) x('</p>{PROSE[1]}')</script>"
        f"<style>p{{x}}</style><noscript>{PROSE[2]}</noscript>{BODY}<!-- <p>{PROSE[3]}</p> --></article>",
        PROSE,
    ),
    "frame with a telling name": (f'<div class="page with-sidebar"><article>{BODY}</article><div class="sidebar">{BODY}</div></div>', PROSE),
    "short lines inside": (f"<div>{MENU}</div><div>{BODY}<p>Yes.</p>{BODY}</div>", [*PROSE, "Yes.", *PROSE]),
    "references and space": (
        "<article><p>a &amp;&lt;b&gt; &#233;&#x20AC; c\n\t  d<br>e <b>f</b><i>g</i></p><p> &nbsp; </p><p>&copy; &unknown;</p></article>",
        ["a &<b> é€ c d e fg", "© &unknown;"],
    ),
    "unclosed": (f"<nav>{MENU}<article><p><b>{PROSE[0]}<br><p>{PROSE[1]}<li>{PROSE[2]}<footer>{PROSE[3]}", PROSE[:3]),
    "breaks off in a tag": (f'<article><p>{PROSE[0]}</p><p>{PROSE[1]}</p><a hre', PROSE[:2]),
    "article without a word": (f"<article></article><div>{BODY}</div>", PROSE),
    "one short line": ("<body><p>Only this.</p></body>", ["Only this."]),
    "attributes with signs": (f'<article><p title="a > b">{PROSE[0]}</p><p data-x=\'<p>\'>{PROSE[1]} 1 < 2</p></article>', [PROSE[0], PROSE[1] + " 1 < 2"]),
    "hidden": (f'<article>{BODY}<p hidden>{PROSE[0]}</p><div style="display: none">{PROSE[1]}</div></article>', PROSE),
}


@pytest.mark.parametrize("case", CASES)
def test_page(case):
    body, expected = CASES[case]
    page = f"<!DOCTYPE html><html><head><title>Other title</title><script>1<2</script></head><body>{body}</body></html>"
    assert mainpage.extract(page if "breaks off" not in case else f"<html><body>{body}") == "\n".join(expected)


def test_surge_and_dive():
    import numpy as np

    weight = np.array([5, 0, 0, 0, 90, 3, 0, 60, 0, 0, 0, 0, 7, 0, 0, 0, 30, 30, 30])
    kept = mainpage.main_lines(weight, surge=80, window=3)
    assert np.flatnonzero(kept).tolist() == [4, 5, 7, 16, 17, 18]
    assert not mainpage.main_lines(np.zeros(4, int), 80).any()
    assert not mainpage.main_lines(np.array([], int), 80).any()


def test_awkward_rows(spark):
    long = "<article>" + "".join(f"<p>{i} {PROSE[0]}</p>" for i in range(20_000)) + "</article>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", "  "), (3, "u", "plain words"), (3, "u", "plain words"), (4, "u", long), (5, "u", "<" * 2000), (6, "u", "<p" + " a='" * 500)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = mainpage.main_texts(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = [r.text for r in got.collect()]
    assert texts[:5] == ["", "", "", "plain words", "plain words"]
    assert texts[5].count("\n") == 19_999 and len(texts) == len(rows)
    assert mainpage.main_texts(df.limit(0)).count() == 0


def test_work_is_linear_in_the_page():
    import time

    def seconds(n):
        start = time.perf_counter()
        mainpage.extract("<div><p title='" * n)
        mainpage.extract("<div>" * n + "x")
        mainpage.extract("<article><p>a</article>" * n)
        mainpage.extract("<div>" * n + "</b></nav>" * n + "<main>" * n + "<article><footer>" * n)
        return time.perf_counter() - start

    seconds(200)
    assert seconds(4000) < 60 * max(seconds(400), 0.005)

import math

import pytest

from plumbline.llm import html_text as h

PROSE = "Here is a sentence, with commas, of some length. And another one follows it; so it reads like prose."
LINKS = "".join(f'<li><a href="/{i}">Topic number {i} of the list</a></li>' for i in range(8))

CASES = {
    "article": (f"<body><nav>{LINKS}</nav><article><h1>T</h1><p>{PROSE}</p><p>Short</p></article><footer>(c) us, all rights.</footer></body>", ["T", PROSE, "Short"]),
    "no marks of html5": (f"<html><body><div id=top><ul>{LINKS}</ul></div><div id=text><h2>T</h2><p>{PROSE}</p><p>{PROSE}</p><p>Short</p></div><div id=low>Terms</div></body></html>",
                          ["T", PROSE, PROSE, "Short"]),
    "table layout": (f"<table><tr><td><a href=x>One</a><br><a href=y>Two</a></td><td><p>{PROSE}<p>{PROSE}</td></tr></table>", [PROSE, PROSE]),
    "cues": (f"<main><div class='article-body'><p>{PROSE}</p><div class='ad-box'>{PROSE}</div><p>{PROSE}</p></div><section id=comments><p>{PROSE}</p></section>"
             f"<div class='cookieNotice'>{PROSE}</div></main>", [PROSE, PROSE]),
    "comments as articles": (f"<article><p>{PROSE}</p><article class=comment><p>{PROSE}</p></article></article>", [PROSE]),
    "header of the article": (f"<header><h1>Site</h1></header><article><header><h1>Title</h1><span>by me</span></header><p>{PROSE}</p></article>", ["Title", PROSE]),
    "forms and hidden parts": (f"<article><p>{PROSE}</p><form><p>{PROSE}</p></form><p hidden>{PROSE}</p><p style='display: none'>{PROSE}</p></article>", [PROSE]),
    "a form round the page": (f"<body><form id=all><div><p>{PROSE}</p></div></form></body>", [PROSE]),
    "raw text": (f"<article><script>var a = '<p>x</p>';</script><p>{PROSE}<style>p{{}}</style> on</p><textarea><p>no</p></textarea></article>", [PROSE + " on"]),
    "implied ends": ("<article><p>One<p>Two<ul><li>a<li>b</ul><p><b>Three<br><p>Four</article>", ["One", "Two", "a", "b", "Three", "Four"]),
    "references": ("<article><p>A &amp;amp; B &lt;c&gt; &eacute;&nbsp;&#233; &am &unknown; &amp</p></article>", ["A &amp; B <c> é é &am &unknown; &"]),
    "white space": ("<article><p>  a\n\t b <i> c</i>d　e </p>\n<p> </p></article>", ["a b cd e"]),
    "comments of html": (f"<article><!-- a > b <p> --><p>{PROSE}</p><!-- not closed <p>{PROSE}</p></article>", [PROSE]),
    "quotes": ("<article><p title='a > b' data-x=it's>One</p><p class=\"x>Two</p></article>", ["One", "Two"]),
    "no markup": ("Just text, no tag.", ["Just text, no tag."]),
    "lone signs": ("<article><p>1 < 2 and 3 > 2 <3</p></article>", ["1 < 2 and 3 > 2 <3"]),
    "stray ends": ("<article><p>a</div></b></p>b</article></div>", ["a", "b"]),
    "cut off": ("<article><p>One</p><p>Two <a href='x", ["One", "Two"]),
    "nothing": ("<nav>Menu</nav><footer>F</footer>", []),
    "empty": ("", []),
}


@pytest.mark.parametrize("name", CASES)
def test_articles(name):
    page, wanted = CASES[name]
    assert h.main_text(page) == "\n\n".join(wanted)


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + f"<p>{PROSE}</p>" + "</div>" * 5000
    assert h.main_text(deep) == PROSE
    assert h.main_text("<b>" * 5000 + PROSE) == PROSE
    long = "<article>" + f"<p>{PROSE}</p>" * 5000 + "</article>"
    assert h.main_text(long) == "\n\n".join([PROSE] * 5000)
    assert h.main_text("<" * 20000) == "<" * 20000
    assert h.main_text("<a " + "x='" * 20000) == ""


def test_scores_are_those_of_the_definition():
    page = f"<body><div><a href=x>Link text</a></div><div class=c><h2>Head</h2><p>{PROSE}</p><p>Short.</p></div><div><p>Low, text.</p></div></body>"
    found = h.blocks(page)
    paths = {b.element: b.element.path for b in found}
    got = h.path_scores(found, paths)
    order = list(dict.fromkeys(paths[b.element] for b in found))
    assert order == ["/body/div", "/body/div.c/h2", "/body/div.c/p", "/body/div/p"]
    ratio = {p: [sum(len(b.text) - b.linked for b in found if paths[b.element] == p), sum(len(h.MARKS.findall(b.text)) for b in found if paths[b.element] == p),
                 sum(paths[b.element] == p for b in found)] for p in order}
    for i, p in enumerate(order):
        text = marks = total = 0
        for j in range(max(0, i - 2), min(len(order), i + 3)):
            a, b = p.split("/"), order[j].split("/")
            same = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            w = math.exp(-2 * (i - j) ** 2) * ((same / max(len(a), len(b))) ** 2 + 1e-9)
            t, m, n = ratio[order[j]]
            text, marks, total = text + w * t / n, marks + w * m / n, total + w
        assert got[p] == pytest.approx(math.sqrt(text / total * (1 + marks / total)))
    assert max(got, key=got.get) == "/body/div.c/p"


def test_every_page_gets_a_row(spark):
    rows = [(1, "u", "<article><p>a</p></article>", "x", 1), (1, "u", "<article><p>a</p></article>", "x", 1), (None, None, None, None, None), (3, "v", "", "y", 2), (4, "é", "<p>é</p>", "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, `text` string, n_chars int")
    got = h.extract(pages.repartition(2)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (3, "v", "", 0), (4, "é", "é", 1)], key=str)
    assert h.extract(pages.limit(0)).count() == 0

import random
import time

import pytest

from lonja.llm import htmltext as H

PAGES = "page_id long, url string, html string"
CASES = [
    (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a\n\nb"), ("<b>x</i>y</b>", "xy"), ("<script>var a='<p>zz</p>'", ""),
    ("<article><h1>T</h1><p>one\n two&nbsp;three<br>four</p></article><footer>f</footer>", "T\n\none two three four"),
    ("<body><nav><ul><li><a href=x>m</a></ul></nav><article><p>x</p></article><div class='ad'>buy</div></body>", "x"),
    ("<article><p>x</p><div class=comments><p>me too</p></div><aside>s</aside><form><input><p>f</p></form></article>", "x"),
    ("<main><p>a</p><!-- <p>no</p> --><style>p{}</style><p>b &lt;i&gt;</p></main>", "a\n\nb <i>"), ("<p title='a > b'>x</p>", "x"), ("<p title=\"open>x</p>", "x"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<div hidden>h</div><div style='display: none'>d</div><div>v</div>", "v"), ("<p>1 < 2", "1 < 2"), ("<![CDATA[c]]>d", "cd"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_pages(page, text):
    assert H.main_text(page) == text


def test_densest_subtree_without_semantic_names():
    say = lambda n: " ".join(["word"] * n)
    links = "".join(f"<li><a href={k}>link number {k}</a></li>" for k in range(12))
    page = f"<div><ul>{links}</ul></div><div><div><p>{say(60)}</p><p>{say(3)}</p><p>{say(80)}</p></div></div><div><a href=1>x y</a><a href=2>z</a></div>"
    assert H.main_text(page) == "\n\n".join([say(60), say(3), say(80)])


def test_densities_follow_the_formula():
    import math

    root = H.parse("<div><p>" + "a" * 50 + "</p><p>bb<a href=x>cccc</a></p></div><ul><li><a href=y>dddd</a></li></ul>")
    H.measure(root)
    p = root.children[0].children[1]
    assert (p.chars, p.tags, p.link_chars, p.link_tags) == (6, 1, 4, 1)
    base = math.log(6 / 2 * 4 + 8 / 60 * 6 + math.e)
    assert math.isclose(p.density, 6 * math.log(6 / 4 + 1e-9) / math.log(base))
    assert math.isclose(root.children[0].sum, sum(c.density for c in root.children[0].children))


def test_any_markup_is_taken():
    rng = random.Random(8)
    bits = ["<p>", "</p>", "<div class=\"ad\">", "</div>", "text ", "<a href='x'>", "</a>", "<", ">", "\"", "'", "<!--", "-->", "<script>", "</script>", "&amp", "&#x41;", "<br/>", "<li>", "</article>", "<article>", "<nav>", "</nav>", "</", "<td>"]
    for _ in range(2000):
        H.main_text("".join(rng.choice(bits) for _ in range(rng.randint(0, 40))))


def test_deep_and_long_pages():
    H.main_text("<div>" * 20_000 + "x")
    H.main_text("<b>" * 50_000)
    assert len(H.main_text("<p>" + "word " * 200_000)) == 999_999


@pytest.mark.parametrize("page", ["<b>" * 200_000 + "</i>" * 200_000, "<p><td>" + "<b>" * 100_000 + "<li>x" * 100_000, "<div hidden>" + "<b>" * 200_000 + "</i>" * 200_000,
                                  "<div hidden>" + "<b>" * 1_000 + "</section>" * 200_000])
def test_unclosed_and_unopened_tags_are_linear(page):
    began = time.process_time()
    H.parse(page)
    assert time.process_time() - began < 30  # each end tag looking through all open ones takes many minutes


def test_extract(frame):
    rows = [(1, "u", "<p>é</p>"), (None, None, None), (2, "v", ""), (2, "v", "")]
    out = H.extract(frame(rows, PAGES, ("text", "n_chars"))).collect()
    assert sorted((tuple(r) for r in out), key=str) == sorted([(1, "u", "é", 1), (None, None, "", 0), (2, "v", "", 0), (2, "v", "", 0)], key=str)
    assert H.extract(frame([], PAGES)).collect() == []


SAY = " ".join(["word"] * 40)
PARTS = "".join(f"<p>{SAY} {k}</p>" for k in range(10))
TEXT = "\n\n".join(f"{SAY} {k}" for k in range(10))


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "layout has-sidebar", "no-sidebar", "sidebar", "search", "advertising-and-society"])
def test_wrappers_of_the_text_stay(name):
    assert H.main_text(f"<div class='{name}'><article>{PARTS}</article></div>") == TEXT
    assert H.main_text(f"<div class='{name}'><div>{PARTS}</div></div><div class=sidebar>x</div>") == TEXT
    assert H.main_text(f"<form id='{name}'><div>{PARTS}</div></form>") == TEXT


def test_ids_from_titles_stay():
    page = "<article><h2 id=search>Search</h2><p>a b</p><section id=related><h2>Related</h2><p>c d</p></section><div class=related><p>no</p></div></article>"
    assert H.main_text(page) == "Search\n\na b\n\nRelated\n\nc d"


def test_sibling_containers_without_semantic_names():
    links = "<ul>" + "".join(f"<li><a href={k}>link number {k}</a></li>" for k in range(12)) + "</ul>"
    short = "".join(f"<p>{SAY[:89]} {k}</p>" for k in range(6))
    for second, text in ((PARTS, TEXT), (short, "\n\n".join(f"{SAY[:89]} {k}" for k in range(6)))):
        page = f"<div><h1>The title</h1></div>{links}<div>{PARTS}</div><div>{second}</div><div><a href=a>one</a> <a href=b>two</a></div>"
        assert H.main_text(page) == f"The title\n\n{TEXT}\n\n{text}"


def test_text_beside_an_article_stays():
    assert H.main_text(f"<div>{PARTS}</div><article><p>a teaser of some words</p></article>") == TEXT + "\n\na teaser of some words"


def test_text_in_cells_beside_the_densest_part_stays():
    assert H.main_text(f"<div>{PARTS}</div><table><tr><td><div>a cell</div></td></tr></table><div>bare words</div>") == TEXT + "\n\na cell"

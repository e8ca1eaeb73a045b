import time

import pytest

from arcline.llm.html_text import extract_main_text, main_text, read_page

SCHEMA = "page_id long, url string, html string"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body><nav>m</nav><article><h1>T &lt;x&amp;y</h1><p>a <b>b</b>\n c<br>d<p>e</article><footer>f</footer>", "T <x&y\n\na b c d\n\ne"),
        ("<article><p>one<p>two<div class='comments'><p>no</p></div><aside>no</aside><form>no</form></article>", "one\n\ntwo"),
        ("<div id=main><ul><li>a<li>b</ul>loose</div><script>if (a<b) {}</script><style>p{}</style>", "a\n\nb\n\nloose"),
        ("<article><p><b>un<br><p>closed <i>markup</article>", "un\n\nclosed markup"),
        ("<article><!-- <p>no</p> --><p>x<span class='ad'>buy</span>y</p>", "xy"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>cut <a href='x", "cut"),
        ("just text &#233; &nbsp; end", "just text é end"),
        ("", ""),
        ("<nav>only a menu</nav>", ""),
    ],
)
def test_blocks(html, text):
    assert main_text(read_page(html), None) == text


def test_host_consensus(spark):
    """Pages of a host agree on div.story; a page with more text in another box follows them."""
    page = "<body><div class='story s{}'><p>{}</p></div><div class='box'><p>{}</p></div></body>"
    rows = [(i, f"http://h.org/{i}", page.format(i, f"story {i} " * 30, "box")) for i in range(20)]
    rows.append((50, "http://H.org/x?y", page.format(9, "short", "box words " * 60)))
    rows += [(60, None, None), (61, "nothing", ""), (62, "http://other.org/", "<p>plain"), (60, None, None), (63, "http://h.org/long", "<article>" + "<p>word " * 50_000)]
    got = {r["page_id"]: r for r in extract_main_text(spark.createDataFrame([(*r, "p") for r in rows], SCHEMA + ", path string").repartition(3)).collect()}
    assert got[50]["text"] == "short" and got[3]["text"] == ("story 3 " * 30).strip()
    assert got[60]["text"] == "" == got[61]["text"] and got[62]["text"] == "plain"
    assert got[63]["n_chars"] == len(got[63]["text"]) == 50_000 * 6 - 2
    assert extract_main_text(spark.createDataFrame([], SCHEMA)).count() == 0


STORY = "".join(f"<p>Paragraph {i} of the story is long enough.</p>" for i in range(6))


@pytest.mark.parametrize(
    "wrapper",
    ["layout with-sidebar", "content no-sidebar", "post has-comments", "search-page", "widget", "search page widget"],
)
@pytest.mark.parametrize("inner", ["article", "div"])
def test_side_words_round_the_whole_article(wrapper, inner):
    side = "<div class='comments'><p>first!</p></div><div class='related'><a href='x'>more</a></div>"
    page = f"<body><div class='{wrapper}'><div class='share box'><{inner}>{STORY}</{inner}></div>{side}</div><div class='ad'>buy</div></body>"
    text = main_text(read_page(page), None)
    assert text.startswith("Paragraph 0") and text.count("Paragraph") == 6
    assert not any(word in text for word in ("first!", "more", "buy"))


def test_side_parts_beside_the_article_go():
    cards = "<div class='related'>" + "<article><a href='x'>teaser of another story</a></article>" * 9 + "</div>"
    comments = "<div id='comments'><p>a long remark of someone</p><p>yes</p></div>"
    for page in (f"<main>{STORY}{comments}</main>{cards}", f"<div class='story'>{STORY}{comments}</div>{cards}"):
        text = main_text(read_page(page), None)
        assert text.count("Paragraph") == 6 and "teaser" not in text and "remark" not in text


def test_nested_side_elements_take_one_more_reading():
    """The text stands below thousands of elements with side words; each level holds all of it."""
    deep = "<div class=widget>" * 4000 + "<p>" + "the text " * 50 + "</p><div class=share>no</div>" + "</div>" * 4000
    start = time.perf_counter()
    assert main_text(read_page(f"<body>{deep}</body>"), None) == ("the text " * 50).strip()
    assert time.perf_counter() - start < 1.0


def test_nested_side_elements_are_judged_in_turn():
    inner = "<div class='sidebar'><p>links here</p></div><div class='modal'><p>" + "words of it " * 20 + "</p></div>"
    page = f"<body><div class='widget'>{inner}<div class='ad'><p>buy</p></div></div><div class='menu'>menu</div></body>"
    assert main_text(read_page(page), None) == ("words of it " * 20).strip()

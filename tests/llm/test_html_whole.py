"""An article comes whole: leads, references, tables, titles, code and parts with telling names."""

import time

import pytest

from backtrail.llm import html_text

NAV = "<nav><ul>" + "".join(f"<li><a href=/{i}>Menu entry {i}</a></li>" for i in range(8)) + "</ul></nav>"
FOOT = "<footer><p>Copyright of someone, all rights reserved.</p><a href=/x>Imprint</a></footer>"
LONG = [f"Paragraph {i} of the text, which is long enough to be told from what stands around it on the page." for i in range(5)]
BODY = "<div class=body>" + "".join(f"<p>{x}</p>" for x in LONG) + "</div>"


def page(inside):
    return f"<html><body>{NAV}{inside}{FOOT}</body></html>"


def words(text):
    return text.split()


@pytest.mark.parametrize("inside, want", [
    (f"<article><h1>Title</h1><p class=lead>The lead.</p>{BODY}<p>The end.</p></article>",
     ["Title", "The lead.", *LONG, "The end."]),
    (f"<article><h1>T</h1>{BODY}<section><h2>References</h2><ol><li><a href=/1>First work</a></li><li><a href=/2>Second"
     f"</a></li><li><a href=/3>Third</a></li></ol></section></article>",
     ["T", *LONG, "References", "First work", "Second", "Third"]),
    (f"<article>{BODY}<div><table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table></div></article>",
     [*LONG, "a", "1", "b", "2"]),
    (f"<article>{BODY}<section id=discussion><h2 id=search>Search</h2><p>Short talk.</p></section></article>",
     [*LONG, "Search", "Short talk."]),
    (f"<article>{BODY}<pre><code><span class='token comment'># a comment</span> x = 1</code></pre></article>",
     [*LONG, "# a comment x = 1"]),
    (f"<article>{BODY}<p>See <span class=related>this</span> and <a class=share href=/y>that</a>.</p></article>",
     [*LONG, "See this and that."]),
    (f"<main>{BODY}<p><a href=/one>One link of its own</a></p></main>", [*LONG, "One link of its own"]),
    (f"<div><h1>Title</h1><div><p>{LONG[0]}</p><p>{LONG[1]}</p><p>{LONG[2]}</p></div><div><p>{LONG[3]}</p></div>"
     f"<div><p>{LONG[4]}</p></div></div>", ["Title", *LONG]),
    (f"<h1>Title</h1>{BODY}<h2>Next</h2>{BODY}", ["Title", *LONG, "Next", *LONG]),
    (f"<div>Bare text first. <p>{LONG[0]}</p><p>{LONG[1]}</p><p>{LONG[2]}</p> and bare text last</div>",
     ["Bare text first.", *LONG[:3], "and bare text last"]),
])
def test_nothing_of_the_article_is_lost(inside, want):
    assert html_text.extract(page(inside)) == " ".join(want)


@pytest.mark.parametrize("box", [
    "<div class=related><p>Another article that you may like, with a teaser text of some length to it.</p></div>",
    "<ul><li><a href=/a>Other one</a></li><li><a href=/b>Other two</a></li><li><a href=/c>Other three</a></li></ul>",
    "<div><h3>Elsewhere</h3><a href=/a>Other one</a> <a href=/b>Other two</a> <a href=/c>Other three</a></div>",
    "<aside><p>A remark at the side that is long enough to be a paragraph of the text itself.</p></aside>",
    "<div role=navigation><a href=/a>Up</a></div>", "<form><p>Write to us here, we shall read it all.</p></form>",
])
def test_what_is_not_the_article_goes(box):
    for inside in (f"<article>{BODY}{box}</article>", f"<main>{BODY}{box}</main>", f"<div>{BODY}{box}</div>"):
        assert html_text.extract(page(inside)) == " ".join(LONG), inside


def test_comments_by_id_go_outside_of_articles():
    box = "<div id=comments><p>A reader says something long about the article, at length, as readers do.</p></div>"
    assert html_text.extract(page(f"<article>{BODY}</article>{box}")) == " ".join(LONG)
    assert html_text.extract(page(f"<div>{BODY}</div>{box}")) == " ".join(LONG)


def test_time_is_linear_in_depth():
    def spent(depth):
        text = "<div>" * depth + "<p>deep</p>" + "</div>" * depth
        best = 9.0
        for _ in range(3):
            start = time.perf_counter()
            assert html_text.extract(text) == "deep"
            best = min(best, time.perf_counter() - start)
        return best

    spent(100)
    assert spent(16_000) < 9 * spent(4_000)

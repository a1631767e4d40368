"""Articles in markup that is easily taken for furniture, and furniture that stays out."""

import pytest

from roadframe.llm import html

HEAD = "Heading of the article here"
PARTS = [" ".join(f"word{i}x{j}" for j in range(30)) + "." for i in range(4)]
BODY = f"<h1>{HEAD}</h1>" + "".join(f"<p>{p}</p>" for p in PARTS)
SIDE = "<p>" + "side words " * 6 + "</p>"
PAGES = {
    "bare": f"<article>{BODY}</article>",
    "self-closing svg": f"<article><svg class='i'/>{BODY}</article>",
    "custom element": f"<article><svg-icon name='x'></svg-icon>{BODY}</article>",
    "open object": f"<article><object data=x>{BODY}</article>",
    "open object before a closed one": f"<article><object data=x>{BODY}<object data=y>alt</object></article>",
    "page in a form": f"<form id='f'><nav><a href='/'>x</a></nav><article>{BODY}</article><footer>foot words</footer></form>",
    "page in a form, no article": f"<form id='f'><nav><a href='/'>x</a></nav><div>{BODY}</div><footer>foot words</footer></form>",
    "layout class": f"<div class='has-sidebar'><article>{BODY}</article><div class='sidebar'>{SIDE}</div></div>",
    "topic class": f"<div class='social-science'><div class='sidebar'>{SIDE}</div><article>{BODY}</article><div class='comments'><p>nice one</p></div></div>",
    "open cell": f"<table><tr><td class='nav'><a href='/'>n</a><td>{BODY}</table>",
    "form below": f"<article>{BODY}</article><form action='/s'><label>Your name</label><input><button>Send it</button></form>",
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, f"http://x/{k}", f"<html><body>{v}</body></html>") for k, v in PAGES.items()]
    rows += [("notice only", "u", "<div class='cookie-notice'>" + "we use cookies " * 30 + "</div>"), ("menu only", "u", "<nav><a href='/'>one two three</a></nav>"),
             ("long", "u", "<article>" + "".join(f"<p>{p}</p>" for p in PARTS) * 5000 + "</article>"), ("null", None, None), ("null", None, None)]
    d = spark.createDataFrame([(*r, "x") for r in rows], "page_id string, url string, html string, blocks string")
    return {r["page_id"]: r for r in html.main_text(d).collect()}


@pytest.mark.parametrize("name", PAGES)
def test_article_is_found(found, name):
    assert found[name]["text"] == "\n".join([HEAD, *PARTS])


def test_furniture_stays_out(found):
    assert found["notice only"]["text"] == found["menu only"]["text"] == found["null"]["text"] == ""
    assert found["long"]["text"] == "\n".join(PARTS * 5000) and found["long"]["n_chars"] == len(found["long"]["text"])


def test_picture_inside_a_paragraph_does_not_split_it():
    assert [b["text"] for b in html.parse_blocks("<p>before <svg><path/></svg>after it</p>")] == ["before after it"]

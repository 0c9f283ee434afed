import random

import pytest

from traceloom.llm import html_text as H

WORDS = "river stone walks quickly toward bright yellow market under seven trees every morning".split()


def page(rng, i, site="A"):
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    body = [say(rng.randrange(5, 40)) for _ in range(rng.randrange(1, 6))]
    title = say(5)
    if site == "A":
        html = f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';x({i})</script></head><body><nav><ul><li><a href='/'>{say(2)}</a></li></ul></nav><!-- ad {i} --><div class=\"ad\">{say(6)}</div><article><h1>{title}</h1>" + "".join(f"<p>{b} &amp; co</p>" for b in body) + f"</article><footer>&copy; {say(4)}</footer></body></html>"
        want = " ".join([title, *[f"{b} & co" for b in body]])
    else:
        html = f"<html><body><header><h2>{say(3)}</h2></header><div id='page'><div class='sidebar'>{say(9)}</div><div class='content'><h1>{title}</h1>" + "".join(f"<p>{b}<br>more</p>" for b in body) + f"<div class='share-buttons'>Share</div><p>All rights reserved here</p></div><div class='comments'><p>{say(12)}</p></div></div><form><p>{say(3)}</p></form></body></html>"
        want = " ".join([title, *[f"{b} more" for b in body]])
    return html, want


def test_hosts_with_their_own_templates(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(60):
        site = "AB"[i % 2]
        html, text = page(rng, i, site)
        rows.append((i, f"http://{site.lower()}.example/{i}", html))
        want[i] = text
    rows += [(100, "http://lone.example/", page(rng, 0, "A")[0]), (101, None, None), (102, "http://a.example/x", ""), (103, "no", "plain  text\n only"), (None, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS host", "3 AS frame", "4 AS constant")
    got = H.main_texts(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    for i, t in want.items():
        assert by_id[i] == t, i
    assert by_id[101] == by_id[102] == "" and by_id[103] == "plain text only" and by_id[None] == want[0]
    assert by_id[100].startswith(rows[60][2].split("<h1>")[1].split("</h1>")[0])


@pytest.mark.parametrize(
    "html,blocks",
    [
        ("<p>a <b>b</b>c</p>", ["a bc"]),
        ("<p>a<p>b", ["a", "b"]),
        ("x &lt;y&gt; &amp &#233;", ["x <y> & é"]),
        ("<script>if (a<b) '</p>'</script>t", ["t"]),
        ("<SCRIPT>x</SCRIPT >t<style>never closed", ["t"]),
        ("a<!-- <p>b</p> -->c<!-- open", ["ac"]),
        ("1 < 2 <3", ["1 < 2 <3"]),
        ('<p title="a>b">c</p>', ["c"]),
        ("a<br/>b<td>c", ["a", "b", "c"]),
        ("<div><p>a</div>b</p></ul>c", ["a", "b", "c"]),
        ("\x85a\n\tb ", ["a b"]),
        ("<p", []),
        ("", []),
    ],
)
def test_blocks(html, blocks):
    assert [t for _, _, t in H.blocks(html)] == blocks


def test_boilerplate_marks():
    text = "".join(f"<div class='{c}'>{c}</div>" for c in ("ad", "main-ad", "cookie-notice", "post", "added", "nav", "comments", "sidebar left", "content"))
    assert [t for _, b, t in H.blocks(text) if not b] == ["post", "added", "content"]
    assert [t for _, b, t in H.blocks("<article><header>title</header><footer>f</footer><p>p</p></article><header>top</header>") if not b] == ["title", "p"]


def test_long_and_broken_pages_end():
    assert H.extract("<div>" * 20_000 + "deep", "", frozenset()) == "deep"
    assert H.extract("<" * 50_000, "", frozenset()).startswith("<")
    assert len(H.extract("<p>" + "word " * 200_000, "", frozenset())) == 999_999
    assert H.extract("<a " + "x='" * 20_000, "", frozenset()) == ""


def test_empty(spark):
    assert H.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

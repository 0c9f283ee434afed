import random
from collections import Counter, defaultdict

from traceloom.llm import html_text as H

WORDS = "river stone walks quickly toward bright yellow market under seven trees every morning while others sleep".split()


def plain_page(rng, i):
    """A page without article elements or telling class names: (html, article)."""
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    body = [say(rng.randrange(8, 40)) for _ in range(rng.randrange(1, 6))]
    title = say(5)
    notice = "<div class='xi'><p>We sell pens</p><p>Buy two</p></div>" if i % 3 == 0 else ""
    words = "<div class='xg'>Send this page to a friend</div>"
    html = (
        f"<html><head><title>{title}</title></head><body><div class='xa'><ul>" + "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in rng.sample(WORDS, rng.randrange(3, 7))) + "</ul></div>"
        f"<div class='xb'><div class='xc'><h1>{title}</h1></div>{notice}<div class='xd'>" + "".join(f"<p>{b}</p>" for b in body) + f"{words}</div></div><div class='xe'>{say(4)}</div><div class='xf'>Printed in {i}</div></body></html>"
    )
    return html, " ".join([title, *body])


def test_articles_without_telling_names_need_the_template(spark):
    rng = random.Random(4)
    made = [plain_page(rng, i) for i in range(60)]
    rows = [(i, f"http://a.example/{i}", h) for i, (h, _) in enumerate(made)]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # the title's block is part of the text only if the slot that holds most of the text has it too
    right = sum(got[i] in (want, want.split(" ", 5)[5]) for i, (_, want) in enumerate(made))
    assert right >= 0.9 * len(made)
    assert not any("friend" in t or "pens" in t or "Printed" in t for t in got.values())
    alone = [H.extract(h, "", frozenset()) for h, _ in made]  # the ablation: no template
    assert all("friend" in t and "Printed" in t for t in alone)
    assert sum(alone[i] == got[i] for i in got) == 0


def plain_classes(pages):
    """Equivalence classes by their whole vectors."""
    seen = defaultdict(dict)
    texts = set()
    for p, (seq, sizes) in enumerate(pages):
        for t, n in Counter(seq).items():
            seen[t][p] = n
        texts |= {t for t, n in zip(seq, sizes, strict=True) if n >= 0}
    groups = defaultdict(set)
    for t, v in seen.items():
        if len(v) >= max(H.LEAST_CONSTANT if t in texts else H.LEAST_PAGES, H.SUPPORT * len(pages)):
            groups[tuple(sorted(v.items()))].add(t)
    return {frozenset(g): len(v) for v, g in groups.items() if g - texts and (len(g) >= H.LEAST_TOKENS or len(v) >= H.FRAME * len(pages))}


def test_classes_match_their_vectors(spark):
    rng = random.Random(8)
    html = [plain_page(rng, i)[0] for i in range(40)] + ["<html><body><div class='xb'>else</div></body></html>"]
    pages = spark.createDataFrame([("h", x) for x in html + html[:7]], "host string, html string")
    seqs = H.sequences(pages)
    sizes = seqs.groupBy("host").count().withColumnRenamed("count", "pages")
    assert sizes.first()["pages"] == 41
    tokens = seqs.selectExpr("host", "page", "inline(tokens)")
    found = H.classes(tokens, sizes).collect()
    want = plain_classes([(s, z) for s, _, z in map(H.page_tokens, html)])
    assert {frozenset(m["token"] for m in r.members): r.seen for r in found} == want
    assert len(want) == 3


def test_page_fit():
    fit = lambda seq, member: {c: (o != 0, g) for c, o, g in H.page_fit(seq, [-1] * len(seq), [-1] * len(seq), member, 1)[0]}
    frame = {10: 1, 11: 1, 12: 1}
    assert fit([10, 20, 21, 20, 21, 11, 12], {**frame, 20: 2, 21: 2}) == {1: (True, 0), 2: (True, 1)}
    assert fit([10, 20, 20, 21, 21, 11, 12], {**frame, 20: 2, 21: 2}) == {1: (True, 0), 2: (False, 1)}  # interleaved
    assert fit([10, 20, 11, 21, 12], {**frame, 20: 2, 21: 2}) == {1: (True, 0), 2: (True, -1)}  # across a token of the frame
    one, two = (H.page_fit(s, [-1] * 3, [-1] * 3, frame, 1)[0][0][1] for s in ([10, 11, 12], [10, 12, 11]))
    assert one != two
    seq, around, sizes = H.page_tokens("<div class='a'><p>four</p><div class='b'>nine char</div></div>")
    mass = H.page_fit(seq, around, sizes, {seq[0]: 1, seq[2]: 1, seq[1]: 1}, 1)[1]
    assert mass == [(seq[0], 9), (seq[2], 9)]


def test_text_of_the_article_stays():
    page = "<body><div class='menu'>m</div><div class='k'><div class='post-header'><h1>Title</h1></div><p>Body one</p><div class='related'>two</div><p>let <math>x</math> be</p><p>press <button>OK</button></p><div class='comments'>c</div><form>f</form></div></body>"
    slot = next(t for t, _, text, _, _ in H.events(page) if text is None and t == H._hash("<div.k", H._hash("<body")))
    assert H.extract(page, slot, frozenset()) == "Title Body one two let x be press OK"


def test_text_blocks_at_every_depth_take_linear_room():
    deep = "".join(f"<div>t{i}" for i in range(20_000))
    seq, around, sizes = H.page_tokens(deep)
    assert len(seq) == len(around) == len(sizes) == 40_000
    assert H.masses(around, sizes)[0][0] == sum(sizes[1::2])
    assert H.extract(deep + "</div>" * 20_000, "", frozenset()).startswith("t0 t1 ")


def test_moved_and_crossing_classes_are_no_template(spark):
    rng = random.Random(3)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = []
    for i in range(30):  # the two boxes stand in any order, so nothing that is in them is template
        boxes = ["<div class='qa'>first of the boxes</div>", "<div class='qb'>second of the boxes</div>"]
        rng.shuffle(boxes)
        rows.append((i, f"http://b.example/{i}", f"<body><div class='k'><p>{say(20)}</p>{boxes[0]}<p>{say(20)}</p>{boxes[1]}</div></body>" if i % 2 else f"<body><div class='k'><p>{say(40)}</p></div></body>"))
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(("first of the boxes" in got[i]) == (i % 2 == 1) for i in got)


def test_classes_inside_the_article_are_read_as_whole_names():
    say = lambda c: f"<section class='{c}'><p>{c}.</p></section>"
    kept = ["comments-policy", "share-prices", "cookie-recipes", "newsletter-history", "adverse", "notice-period", "shared"]
    gone = ["comments", "share-buttons", "notice", "cookie-notice", "post-comments", "sponsored-content", "article-share", "ad", "box ad-slot", "Comments_List", "inline-ad-2"]
    page = f"<body><article><h1>Title</h1>{''.join(map(say, kept + gone))}<p>End</p></article></body>"
    want = " ".join(["Title", *(f"{c}." for c in kept), "End"])
    assert H.extract(page, 0, frozenset()) == want
    assert H.extract("<body><article><p>a</p><div class='" + "post-" * 20_000 + "x'>b</div></article></body>", 0, frozenset()) == "a b"

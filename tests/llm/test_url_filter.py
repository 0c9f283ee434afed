import math
import random
from collections import Counter, defaultdict

import pytest

from traceloom.llm import url_filter as U

URLS = [
    None, "", "no scheme", "http://", "http://ORG", "https://A.Org/x", "http://example.org/es/1", "http://sub.example.org/en/12?x=/es/", "http://example.org/en/2#f", "ftp://notorg/es/", "http://x.com/fr/a", "http://x.com/fr",
    "http://x.com/de/", "http://x.com/DE/", "http://com/de/5", "http://x.com?/de/", "http://x.com#://y.org/z", "://a.org/b", "http://é.com/de/é?q", "http://a.net/x://y.com/de/",
    "http://big.com/de/" + "deadbeef" * 4, "http://big.com/a/b/c/d/e/f/g", "http://h.org/es/", "http://example.org/es",
]


def more():
    urls = list(URLS) * 2
    for i in range(40):
        urls += [f"https://www.h{i % 3}.com/de/{i}", f"https://www.h{i % 3}.com/en/{i}", f"http://shop.com/slug-{'abcdefghij'[i % 10] * (i % 7 + 1)}{'xyz'[i % 3]}q/", f"http://h.com/{'fr' if i % 4 else 'de'}/p{i}.html", f"http://m.com/de/{i}/x", f"http://m.com/de{i}/x"]
    urls += [f"http://bad.com/de/{i}" for i in range(80)] + ["http://bad.com/en/5", "http://bad.com/", "http://bad.com"]
    return urls


def plain_parts(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def plain_rule(host, path, rules=U.RULES):
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_shape(path):
    import re

    return [re.sub("[0-9]+", "*", re.sub("^[0-9a-fA-F-]{16,}$", "*", s)) for s in path.split("/") if s]


def plain_branches(nodes, parents):
    """Of each parent's nodes in the order of their shares, which run of neighbours that don't differ each is in."""
    band = {}
    for parent in set(parents.values()):
        order = sorted(((b + 0.5) / (l + 1.0), l, b, n) for n, (l, b) in nodes.items() if l and parents[n] == parent)
        at = 0
        for i, (share, l, b, n) in enumerate(order):
            if i:
                last, m, c, _ = order[i - 1]
                q = (b + c + 1.0) / (l + m + 2.0)
                at += share - last > 1.96 * math.sqrt(q * (1 - q) * (1 / l + 1 / m))
            band[n] = at
    return {n: band.get(n, -1) for n in nodes}


def plain_verdicts(urls, rules=U.RULES):
    pages = []
    for u in urls:
        host, path = plain_parts(u)
        pages.append([host, path, *plain_rule(host, path, rules), plain_shape(path)])
    place = {}  # (host, shape) -> prefixes
    shapes = Counter((p[0], tuple(p[4])) for p in pages)
    current = {k: [""] for k in shapes}
    deepest = max(len(p[4]) for p in pages)
    for d in range(1, deepest + 1):
        kids = defaultdict(Counter)
        for (h, s), n in shapes.items():
            if len(s) >= d:
                kids[h, current[h, s][d - 1]][s[d - 1]] += n
        vary = {k for k, c in kids.items() if sum(x != "*" for x in c) >= U.MANY and sum(c.values()) < U.SEEN * len(c)}
        for (h, s), t in current.items():
            t.append(t[d - 1] + "/" + ("*" if (h, t[d - 1]) in vary else s[d - 1]) if len(s) >= d else None)
    labelled, blocked = Counter(), Counter()
    for p in pages:
        k = (p[0], tuple(p[4]))
        labelled[k] += p[3] is not None
        blocked[k] += p[3] == "block"
    overall = (sum(blocked.values()) + 1) / (sum(labelled.values()) + 2)
    place = {k: [overall, 0] for k in shapes}
    above = {k: () for k in shapes}
    for d in range(deepest + 1):
        nodes = defaultdict(lambda: [0, 0])
        for k, t in current.items():
            if t[d] is not None:
                nodes[k[0], above[k], t[d]][0] += labelled[k]
                nodes[k[0], above[k], t[d]][1] += blocked[k]
        band = plain_branches({n: tuple(x) for n, x in nodes.items()}, {n: n[:2] for n in nodes})
        merged = defaultdict(lambda: [0, 0])
        for n, x in nodes.items():
            merged[n[0], n[1], band[n]][0] += x[0]
            merged[n[0], n[1], band[n]][1] += x[1]
        for k, t in current.items():
            if t[d] is not None:
                n = (k[0], above[k], t[d])
                lab, blk = merged[k[0], above[k], band[n]]
                place[k] = [(blk + U.WEIGHT * place[k][0]) / (lab + U.WEIGHT), lab]
                above[k] = (t[d], band[n])
    out = []
    for host, path, rule, verdict, s in pages:
        purity, own = place[host, tuple(s)]
        out.append((host, path, rule, verdict or ("block" if purity > (U.REJECT if own else U.SURE) else "allow"), round(purity, 6)))
    return out


def test_against_plain_python(spark):
    urls = more()
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, "http://x.com/de/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS shape", "3 AS n", "4 AS purity")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, pytest.approx(r.purity, abs=1e-5)) for r in U.url_verdicts(pages).collect()}
    want = plain_verdicts([u for _, u in rows])
    assert len(got) == len(rows)
    for (i, _), w in zip(rows, want):
        assert w == got[i], urls[i or 0]
    by_url = {u: w for (_, u), w in zip(rows, want)}
    assert by_url["http://bad.com/en/5"][3] == "block" and all(w[3] == "allow" for u, w in by_url.items() if u and u.startswith("http://shop.com"))


def test_deep_rules_reach_deep_paths(spark):
    rules = (("block", "deep.com", "/a/b/c/d/e/bad"), ("allow", "deep.com", "/a/b/c/d/e/good"))
    urls = [f"http://deep.com/a/b/c/d/e/{x}/{w}" for x in ("bad", "good") for w in "klmnop"] * 5
    urls += [f"http://other.com/a/b/c/d/e/{x}/k" for x in ("bad", "good")] + ["http://deep.com/" + "/".join("abcdefghijkl")]
    got = U.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()
    purity = {r.path.split("/")[6]: r.purity for r in got if r.host == "deep.com" and r.rule}
    assert purity["bad"] > 0.8 and purity["good"] < 0.2


@pytest.mark.parametrize("seed", [1, 2])
def test_deep_long_and_empty_paths_against_plain_python(spark, seed):
    """Stretches that are shared, that end inside others, and branchings far down; rules that label both sides of one."""
    rng = random.Random(seed)
    rules = (("block", "deep.com", "/a/b/c/d/e/f/bad"), ("allow", "deep.com", "/a/b/c"), ("block", "h.com", "/x/y"))
    urls = ["http://deep.com", "http://deep.com/", "http://deep.com/a//b/", "http://only.com/" + "/".join("pqrstuvw" * 8), "http://h.com/x" + "/y" * 40, None]
    for _ in range(150):
        path = "/".join(["a", "b", "c", "d", "e", "f"][: rng.choice([0, 3, 6, 6, 6])] + [rng.choice(["bad", "good", "z", f"{rng.choice('klmnopqrst')}s"]) for _ in range(rng.randrange(4))] + ["tail"] * rng.choice([0, 0, 9]))
        urls.append(f"http://{rng.choice(['deep.com', 'www.deep.com', 'other.org'])}/{path}")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, pytest.approx(r.purity, abs=2e-6)) for r in U.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    for i, w in enumerate(plain_verdicts(urls, rules)):
        assert w == got[i], urls[i]


def test_one_deep_url_costs_no_rounds(spark, monkeypatch):
    rounds = []
    stored = U.stored
    monkeypatch.setattr(U, "stored", lambda df, name: rounds.append(name) or stored(df, name))
    flat = [f"http://h.com/de/{w}/{i}" for i, w in enumerate("klmnopqrst")] * 3 + ["http://h.com/en/a"]
    deep = ["http://h.com/" + "/".join(f"{'abc'[i % 3]}x" for i in range(500))] * 2 + ["http://h.com/" + "/".join(f"{'abc'[i % 3]}x" for i in range(400)) + "/other"]
    counts = []
    for urls in (flat, flat + deep[:1], flat + deep):
        rounds.clear()
        assert U.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).count() == len(urls)
        counts.append(len(rounds))
    assert counts[0] == counts[1] == counts[2]


def test_empty(spark):
    assert U.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0

"""Main text of HTML pages by equivalence-class template deduction.

Tokens of a page are the containers that it opens, told apart by their path, and its text blocks. Over the different
pages of a host, tokens with the same vector of occurrences (how often on which page) form an equivalence class. The
vectors are never stored: XOR of hashes of (page, count) over the pages is the same exactly for equal vectors (up to
collisions of 128 bits) and is pre-aggregated before its shuffle, so a host with a third of all pages is no task of its own.

A class counts if it is large (``LEAST_TOKENS`` tokens, a container among them) and frequent (``SUPPORT`` of the pages). It is
valid if on the pages that have it its tokens stand in one order, repeated without interleaving. The class of containers
that stands once on most pages is the template's frame. Another valid class is nested in a slot of the frame, the gap
between two of its tokens, if all of its occurrences lie in that gap; classes that cross the frame are dropped. Text
tokens of the template's classes are template text, and what remains between the tokens are the slots.

The main slot is the deepest container of the template, once on its pages, that holds ``SHARE`` of the text that remains.
Its remaining text is extracted. Hosts of fewer than ``LEAST_PAGES`` different pages use the template of all pages
together. Pages that no template covers give the text of their article and main elements, or of their body.

The template can't tell readers' comments or adverts that stand in the main slot from the article: there, elements that
are none by their meaning (``BOILERPLATE``, ``ROLES``) and containers with an unmistakable class name (``INSIDE``) are left out.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import discard, in_arrow, stored
from traceloom.llm.url_filter import host_and_path

LEAST_PAGES = 3
LEAST_TOKENS = 2
SUPPORT = 0.3
#: Text on fewer pages than this is never template text: short texts come together on a few pages by chance.
LEAST_CONSTANT = 8
FRAME = 0.8
SHARE = 0.6
# Elements by what they do to text.
CONTAINERS = frozenset("html head body main article section div nav header footer aside form ul ol dl table tbody thead tfoot tr td th figure blockquote details fieldset".split())
BREAKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address hr br title figcaption caption summary legend option center".split())
RAW = frozenset("script style textarea noscript template iframe svg canvas audio video select".split())
BOILERPLATE = frozenset("head nav header footer aside form".split())
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|sidebar|side-bar|cookies?|consent|notices?|alert|menu|nav\w*|breadcrumbs?|header|masthead|footer|comments?|disqus|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|widget|pagination|pager|toolbar|copyright)(?:$|[\s_-])", re.I)
# Inside the article a class name has to say it as a whole: one such word, alone or with words of layout, and nothing that it might be about.
_SAYS = r"(?:ads?|advert\w*|sponsor\w*|comments?|disqus|replies|cookies?|consent|newsletter|share|sharing|notices?)"
_LAYOUT = r"(?:main|top|bottom|left|right|side|inline|site|page|post|article|reader|user|social|in|box|bar|block|banner|buttons?|links?|list|section|area|wrapper|wrap|container|content|thread|slot|unit|widget|form|popup|signup|text|\d+)"
INSIDE = re.compile(rf"(?<!\S)(?:{_LAYOUT}[_-])*{_SAYS}(?:[_-](?:{_SAYS}|{_LAYOUT}))*(?!\S)", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN = ("article", "main")
_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_BLANK = re.compile(r"\s+")


_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def is_boilerplate(name: str, attributes: dict[str, str], inside_main: bool) -> bool:
    """Whether a container is menu, header, footer, sidebar, notice, advert, form or comments."""
    if name in BOILERPLATE and not (name == "header" and inside_main):
        return True
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    marks = INSIDE if inside_main else MARKS
    return bool(marks.search(attributes.get("class", "")) or marks.search(attributes.get("id", ""))) and name not in ("html", "body", *MAIN)


def _hash(text: str, within: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, within & (1 << 64) - 1) - (1 << 63)


def events(page: str, main: int = 0) -> Iterator[tuple[int, int, str | None, bool, bool]]:
    """(token, place of the container around it or -1, text or None for a container, boilerplate, inside main or an article element) in page order.

    A container's token is the hash of its path of labels (element and class), a text block's the hash of its text and
    path. Characters are decoded, white space is single. Inline markup joins; block markup and line breaks part. Broken
    markup is read as far as it goes: an end tag closes the nearest open container of its name, and what stays open ends
    with the page. Time and memory are linear in the page's length, however deep it nests.
    """
    stack: list[tuple[str, int, int, bool, bool]] = [("", 0, -1, False, False)]  # element, path, place, boilerplate and main here or above
    opened: Counter[str] = Counter()
    held: list[str] = []
    at, end, place = 0, len(page), 0

    def flush():
        text = _BLANK.sub(" ", html.unescape("".join(held))).strip() if held else ""
        held.clear()
        return text

    while at < end:
        m = _PIECE.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            if m[0][0] != "<" or m[0] == "<":
                held.append(m[0])
            continue
        name = name.lower()
        if name in BREAKS and (text := flush()):
            _, path, around, boilerplate, inside = stack[-1]
            yield _hash(text, path), around, text, boilerplate, inside
            place += 1
        if m[1]:
            if opened[name]:
                while (last := stack.pop()[0]) != name:
                    opened[last] -= 1
                opened[name] -= 1
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                close = _CLOSE[name].search(page, at)
                at = close.end() if close else end
            held.append(" ")
            continue
        if name in CONTAINERS:
            attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
            _, path, around, above, inside = stack[-1]
            label = name + ("." + _BLANK.sub(".", re.sub(r"\d+", "", attributes["class"]).strip()) if attributes.get("class") else "")
            path = _hash("<" + label, path)
            inside = inside or path == main or name in MAIN
            opened[name] += 1
            stack.append((name, path, place, path != main and (above or is_boilerplate(name, attributes, inside)), inside))
            yield path, around, None, stack[-1][3], inside
            place += 1
    if text := flush():
        _, path, around, boilerplate, inside = stack[-1]
        yield _hash(text, path), around, text, boilerplate, inside


def blocks(page: str) -> Iterator[tuple[int, bool, str]]:
    """(token, boilerplate, text) of each text block in page order."""
    for token, _, text, boilerplate, _ in events(page):
        if text is not None:
            yield token, boilerplate, text


def page_tokens(page: str) -> tuple[list[int], list[int], list[int]]:
    """A page's tokens in order, the place of the container around each (-1: none), and what it adds to the text that may be main.

    The last is -1 for a container, the text's length for a text, and 0 for text of boilerplate.
    """
    found = [(token, around, -1 if text is None else 0 if boilerplate else len(text)) for token, around, text, boilerplate, _ in events(page)]
    return tuple(map(list, zip(*found, strict=True))) if found else ([], [], [])


def masses(around: list[int], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The text in each token, and its depth."""
    mass = np.maximum(np.array(sizes, np.int64), 0)
    depth = np.zeros(len(around), np.int64)
    for i, a in enumerate(around):
        depth[i] = depth[a] + 1 if a >= 0 else 0
    for i in range(len(around) - 1, -1, -1):
        if around[i] >= 0:
            mass[around[i]] += mass[i]
    return mass, depth


def sequences(pages: DataFrame) -> DataFrame:
    """(host, page, seq, around, sizes, tokens array<struct>): the tokens of each different page of a host, and its different tokens with their counts.

    Copies of a page say nothing about what varies: each different text of a host counts once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [page_tokens(p or "") for p in b.column(1).to_pylist()]
            each = []
            for seq, around, sizes in rows:
                mass, depth = masses(around, sizes)
                last = {t: i for i, t in enumerate(seq)}
                counts = Counter(seq)
                each.append([{"token": t, "n": counts[t], "is_text": sizes[i] >= 0, "depth": int(depth[i]), "mass": int(mass[i])} for t, i in last.items()])
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *columns, pa.array(each, _TOKENS)], names=["host", "page", "seq", "around", "sizes", "tokens"])

    schema = "host string, page long, seq array<long>, around array<int>, sizes array<int>, tokens array<struct<token: long, n: int, is_text: boolean, depth: int, mass: long>>"
    return pages.select("host", "html", F.xxhash64("html").alias("page")).transform(in_arrow, run, schema).dropDuplicates(["host", "page"])


_TOKENS = pa.list_(pa.struct([("token", pa.int64()), ("n", pa.int32()), ("is_text", pa.bool_()), ("depth", pa.int32()), ("mass", pa.int64())]))


def classes(tokens: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, pages, frame, class, seen, once, members): the large and frequent equivalence classes of each host.

    tokens: (host, page, token, n, is_text, depth). class: a long that tells a host's classes apart. frame: the frame's class,
    null if the host has none. once: its tokens stand at most once on a page. members: (token, is_text, depth).
    """
    vector = [F.bit_xor(F.xxhash64("page", "n")).alias("v1"), F.bit_xor(F.xxhash64(F.lit(1), "n", "page")).alias("v2")]
    each = tokens.groupBy("host", "token").agg(F.max("is_text").alias("is_text"), F.max("depth").alias("depth"), F.count("*").alias("seen"), F.max("n").alias("most"), *vector)
    least = F.greatest(F.when(F.col("is_text"), LEAST_CONSTANT).otherwise(LEAST_PAGES), SUPPORT * F.col("pages"))
    each = each.join(sizes, "host").where(F.col("seen") >= least)
    found = each.groupBy("host", "v1", "v2").agg(
        F.max("pages").alias("pages"), F.max("seen").alias("seen"), (F.max("most") == 1).alias("once"), F.count_if(~F.col("is_text")).alias("containers"), F.collect_list(F.struct("token", "is_text", "depth")).alias("members")
    )
    found = found.where((F.col("containers") > 0) & ((F.size("members") >= LEAST_TOKENS) | (F.col("seen") >= FRAME * F.col("pages"))))
    found = found.select("host", "pages", F.xxhash64("v1", "v2").alias("class"), "seen", "once", "containers", "members")
    frames = found.where(F.col("once") & (F.col("seen") >= FRAME * F.col("pages"))).groupBy("host").agg(F.max(F.struct("seen", "containers", "class"))["class"].alias("frame"))
    return found.join(frames, "host").drop("containers")


def page_fit(seq: list[int], around: list[int], sizes: list[int], member: dict[int, int], frame: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(class, order, gap) of each class on a page, and (token, mass) of each container of a class that the page has once.

    order: hash of the class's tokens in their order, 0 if they interleave. gap: the only slot of the frame that the class
    is in, -1 if there are several; the frame itself is in slot 0. mass: the text in it that is of no class.
    """
    places: dict[int, list[int]] = {}
    for i, t in enumerate(seq):
        if t in member:
            places.setdefault(member[t], []).append(i)
    of_frame = places.get(frame, [])
    fits = []
    for c, at in places.items():
        s = [seq[i] for i in at]
        k = len(set(s))
        order = xxhash.xxh64_intdigest(np.array(s[:k]).tobytes()) >> 1 | 1 if s == s[:k] * (len(s) // k) else 0
        gaps = {bisect(of_frame, i) for i in at} if c != frame else {0}
        fits.append((c, order, gaps.pop() if len(gaps) == 1 else -1))
    mass, _ = masses(around, [0 if t in member else n for t, n in zip(seq, sizes, strict=True)])
    counts = Counter(seq)
    return fits, [(t, int(mass[i])) for i, t in enumerate(seq) if sizes[i] < 0 and t in member and counts[t] == 1]


def deduce(pages: DataFrame) -> DataFrame:
    """(host, main, constant array<long>): each host's main slot (0: none) and template text; host null for all pages together.

    pages: (host, html). Hosts without a template have no row. Constant text stands on many of the host's pages, so the
    array is no larger than a few of its pages.
    """
    seqs = stored(sequences(pages), "html-sequences")
    sizes = stored(seqs.groupBy("host").agg(F.count("*").alias("pages")), "html-sizes")
    tokens = seqs.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.*")
    found = stored(classes(tokens, sizes.where(F.col("pages") >= LEAST_PAGES)), "html-classes")
    each = found.groupBy("host", "frame").agg(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct(m["token"].alias("token"), F.col("class").alias("class"))))).alias("members"))
    joined = seqs.join(each.withColumnRenamed("host", "of_host"), F.col("host") == F.col("of_host")).select("host", "frame", "members", "seq", "around", "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = {}
        for b in batches:
            rows: list[tuple] = []
            for i in range(b.num_rows):
                host = b.column(0)[i].as_py()
                if host not in held:
                    if len(held) > 1_000:
                        held.clear()
                    held[host] = {m["token"]: m["class"] for m in b.column(2)[i].as_py()}
                fits, mass = page_fit(*(b.column(j)[i].as_py() for j in (3, 4, 5)), held[host], b.column(1)[i].as_py())
                rows += [(host, c, None, order, gap, 1) for c, order, gap in fits] + [(host, None, t, None, None, m) for t, m in mass]
            names = ["host", "class", "token", "order", "gap", "n"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i else pa.string()) for i in range(6)], names=names)

    told = joined.transform(in_arrow, run, "host string, class long, token long, order long, gap long, n long").groupBy("host", "class", "token", "order", "gap").agg(F.sum("n").alias("n"))
    told = stored(told, "html-fits")
    # valid: most of its pages show one order in one slot of the frame
    best = told.where("class IS NOT NULL AND order <> 0 AND gap >= 0").groupBy("host", "class").agg(F.max("n").alias("n"))
    valid = found.join(best, ["host", "class"]).where(F.col("n") >= FRAME * F.col("seen"))
    member = valid.select("host", "once", F.explode("members").alias("m")).select("host", "once", "m.*")
    containers = member.where("once AND NOT is_text").join(told.where("token IS NOT NULL").select("host", "token", F.col("n").alias("mass")), ["host", "token"])
    total = containers.groupBy("host").agg(F.max("mass").alias("total"))
    main = containers.join(total, "host").where((F.col("mass") > 0) & (F.col("mass") >= SHARE * F.col("total"))).groupBy("host").agg(F.max(F.struct("depth", "mass", "token"))["token"].alias("main"))
    constant = member.groupBy("host").agg(F.collect_list(F.when(F.col("is_text"), F.col("token"))).alias("constant"))
    own = constant.join(main, "host", "left").select("host", F.coalesce("main", F.lit(0)).alias("main"), "constant")
    # of all pages together only the containers are asked for: few tokens, however many pages
    n = seqs.count()
    every = tokens.where("NOT is_text").groupBy("token").agg(F.max("depth").alias("depth"), F.count("*").alias("seen"), F.max("n").alias("most"), F.sum("mass").alias("mass"))
    every = stored(every.where((F.col("seen") >= FRAME * n) & (F.col("most") == 1) & (F.col("mass") > 0) & (F.col("depth") > 1)), "html-every")
    most = F.col("mass") >= SHARE * F.lit((every.agg(F.max("mass")).first() or [0])[0] or 0)
    whole = every.where(most).agg(F.max(F.struct("depth", "mass", "token"))["token"].alias("main"))
    whole = whole.select(F.lit(None).cast("string").alias("host"), F.coalesce("main", F.lit(0)).alias("main"), F.array().cast("array<bigint>").alias("constant"))
    templates = stored(own.unionByName(whole), "html-templates")
    discard(seqs, sizes, found, told, every)
    return templates


def extract(page: str | None, main: int | str, constant: frozenset[int], main_all: int = 0) -> str:
    """Main text of a page: what the main slot holds besides template text and boilerplate.

    main and main_all: slots of the host's template and of that of all pages, tried in turn. A page that has neither gives
    the text of its article and main elements, or of its body.
    """
    if not page:
        return ""
    for slot in dict.fromkeys((main, main_all)):
        if slot:
            found = list(_inside(page, slot))
            if found:
                own = [text for token, text in found if token not in constant]
                return " ".join(own or [text for _, text in found])  # a host whose pages all have one text has it as its main text
    parts = [(inside, text) for _, _, text, boilerplate, inside in events(page) if text is not None and not boilerplate]
    return " ".join([text for inside, text in parts if inside] or [text for _, text in parts])


def _inside(page: str, slot: int) -> Iterator[tuple[int, str]]:
    """(token, text) of the blocks in a slot, outside of boilerplate."""
    held: list[bool] = []  # by place, whether it is in the slot
    for token, around, text, boilerplate, _ in events(page, slot):
        held.append(around >= 0 and held[around] or text is None and token == slot)
        if text is not None and held[-1] and not boilerplate:
            yield token, text


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages.

    Null, empty and textless pages give an empty text. A null URL, or one without ://, is of the empty host. Repeated
    rows give the same text each and count once for the template. Only page_id, url and html of pages are read.
    """
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host.alias("host"))
    found = deduce(rows.select("host", "html"))
    main_all = found.where("host IS NULL").first()["main"]
    own = found.where("host IS NOT NULL").select(F.col("host").alias("template_host"), "main", "constant")
    joined = rows.join(own, F.col("host") == F.col("template_host"), "left").select("page_id", "url", "html", "main", "constant")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, constant = None, frozenset()
        for b in batches:
            texts = []
            for h, m, c in zip(b.column(2), b.column(3), b.column(4), strict=True):
                if c != last:  # pages of one host often stand together
                    last, constant = c, frozenset(c.as_py() or ())
                texts.append(extract(h.as_py(), m.as_py() or 0, constant, main_all))
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(lengths)], names=["page_id", "url", "text", "n_chars"])

    return joined.transform(in_arrow, run, f"page_id {kind}, url string, text string, n_chars long")

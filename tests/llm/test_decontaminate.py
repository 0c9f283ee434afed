import random
import re
import unicodedata

import pytest

from traceloom.llm import decontaminate as D

WORDS = "the of and river stone walks quickly toward bright yellow market under seven trees every morning with his old brown dog before anyone else wakes near quiet harbour lights".split()


def plain_words(text):

    def mark(t):  # a capital and small letters after another word; twice, as the matches can't overlap
        out, at = [], 0
        pattern = re.compile(r"[^\W_][,;:]? ")
        while m := pattern.search(t, at):
            end = m.end()
            word = end
            if word < len(t) and unicodedata.category(t[word]) == "Lu":
                word += 1
                while word < len(t) and unicodedata.category(t[word]) == "Ll":
                    word += 1
            if word > end + 1:
                out += [t[at:end], D.MARK, t[end:word]]
                at = word
            else:
                out.append(t[at : m.start() + 1])
                at = m.start() + 1
        return "".join(out) + t[at:]

    t = mark(mark(text))
    return re.sub(r"[\W_]+", " ", t).strip(" ").lower().split(" ")


def plain_template(raw, names=True):
    out = []
    for w in raw:
        if w.startswith(D.MARK) and names:
            out.append("<name>")
            continue
        w = re.sub(r"\d+", "#", w.replace(D.MARK, ""))
        out.append("<unit>" if out and out[-1] == "#" and w in D.UNITS else w)
    return out


def plain_leaks(text, items, window=8, matches=6, literals=4):
    raw = plain_words(text or "")
    tokens = plain_template(raw)
    here = {}
    for i in range(len(tokens) - window + 1):
        here.setdefault(tuple(tokens[i : i + window]), []).append(i)
    found = {}
    for item, t in items:
        r = plain_words(t)
        n = len(r) - window + 1
        hits = {}
        for kind in (True, False):
            c = plain_template(r, kind)
            for j in range(n):
                w = tuple(c[j : j + window])
                slots = [x if "#" in y or "<" in y else "" for x, y in zip(r[j : j + window], w)]
                if sum(x == "" for x in slots) < literals:
                    continue
                for i in here.get(w, []):
                    hits.setdefault(i - j, {})[j] = (slots, [x if "#" in y or "<" in y else "" for x, y in zip(raw[i : i + window], w)])
        for places in hits.values():
            values = {}
            for a, b in places.values():
                for x, y in zip(a, b):
                    if x:
                        values.setdefault(x, set()).add(y)
            if len(places) >= min(matches, n) and all(len(v) == 1 for v in values.values()):
                found[item] = max(found.get(item, 0), len(places))
    return found


def cases():
    rng = random.Random(7)
    sentence = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, sentence(rng.randrange(6, 40))) for i in range(12)]
    items += [(50, "A train leaves with 40 km to go and then 40 km more while Alice waves at Bob Smith near the old gate of town"), (51, "Seven words are not enough here"), (52, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15")]
    docs = [sentence(60) for _ in range(20)]
    for _, t in items[:13]:
        docs.append(sentence(10) + ". " + t + " " + sentence(8))
        docs.append(sentence(5) + " " + t.upper() + "!! " + sentence(5))
        docs.append(" ".join(t.split()[: rng.randrange(4, 20)]) + " " + sentence(20))
        docs.append("*** ".join(t.split()))
    changed = items[12][1]
    docs += [changed.replace("40", "75"), changed.replace("40", "75", 1), changed.replace("40 km", "9 miles").replace("Alice", "Zoë"), changed.replace("Alice", "Carol").replace("Bob", "Dan"), "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15", None, "", "   ", "x", items[0][1] + " " + items[1][1]]
    return items, docs


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 3])
def test_against_plain_python(spark, broadcast_rows):
    items, docs = cases()
    rows = [(i, t) for i, t in enumerate(docs)] + [(3, docs[3]), (None, docs[21])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS h", "3 AS row_key", "4 AS pos", "5 AS leaking_row_key", "map('k', 1) AS `odd name`")
    bench = spark.createDataFrame([*items, (99, None), (None, docs[0])], "item_id long, text string")
    got = sorted((str(r.doc_id), r.contaminated, r.item_id, r.n_items, r.n_matched) for r in D.contamination(df, bench, broadcast_rows=broadcast_rows).collect())
    want = []
    for d, t in rows:
        found = plain_leaks(t, items)
        least = min(found, default=None)
        want.append((str(d), bool(found), least, len(found), found.get(least, 0)))
    assert got == sorted(want)
    assert sum(w[1] for w in want) > 30
    kept = D.drop_leaks(df, bench, broadcast_rows=broadcast_rows)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(w[0] for w in want if not w[1])


def test_reparameterised_questions(spark):
    item = "A train leaves with 40 km to go and then 40 km more while Alice waves at Bob Smith near the old gate of town"
    docs = [item.replace("40", "75"), item.replace("40", "75", 1), item.replace("Alice", "Carol").replace("Bob", "Dan").replace("40 km", "3 miles")]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r.contaminated for r in D.contamination(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[0] and got[2]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.contamination(docs, none).collect()] == [False]
    assert D.contamination(docs.limit(0), none).count() == 0 and D.drop_leaks(docs, none).count() == 1

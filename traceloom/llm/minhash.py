"""Near-duplicate groups by Jaccard similarity of word shingles: MinHash bands, sequential Bayesian pruning, exact checks on full sets.

Documents with equal shingle sets are one *class*, told by a 128-bit hash of the set; everything below is about classes.
Two classes are candidates if all hashes of one of their signatures' bands agree. A candidate pair's signatures are compared some
hashes at a time: after n hashes with m agreements the posterior of the similarity (uniform prior) is Beta(m + 1, n - m + 1), and
a pair whose probability to reach the threshold is below ``miss`` is dropped. What survives all hashes is verified on full sets.

Candidates of a bucket are not all paired up:

1. Stars: each class with its bucket's centre, the class with the most copies. Survivors that a class agrees with most are verified
   first, and of the rest only pairs that the links so far leave apart.
2. Rest: a bucket whose members are one component by now is done. In the others pairs of different components remain: in buckets of
   up to CROWD members as rows; a larger one is cut to blocks of members against blocks of those outside its main component, full
   sets beside them, and a block returns only links that join components: fewer than it has members.

So no bucket of any size loses a pair: what the miss probability of bands and of pruning says is all that is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import discard, in_arrow, stored
from traceloom.llm.simhash import components

SHINGLE = 3
#: Documents are linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
ROWS = 6
BANDS = 30
HASHES = ROWS * BANDS
#: Hashes that a step of the sequential comparison looks at.
STEP = 30
#: A pair with a smaller probability to reach the threshold is dropped. The bands miss a pair at the threshold with 7 in 10 million.
MISS = 1e-6
#: Members of a bucket from which its pairs are compared in blocks, and members of a block.
CROWD = 64
BLOCK = 1024
#: Shingles of a block's members, about: long texts make smaller blocks.
BLOCK_SHINGLES = 2_000_000

_rng = np.random.default_rng(20)
_XOR = _rng.integers(0, 1 << 64, HASHES, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of a UTF-8 text's distinct shingles: ASCII lower case, words between ASCII white space.

    >>> len(shingle_set(None)), len(shingle_set(b"One two")), len(shingle_set(b"a b c A b c"))
    (0, 1, 3)
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    found = set(zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else {tuple(words)}
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, found)), np.uint64, len(found)))


def signature(hashes: np.ndarray) -> bytes:
    """HASHES minima over a set, 16 bits of each."""
    least = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[at : at + 1024, None] ^ _XOR) * _ODD).min(axis=0), out=least)
    # the minima of large sets are small numbers: a second mix spreads them over the bits that are kept
    return ((least * _ODD) >> np.uint64(48)).astype("<u2").tobytes()


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text)."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.unhex(F.md5(text)).alias("text_hash"), text.alias("text"))


def classes_of(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, text_hash, node, n, sig), one row per row of docs: the text's hash, its set's hash (null: no words), size and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for b in batches:
            nodes, sizes, sigs = [], [], []
            for t in b.column(2).cast(pa.large_binary()):
                hashes = shingle_set(t.as_py(), shingle)
                node = xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None
                if node is not None and node not in known:
                    if len(known) > 4096:
                        known.clear()
                    known[node] = signature(hashes)
                nodes.append(node)
                sizes.append(len(hashes))
                sigs.append(known.get(node))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "text_hash", "node", "n", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed(docs).transform(in_arrow, run, f"doc_id {kind}, text_hash binary, node binary, n long, sig binary")


@cache
def least_agreements(percent: int, miss: float) -> tuple[tuple[int, int], ...]:
    """(n, m): with fewer than m agreements among the first n hashes a pair's similarity reaches the threshold with probability below miss.

    The Beta posterior's tail is a binomial sum: P(S >= t) = P(Bin(n + 1, t) <= m).
    """
    t = percent / 100
    found = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        found.append((n, m))
    return tuple(found)


def surviving(a: np.ndarray, b: np.ndarray, percent: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, agreements) of the pairs a[i], b[i] of signatures that no step of the comparison drops."""
    alive, agree, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in least_agreements(percent, miss):
        agree = agree + (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        alive, agree, done = alive[agree >= m], agree[agree >= m], n
    return alive, agree


def matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """The rows of a column of binaries of one length, as a matrix of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def pruned(pairs: DataFrame, sigs: DataFrame, percent: int, miss: float) -> DataFrame:
    """(a, b, agree): the pairs (a, b) that the sequential comparison of signatures keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, agree = surviving(matrix(b.column(2), HASHES, "<u2"), matrix(b.column(3), HASHES, "<u2"), percent, miss)
            kept = b.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(agree)], names=["a", "b", "agree"])

    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    return both.select("a", "b", "sa", "sb").transform(in_arrow, run, "a binary, b binary, agree long")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold, in whole numbers."""
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs that are links, by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = b.column(2).to_pylist(), b.column(3).to_pylist()
            kept = [i for i, (x, y) in enumerate(zip(xs, ys, strict=True)) if similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)]
            yield b.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("xb")), "b")
    return both.select("a", "b", "xa", "xb").transform(in_arrow, run, "a binary, b binary")


def block_links(block: pa.Table, percent: int, miss: float) -> pa.Table:
    """(a, b) of one block: links of its outsiders with its members that join different components, none of them twice."""
    side = block["side"].to_numpy()
    members, outsiders = block.filter(pa.array(side == 0)), block.filter(pa.array(side == 1))
    names = members["node"].to_pylist()
    labels = np.array(members["label"].to_pylist() + outsiders["label"].to_pylist(), object)
    _, comp = np.unique(labels, return_inverse=True)
    root = list(range(int(comp.max(initial=0)) + 1))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links: list[tuple[bytes, bytes]] = []
    if not names or not outsiders.num_rows:
        return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
    of_member, of_outsider = comp[: len(names)], comp[len(names) :]
    sigs = matrix(members["sig"], HASHES, "<u2")
    sets = [np.frombuffer(x, np.uint64) for x in members["hashes"].to_pylist()]
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    hashes, place = np.unique(np.concatenate(sets), return_inverse=True)
    for node, own, sig, raw in zip(outsiders["node"].to_pylist(), of_outsider.tolist(), matrix(outsiders["sig"], HASHES, "<u2"), outsiders["hashes"].to_pylist(), strict=True):
        x = np.frombuffer(raw, np.uint64)
        roots = np.array([find(i) for i in range(len(root))])
        fits = (100 * np.minimum(sizes, len(x)) >= percent * np.maximum(sizes, len(x))) & (roots[of_member] != roots[own])
        some = np.flatnonzero(fits)
        some = some[surviving(sigs[some], np.broadcast_to(sig, (len(some), HASHES)), percent, miss)[0]]
        if not len(some):
            continue
        common = np.add.reduceat(np.isin(hashes, x, assume_unique=True)[place], starts, dtype=np.int64)[some]
        for i in some[100 * common >= percent * (sizes[some] + len(x) - common)].tolist():
            p, q = find(own), find(int(of_member[i]))
            if p != q:
                root[p] = q
                links.append((node, names[i]))
    return pa.table({"a": pa.array([p[0] for p in links], pa.binary()), "b": pa.array([p[1] for p in links], pa.binary())})


def crowd_links(rows: DataFrame, sigs: DataFrame, sets: DataFrame, percent: int, miss: float) -> DataFrame:
    """(a, b): links between components inside crowded buckets. rows: (key, node, label, n).

    A bucket's main component is the one with most members. Members are dealt to blocks by their hash, outsiders too; each
    pair of blocks is a group of at most some 2 * BLOCK rows, whatever the bucket's size.
    """
    per_label = rows.groupBy("key", "label").agg(F.count("*").alias("has"), F.sum("n").alias("shingles"))
    main = per_label.groupBy("key").agg(F.max(F.struct("has", "label", "shingles")).alias("x"), F.sum("has").alias("size"), F.sum("shingles").alias("shingles"))
    blocks = lambda size, shingles: F.expr(f"1 + greatest(({size}) div {BLOCK}, ({shingles}) div {BLOCK_SHINGLES})")
    main = main.select("key", F.col("x.label").alias("main"), blocks("size", "shingles").alias("blocks"), blocks("size - x.has", "shingles - x.shingles").alias("outer"))
    known = rows.select("key", "node", "label").join(main, "key")
    place = F.xxhash64("node", F.lit("block"))
    own, outer = F.pmod(place, "blocks"), F.pmod(place, "outer")
    count = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    members = known.select("key", "node", "label", F.lit(0).alias("side"), own.alias("i"), F.explode(count("outer")).alias("j"))
    outsiders = known.where(F.col("label") != F.col("main")).select("key", "node", "label", F.lit(1).alias("side"), F.explode(count("blocks")).alias("i"), outer.alias("j"))
    full = members.unionAll(outsiders).join(sigs.select("node", "sig"), "node").join(sets, "node")

    def run(block: pa.Table) -> pa.Table:
        return block_links(block, percent, miss)

    return full.groupBy("key", "i", "j").applyInArrow(run, "a binary, b binary")


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the component of each of nodes; a node without edges is its own."""
    if edges.isEmpty():
        return nodes.select("node", F.col("node").alias("label"))
    roots = components(edges).select(F.col("node").alias("at"), "root")
    return stored(nodes.join(roots, F.col("node") == F.col("at"), "left").select("node", F.coalesce("root", "node").alias("label")), "minhash-labels")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) whose ends have different labels."""
    both = pairs.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    return both.where(F.col("la") != F.col("lb")).select(*pairs.columns)


def linked_classes(rows: DataFrame, docs: DataFrame, shingle: int, percent: int, miss: float) -> DataFrame:
    """(node, label) of the classes that have candidates. rows: classes_of(docs), stored."""
    sigs = stored(rows.where("node IS NOT NULL").groupBy("node").agg(F.first("sig").alias("sig"), F.first("n").alias("n"), F.count("*").alias("copies")), "minhash-classes")
    band = F.xxhash64(F.col("b"), F.substring("sig", F.col("b") * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    banded = sigs.select("node", "n", "copies", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("b")).select("node", "n", "copies", band.alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(banded.join(shared, "key"), "minhash-members")
    nodes = stored(members.select("node").distinct(), "minhash-candidates")
    # full sets of the candidates alone, each from the text of one row
    wanted = rows.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("x")).join(nodes, "node", "left_semi")
    sets = stored(full_sets(docs, wanted.select("node", F.col("x.doc_id").alias("of_id"), F.col("x.text_hash").alias("of_hash")), shingle), "minhash-sets")
    centre = members.groupBy("key").agg(F.max(F.struct("copies", "node")).alias("x")).select("key", F.col("x.node").alias("centre"))
    stars = members.join(centre, "key").where("node <> centre")
    stars = stars.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    pending = stored(pruned(stars, sigs, percent, miss), "minhash-stars")
    ends = pending.selectExpr("a", "b", "agree", "a AS end").unionAll(pending.selectExpr("a", "b", "agree", "b AS end"))
    best = ends.groupBy("end").agg(F.max(F.struct("agree", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    links = stored(verified(best, sets, percent), "minhash-links")
    labels = labelled(nodes, links)
    links = stored(links.unionAll(verified(apart(pending, labels), sets, percent)), "minhash-links")
    labels = labelled(nodes, links)
    # pairs of a bucket that no star has
    known = members.join(labels, "node").select("key", "node", "n", "label", "size")
    mixed = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    left = stored(known.join(mixed, "key", "left_semi"), "minhash-rest")
    few = left.where(F.col("size") <= CROWD)
    a, b = few.selectExpr("key", "node AS a", "label AS la"), few.selectExpr("key", "node AS b", "label AS lb")
    pairs = a.join(b, "key").where("a < b AND la <> lb").select("a", "b").distinct().join(pending.select("a", "b"), ["a", "b"], "left_anti")
    more = verified(pruned(pairs, sigs, percent, miss), sets, percent)
    crowded = crowd_links(left.where(F.col("size") > CROWD), sigs, sets, percent, miss)
    links = stored(links.unionAll(more).unionAll(crowded), "minhash-links")
    labels = labelled(nodes, links)
    discard(members, sets, left, pending)
    return labels


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(node, hashes): the full sets of the texts of the rows that wanted (node, of_id, of_hash) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in b.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "hashes"])

    rows = keyed(docs)
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["of_id"]) & (rows["text_hash"] == wanted["of_hash"]))
    once = texts.groupBy("node").agg(F.first("text").alias("text"))
    return once.transform(in_arrow, run, "node binary, hashes binary")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of docs.

    Documents are linked if the Jaccard similarity of their sets of distinct word shingles is percent / 100 or more;
    component_id is the smallest doc_id reachable. A text of fewer words is one shingle. Texts without words, null ones too, have
    no shingles and are linked with nothing. Repeated rows are separate rows of one group. A null doc_id takes part but is a
    component_id only where all of the group are null, and is kept there. An empty table gives no rows. Other columns of docs are
    not read, so their names can't clash.
    """
    hashed = classes_of(docs, shingle)
    rows = stored(hashed, "minhash-rows")
    labels = linked_classes(rows, docs, shingle, percent, miss)
    least = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    member = stored(least.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")), "minhash-least")
    named = member.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = member.select("node", "label").join(named, "label").select("node", "component_id")
    found = rows.select("doc_id", "n", "node").join(of_node, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def near_duplicate_sql(percent: int = PERCENT) -> str:
    """The same rows in DuckDB's SQL, from all pairs that share a shingle."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT id, doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d
),
x AS (SELECT id, len(s) AS n, unnest(s) AS h FROM s),
shared AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS total, count(*) AS common FROM x a JOIN x b ON a.h = b.h AND a.id <> b.id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * common >= {percent} * (total - common)),
reach AS (SELECT id AS a, id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT r.a AS id, min(s.doc_id) AS component_id FROM reach r JOIN s ON s.id = r.b GROUP BY ALL)
SELECT s.doc_id, len(s.s) AS n_shingles, component_id, s.doc_id IS NOT DISTINCT FROM component_id AS kept FROM s JOIN least USING (id)
"""

"""Audit of how sources differ in their words: exact integer divergences between the term distributions of a language's sources.

Texts are tokenized as bytes, a part of a table at a time: a lookup table over the part's UTF-8 buffer marks the bytes of
terms, the places where the mark changes are the boundaries, xxHash groups the slices between them, and every slice is
compared, byte by byte, with the first of its group. A part's documents and terms are a sparse matrix (CSR) whose rows are
summed to groups by reduceat, so that what leaves a task is one row for each group and term.

Counts are aggregated by Spark. Divergences are then summed in blocks: a block has all groups' counts of the terms
that share a hash bucket, as a sparse matrix, so a language with most of the text is many blocks. A block returns one partial
sum for each pair of sources and the best terms of each group; both are put together by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import in_arrow, stored

LEAST_DOCS = 3
TOP_TERMS = 200
SCALE = 10**9
#: Cells (counts of a term in a group) of a block, about.
BLOCK_CELLS = 1_000_000

_BYTES = np.arange(256, dtype=np.uint8)
IN_TERM = (_BYTES >= 0x80) | ((_BYTES | 0x20) >= ord("a")) & ((_BYTES | 0x20) <= ord("z"))
LOWERED = np.where((_BYTES >= ord("A")) & (_BYTES <= ord("Z")), _BYTES | 0x20, _BYTES).astype(np.uint8)


def term_slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the terms of concatenated texts; text i is data[offsets[i]:offsets[i + 1]], and no term crosses texts."""
    inside = IN_TERM[data]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edges] |= inside[edges]
    last[edges - 1] |= inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def grouped_slices(text: bytes, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): the group of each slice of text, and the first slice of each group. Slices of a group have equal bytes.

    Grouped by hash; slices whose bytes differ from those of their group's first one, as only a collision can, are grouped by their bytes.
    """
    hashes = np.fromiter((digest(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    _, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    data, lengths = np.frombuffer(text, np.uint8), ends - starts
    wrong = [np.flatnonzero(lengths != lengths[first[ids]])]
    for at in range(0, len(starts), 1 << 16):
        some = np.arange(at, min(at + (1 << 16), len(starts)))
        some = some[lengths[some] == lengths[first[ids[some]]]]
        n = lengths[some]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = data[np.repeat(starts[some], n) + within] != data[np.repeat(starts[first[ids[some]]], n) + within]
        wrong.append(np.unique(np.repeat(some, n)[differ]))
    wrong = np.concatenate(wrong)
    if len(wrong):
        own: dict[bytes, int] = {}
        more = []
        for i in np.sort(wrong).tolist():
            term = text[starts[i] : ends[i]]
            if term not in own:
                own[term] = len(first) + len(more)
                more.append(i)
            ids[i] = own[term]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return ids, first


def summed_rows(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of each key's values, and how many there are."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1)) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(values[order], at) if len(at) else np.zeros(0, np.int64)
    return keys[at], sums, np.diff(at, append=len(keys))


def part_counts(langs: list[str], sources: list[str], texts: pa.Array) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of some documents: occurrences, and documents that have the term."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    starts, ends = term_slices(data, offsets)
    text = LOWERED[data].tobytes()
    ids, first = grouped_slices(text, starts, ends)
    doc = np.searchsorted(offsets, starts, "right") - 1
    width = max(1, len(first))
    cells, n, _ = summed_rows(doc * width + ids, np.ones(len(ids), np.int64))  # CSR: documents by terms
    names: dict[tuple[str, str], int] = {}
    group = np.fromiter((names.setdefault(x, len(names)) for x in zip(langs, sources, strict=True)), np.int64, len(langs))
    keys, n, docs = summed_rows(group[cells // width] * width + cells % width, n)
    terms = [text[starts[i] : ends[i]].decode() for i in first.tolist()]
    pairs, which = list(names), pa.array(keys // width)
    return pa.RecordBatch.from_arrays(
        [pa.array([p[0] for p in pairs], pa.string()).take(which), pa.array([p[1] for p in pairs], pa.string()).take(which), pa.array(terms, pa.string()).take(pa.array(keys % width)), pa.array(n), pa.array(docs)],
        names=["lang", "source", "term", "n", "docs"],
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all rows of docs; each row counts as a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield part_counts(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))

    some = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counted = some.transform(in_arrow, run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """floor(SCALE * count / total) for count <= total < 9.2e15, exactly: long division, three digits at a time."""
    whole, rest = count // total, count % total
    for _ in range(3):
        rest = rest * 1000
        whole, rest = whole * 1000 + rest // total, rest % total
    return whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); p and q are at most SCALE + 1, so the square fits 64 bits."""
    return (p - q) ** 2 // q


def pair_sums(row: np.ndarray, col: np.ndarray, p: np.ndarray, zero: np.ndarray, terms: int) -> np.ndarray:
    """sums[s, o]: divergence of group s from group o over a block's terms. Cells are sorted by row; where a group has no cell its p is zero[s].

    Only cells are visited: of terms that s has, the terms' own divergences stand in for those that a group without cells would have.
    """
    size = len(zero)
    has, at = np.unique(row, return_index=True)
    sums = np.zeros((size, size), np.int64)
    for o in range(size):
        lo, hi = np.searchsorted(row, [o, o + 1])
        other = np.full(terms, zero[o], np.int64)
        other[col[lo:hi]] = p[lo:hi]
        some = 1 + (1 << 22) // max(1, hi - lo)  # of the groups at once, to bound the memory
        for a in range(0, size, some):
            z = zero[a : a + some]
            sums[a : a + some, o] = divergence(z[:, None], p[None, lo:hi]).sum(1) + (terms - (hi - lo)) * divergence(z, zero[o])
        if len(row):
            sums[has, o] += np.add.reduceat(divergence(p, other[col]) - divergence(zero[row], other[col]), at)
    return sums


def block_results(cells: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """(lang, source, part, item, value): a block's partial sums of pairs, and the top terms of each group."""
    lang = groups["lang"][0].as_py()
    sources = groups["source"].to_pylist()
    n_group, n_lang, v = (groups[c].to_numpy() for c in ("n_group", "n_lang", "v"))
    zero = 1 + scaled(np.ones(len(sources), np.int64), n_group + np.maximum(v, 1))
    names = sorted(cells["term"].unique().to_pylist(), key=str.encode)
    place, index = {s: i for i, s in enumerate(sources)}, {t: i for i, t in enumerate(names)}
    row = np.fromiter((place[s] for s in cells["source"].to_pylist()), np.int64, cells.num_rows)
    col = np.fromiter((index[t] for t in cells["term"].to_pylist()), np.int64, cells.num_rows)
    order = np.lexsort((col, row))
    row, col, n, total = row[order], col[order], cells["n"].to_numpy()[order], cells["total"].to_numpy()[order]
    p = 1 + scaled(n + 1, (n_group + v)[row])
    sums = pair_sums(row, col, p, zero, len(names))
    s, o = np.nonzero(~np.eye(len(sources), dtype=bool))
    q = 1 + scaled(total + 1, (n_lang + v)[row])
    f = divergence(p, q)
    above = np.flatnonzero(p > q)
    above = above[np.lexsort((col[above], -f[above], row[above]))]
    rank = np.arange(len(above)) - np.searchsorted(row[above], row[above])
    above = above[rank < top]
    held = pa.array(sources, pa.string())
    items = pa.concat_arrays([held.take(pa.array(o)), pa.array(names, pa.string()).take(pa.array(col[above]))])
    part = pa.concat_arrays([pa.array(["pair"] * len(s), pa.string()), pa.array(["term"] * len(above), pa.string())])
    source = held.take(pa.array(np.concatenate([s, row[above]])))
    return pa.table([pa.array([lang] * len(items), pa.string()), source, part, items, pa.array(np.concatenate([sums[s, o], f[above]]))], names=["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for all groups (lang, source) of docs.

    Terms are runs of ASCII letters and of characters beyond ASCII, in ASCII lower case; a language keeps those in at least
    least_docs of its documents. A term's p in a group is 1 + floor(10^9 (count + 1) / (N + V)). Part "pair": every other
    source of the language and the group's divergence from it over all kept terms, all ranks. Part "term": terms that the group
    has more often than its language, ranks to top. Ties go to the smaller item in UTF-8.

    Null lang, source and text are ''; a group without terms, and one of a language that keeps none, has its pairs (value 0 in
    the latter); a lang with one source has no pairs; rows that repeat are documents of their own; an empty table gives no rows.
    Other columns of docs are not read, so their names can't clash.
    """
    counts = stored(term_counts(docs), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs)
    cells = stored(counts.select("lang", "source", "term", "n").join(kept.select("lang", "term", "total"), ["lang", "term"]), "divergence-cells")
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    by_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    by_lang = cells.groupBy("lang", "term").agg(F.first("total").alias("total")).groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("v"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_group", "n_lang", "v")]
    known = stored(groups.join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", *filled), "divergence-groups")
    blocks = 1 + cells.count() // BLOCK_CELLS
    dealt = cells.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    all_groups = known.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return block_results(left, right, top)

    schema = "lang string, source string, part string, item string, value long"
    found = dealt.groupBy("lang", "block").cogroup(all_groups.groupBy("lang", "block")).applyInArrow(run, schema)
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return summed.withColumn("rank", F.row_number().over(order).cast("int")).where((F.col("part") == "pair") | (F.col("rank") <= top))


def divergence_sql(least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> str:
    """The same rows in DuckDB's SQL."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
occ AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM occ GROUP BY ALL HAVING count(DISTINCT id) >= {least_docs}),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY ALL),
cnt AS (SELECT lang, source, term, count(*) AS n FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS n FROM cnt GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.n, 0) + l.v) AS p,
    1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""

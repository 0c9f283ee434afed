"""Phrases whose words stand together more often than alone: counts of all n-grams by sorted suffixes, scored and thinned exactly.

Each occurrence of a word starts a suffix: it and the words after it in its piece, at most max_n. A task counts the equal
suffixes of its texts first. They are shuffled by language and first word, dealt further by the second one, since a frequent
first word has most suffixes; sorted in reverse lexicographic order, every prefix of a suffix is either on a stack that one pass
keeps or new, and a prefix that leaves the stack has its whole count. One-word counts are summed over the parts of their word.
What is frequent enough is small, and joins put the parts of each phrase beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traceloom.llm.common import in_arrow, stored

MAX_WORDS = 3
LEAST = 10
COVER = 50
TOP = 2000
#: A language's candidates are ranked in so many parts first.
DEALT = 64

#: ASCII capitals to small letters, tabs to blanks, all that ends a piece to line feeds.
_MAP = bytes(ord("\n") if chr(c) in ".,;:!?\n\v\f\r" else ord(" ") if c == 9 else c | 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(rb"[^ \n]+|\n")
_EDGE = re.compile(rb"[ \n]")
#: Bytes of texts whose equal suffixes a task counts together; more only where a single text is longer.
GATHERED = 32 << 20
#: Bytes of a text that are split into words at once.
CHUNK = 1 << 20


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in order, with a line feed wherever a piece ends; some at a time."""
    text, at = text.translate(_MAP), 0
    while at < len(text):
        edge = _EDGE.search(text, at + CHUNK)
        end = edge.start() if edge else len(text)
        yield _TOKEN.findall(text[at:end])
        at = end


def distinct_rows(columns: list[np.ndarray], base: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of columns of ids below base, and how often each occurs."""
    key, high = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        if high > (1 << 62) // base:  # too many values for one number: ranks of the rows so far take their place
            _, key = np.unique(key, return_inverse=True)
            high = int(key.max(initial=0)) + 1
        key, high = key * base + c, high * base
    _, first, n = np.unique(key, return_index=True, return_counts=True)
    return [c[first] for c in columns], n


def suffix_counts(texts: Iterable[bytes], max_n: int) -> tuple[pa.Array, pa.Array]:
    """(suffixes, counts) of some texts. Every word of a suffix has a blank after it, so equal starts in bytes are equal words."""
    known = {b"\n": 0}
    ids = [np.zeros(1, np.int32)]
    for text in texts:
        for some in tokens(text):
            ids.append(np.array([known.setdefault(w, len(known)) for w in some], np.int32))
        ids.append(np.zeros(1, np.int32))
    row = np.concatenate(ids + [np.zeros(max_n, np.int32)])
    at = np.flatnonzero(row)
    columns = [row[at].astype(np.int64)]
    for i in range(1, max_n):
        columns.append(np.where(columns[-1] > 0, row[at + i], 0))
    columns, n = distinct_rows(columns, len(known))
    words = pa.array([b"", *[w + b" " for w in known][1:]], pa.binary())
    return pc.binary_join_element_wise(*[words.take(pa.array(c)) for c in columns], b"").cast(pa.string()), pa.array(n, pa.int64())


def suffixes(docs: DataFrame, max_n: int) -> DataFrame:
    """(lang, suffix, n): counted suffixes of parts of docs; a suffix may stand in several rows."""

    def counted(texts: dict[str, list[bytes]]) -> Iterator[pa.RecordBatch]:
        for lang, own in texts.items():
            found, n = suffix_counts(own, max_n)
            for at in range(0, len(found), 1 << 16):
                some = found[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(some)), some, n[at : at + (1 << 16)]], names=["lang", "suffix", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        size = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            size += b.nbytes
            if size >= GATHERED:
                yield from counted(texts)
                texts, size = {}, 0
        yield from counted(texts)

    some = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return some.transform(in_arrow, run, "lang string, suffix string, n long")


_OUT = ["lang", "phrase", "words", "n"]


class Prefixes:
    """Counts the prefixes of rows (lang, suffix, n) that come in reverse lexicographic order of their suffixes.

    The open prefixes are those of the last row: a stack, deepest last, with the count of each by language so far. A batch is put
    behind the last row; a prefix that its next row doesn't have is whole and leaves the stack.
    """

    def __init__(self, least: int, max_n: int):
        self.least = least
        self.last: str | None = None
        self.stack: list[dict[str, int]] = [{} for _ in range(max_n)]

    def add(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """The prefixes that are whole by the end of the batch; those of more words only if frequent, of one word all: other parts have more of them."""
        langs, suffixes, n = batch.columns
        # the last row again, once for each language that has open prefixes, with their counts
        open_langs = list(self.stack[0])
        held = len(open_langs)
        langs = pa.concat_arrays([pa.array(open_langs, pa.string()), langs]).dictionary_encode()
        rows = pa.concat_arrays([pa.array([self.last] * held, pa.string()), suffixes]).cast(pa.large_binary())
        if not len(rows):
            return self.rows([])
        code, names = langs.indices.to_numpy().astype(np.int64), langs.dictionary
        offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
        text = rows.buffers()[2].to_pybytes()
        data = np.frombuffer(text, np.uint8)
        blanks = offsets[0] + np.flatnonzero(data[offsets[0] : offsets[-1]] == 32)
        first = np.searchsorted(blanks, offsets[:-1])
        depth = np.diff(first, append=len(blanks))
        # bytes that a row has in common with the one before
        both = np.minimum(np.diff(offsets)[1:], np.diff(offsets)[:-1])
        begin = np.cumsum(both) - both
        within = np.arange(both.sum()) - np.repeat(begin, both)
        differ = data[np.repeat(offsets[1:-1], both) + within] != data[np.repeat(offsets[:-2], both) + within]
        common = np.minimum.reduceat(np.where(differ, within, np.repeat(both, both)), begin) if len(both) else both
        common = np.concatenate([[0], common])
        found = []
        for k, waiting in enumerate(self.stack):
            has = np.flatnonzero(depth > k)
            counts = np.concatenate([np.array([waiting.get(x, 0) for x in open_langs], np.int64), n.to_numpy()])[has]
            waiting.clear()
            if not len(has):
                continue
            end = blanks[first[has] + k] + 1
            group = np.cumsum(end - offsets[has] > common[has])
            key = group * len(names) + code[has]
            order = np.argsort(key, kind="stable")
            starts = np.flatnonzero(np.diff(key[order], prepend=-1))
            sums, at = np.add.reduceat(counts[order], starts), order[starts]
            whole = sums > 0
            if depth[-1] > k:  # the last row's prefix may go on
                goes_on = group[at] == group[-1]
                waiting.update((names[int(code[has[i]])].as_py(), int(x)) for i, x in zip(at[goes_on], sums[goes_on], strict=True) if x)
                whole &= ~goes_on
            if k:
                whole &= sums >= self.least
            at = at[whole]
            phrases = [text[a:b] for a, b in zip(offsets[has[at]].tolist(), (end[at] - 1).tolist(), strict=True)]
            found.append((names.take(pa.array(code[has[at]])), pa.array(phrases, pa.binary()).cast(pa.string()), k + 1, sums[whole]))
        self.last = rows[-1].as_py().decode()
        return self.rows(found)

    def close(self) -> pa.RecordBatch:
        """What is left on the stack."""
        words = (self.last or "").split(" ")[:-1]
        left = [(lang, k, n) for k, waiting in enumerate(self.stack[: len(words)], 1) for lang, n in waiting.items() if k == 1 or n >= self.least]
        return self.rows([(pa.array([lang], pa.string()), pa.array([" ".join(words[:k])], pa.string()), k, np.array([n])) for lang, k, n in left])

    @staticmethod
    def rows(found: list[tuple[pa.Array, pa.Array, int, np.ndarray]]) -> pa.RecordBatch:
        columns = [[pa.array([], t)] for t in (pa.string(), pa.string(), pa.int32(), pa.int64())]
        for lang, phrase, k, n in found:
            for c, x in zip(columns, (lang, phrase, pa.array(np.full(len(n), k, np.int32)), pa.array(n, pa.int64())), strict=True):
                c.append(x)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=_OUT)


def phrase_counts(docs: DataFrame, max_n: int = MAX_WORDS, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n): all words, and all phrases of up to max_n words that occur at least least times."""
    # by language and first word, a frequent one further by the second
    dealt = suffixes(docs, max_n).repartition("lang", F.substring_index("suffix", " ", 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefixes = Prefixes(least, max_n)
        for b in batches:
            yield prefixes.add(b)
        yield prefixes.close()

    # by suffix first: its first bytes tell most rows apart
    counted = dealt.sortWithinPartitions(F.desc("suffix"), F.desc("lang")).transform(in_arrow, run, "lang string, phrase string, words int, n long")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))


#: floor(1000000 a a / (l r)), exactly: a decimal of 38 digits holds the products of counts below 10^15.
SCORE = "(CAST(1000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))) div (CAST(l AS DECIMAL(15, 0)) * CAST(r AS DECIMAL(15, 0)))"


def collocations(docs: DataFrame, max_n: int = MAX_WORDS, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first top phrases by score, then by count, then in UTF-8 order.

    Texts are in ASCII lower case, cut to pieces at .,;:!? and line ends, words are parted by blanks and tabs. Candidates are
    phrases of 2 to max_n words with a >= least occurrences; one is cut where floor(10^6 a^2 / (l r)) is least, at the first such
    place. A candidate inside a longer one with at least cover percent of its occurrences is dropped.

    A null or empty text has no words, a null lang is und, rows that repeat count again, an empty table gives no rows. Other
    columns of docs are not read, so their names can't clash. Counts below 10^15 are exact.
    """
    counts = stored(phrase_counts(docs, max_n, least), "collocation-counts")
    sizes = counts.where("words = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = stored(counts.where(F.col("n") >= least), "collocation-frequent")
    phrases = frequent.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"))
    parts = frequent.select("lang", F.col("phrase").alias("part"), F.col("n").alias("of_part"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.selectExpr("lang", "phrase", "words", "a", "k", "substring_index(phrase, ' ', k) AS first", "substring_index(phrase, ' ', k - words) AS rest")
    left = parts.select("lang", F.col("part").alias("first"), F.col("of_part").alias("l"))
    right = parts.select("lang", F.col("part").alias("rest"), F.col("of_part").alias("r"))
    cut = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", F.expr(SCORE))
    lowest = cut.groupBy("lang", "phrase", "words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x"))
    scored = lowest.select("lang", "phrase", "words", "x.a", "x.l", "x.r", "x.score")
    # the longest that holds a phrase: every run of 2 words or more inside a candidate, with the candidate's count
    inner = "flatten(transform(sequence(2, words - 1), n -> transform(sequence(1, words - n + 1), i -> array_join(slice(split(phrase, ' '), i, n), ' '))))"
    held = phrases.where("words > 2").select("lang", F.explode(F.expr(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left_over = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's phrases are ranked in parts first, so that no task sorts all of them
    in_part = left_over.withColumn("part_rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(DEALT))).orderBy(*order)))
    ranked = in_part.where(F.col("part_rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocation_sql(least: int = LEAST, cover: int = COVER, top: int = TOP) -> str:
    """The same rows in DuckDB's SQL, for phrases of two and three words."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase, k FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, phrase, k, count(*) AS n FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY ALL),
cand AS (SELECT lang, phrase, k AS words, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= {least}),
cuts AS (SELECT lang, phrase, words, a, w, unnest(range(1, words)) AS c FROM cand),
scored AS (
  SELECT x.lang, x.phrase, x.words, x.a, x.c, p.n AS l, q.n AS r, (1000000::HUGEINT * x.a * x.a) // (p.n::HUGEINT * q.n) AS score
  FROM cuts x JOIN f p ON p.lang = x.lang AND p.phrase = array_to_string(x.w[:x.c], ' ') JOIN f q ON q.lang = x.lang AND q.phrase = array_to_string(x.w[x.c + 1:], ' ')
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inner_ AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM cand WHERE words = 3),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
  FROM lowest LEFT JOIN longer USING (lang, phrase) WHERE most IS NULL OR 100 * most < {cover} * a
)
SELECT lang, rank, phrase, a, l, r, sizes.n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN sizes USING (lang) WHERE rank <= {top}
"""

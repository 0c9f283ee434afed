"""Secret scans with DataFrame operations only: base patterns, and spans that Markov models find.

Base spans are matches of three fixed patterns. The method adds long tokens that look drawn at random: two
first-order character models, one of random strings and one of ordinary identifiers, give a token's log-likelihood
ratio. The models are bigram counts over labelled samples (a table of at most two times 68 x 68 rows, whatever the
corpus), gathered once and put into the scan as a constant array. Every token of the alphabet with 16 characters or more is
judged by the ratio per character; one that a base span holds whole is left to that span, and a UUID names a thing and
is no secret.

Labelled samples: random strings are digests of consecutive numbers in base 16, 64 and upper case; identifiers are
words of a bounded sample of documents (``sample_docs``, in the order of their ids' hash), alone and joined in the ways
identifiers are, with digits, acronyms, paths and codes, decimal numbers of many digits, which name things too, and runs:
one character over and over, rows of keys, the alphabet. The scan itself covers every whole text.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.llm.common import let

SAMPLE_DOCS = 2000
RANDOM_STRINGS = 4000
#: The least log-likelihood ratio for each step from a character to the next: a sum alone would grow with the length of any name.
MIN_RATE = 1.0
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
# Fixed patterns of the base kinds, and how many characters of which group a match needs.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: What names a thing by its form, however random: UUIDs.
NAMED = r"^(?i:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12})$"
# Rows of keys, letters and digits.
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0123456789")
#: How many bigrams of a character it takes until its own counts weigh as much as those of all characters.
BACKOFF = 20.0
KINDS = ("assign", "access", "hex", "markov")


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """array<bigint>: of each element of values, 0 and the elements before it taken together by op.

    Spark copies an array that grows in a fold, so the fold goes over some square root of n pieces and then over each
    piece: n elements take about n ** 1.5 steps.
    """
    start = lambda at: F.struct(at.cast("bigint").alias("at"), F.expr("cast(array() AS array<bigint>)").alias("out"))
    step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    fold = lambda piece, at: F.aggregate(piece, start(at), step, lambda acc: acc["out"])

    def pieced(v: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(v))).cast("int")
        pieces = F.transform(F.sequence(F.lit(1), F.size(v), size), lambda i: F.slice(v, i, size))
        return let(pieces, lambda p: F.flatten(F.zip_with(p, fold(F.transform(p, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), op)), F.lit(0)), fold)))

    return let(values, lambda v: F.when(F.size(v) > 0, pieced(v)).otherwise(F.expr("cast(array() AS array<bigint>)")))


def spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<s, e, v>>: start and end in code points of the leftmost non-overlapping matches whose group has least characters, with the match.

    What stands between the matches, and the matches, give the places by their lengths' running sum.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    length = lambda a: F.transform(a, F.length)
    parts = let(found, lambda f: F.arrays_zip(F.slice(length(between), F.lit(1), F.size(f)).alias("b"), f.alias("v"), (length(sizes) if group else length(f)).alias("n")))

    def placed(p: Column) -> Column:
        ends = running(F.transform(p, lambda x: (x["b"] + F.length(x["v"])).cast("bigint")), lambda a, b: a + b)
        each = F.zip_with(p, ends, lambda x, at: F.struct((at + x["b"]).cast("int").alias("s"), (at + x["b"] + F.length(x["v"])).cast("int").alias("e"), x["v"].alias("v"), x["n"].alias("n")))
        return F.transform(F.filter(each, lambda x: x["n"] >= least), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v")))

    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(F.expr("cast(array() AS array<struct<s:int,e:int,v:string>>)"))


def labelled_samples(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, random_strings: int = RANDOM_STRINGS) -> DataFrame:
    """(text, random): random strings (1) and ordinary identifiers (0)."""
    spark = docs.sparkSession
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 256)
    coded = F.base64(F.unhex(digest))
    drawn = spark.range(random_strings).select(F.explode(F.array(digest, coded, F.upper(F.regexp_replace(coded, "[^A-Za-z0-9]", "")))).alias("text"))
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    words = F.regexp_extract_all(F.col("text"), F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,}(?![A-Za-z0-9+/_=-])"), F.lit(0))
    pairs = texts.select(words.alias("w")).where(F.size("w") > 1).select(F.explode(F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))).alias("p"))
    a, b = F.col("p.a"), F.col("p.b")
    low_a, low_b, up_a, up_b = F.lower(a), F.lower(b), F.upper(a), F.upper(b)
    digits = lambda n, seed: F.lpad(F.pmod(F.xxhash64(a, b, F.lit(seed)), F.lit(10**n)).cast("string"), n, "0")
    names = [a, up_a, F.concat_ws("_", low_a, low_b), F.concat_ws("-", low_a, low_b), F.concat(low_a, F.initcap(b)), F.concat_ws("_", low_a, digits(2, 1)), F.concat_ws("/", low_a, low_b)]
    names += [F.concat_ws("_", up_a, up_b), F.concat(F.initcap(a), digits(2, 2), F.initcap(b)), F.concat(F.substring(up_a, 1, 4), F.initcap(b)), F.concat(F.initcap(a), F.initcap(b)), F.concat(low_a, digits(3, 10), low_b), F.concat(F.lit("/"), low_a, F.lit("/"), low_b, digits(1, 3), F.lit("/"))]
    names += [F.concat_ws("-", F.substring(up_a, 1, 3), digits(4, 4), digits(4, 5), F.substring(up_b, 1, 3), digits(2, 6)), F.concat_ws("-", low_a, digits(4, 7), digits(2, 8))]
    runs = [*(c * 20 for c in ALPHABET), *ROWS, *(r.upper() for r in ROWS)]
    names.append(F.get(F.array(*map(F.lit, runs)), F.pmod(F.xxhash64(a, b, F.lit(0)), F.lit(len(runs))).cast("int")))
    numbers = spark.range(random_strings).select(F.conv(F.substring(digest, 1, 15), 16, 10).alias("text"))
    ordinary = pairs.select(F.explode(F.array(*names)).alias("text")).unionAll(numbers)
    return drawn.select("text", F.lit(1).alias("random")).unionAll(ordinary.select("text", F.lit(0).alias("random")))


def markov_ratio(samples: DataFrame) -> list[float]:
    """log P(b | a) of random strings less that of identifiers, at place a * SIZE + b; a character outside ALPHABET is 0.

    samples: (text, random). A character's own counts are mixed with those of all characters, which count as BACKOFF
    bigrams, so a character that the samples lack tells little. No samples at all give ratios of zero.
    """
    letters = F.filter(F.split("text", ""), lambda c: c != "")
    both = samples.where(F.length("text") > 1).select("random", letters.alias("c")).select("random", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))).alias("p"))
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    counts = both.groupBy("random", place(F.col("p.a")).alias("a"), place(F.col("p.b")).alias("b")).count()
    n = [[[0.0] * SIZE for _ in range(SIZE)] for _ in range(2)]
    for r in counts.collect():  # at most 2 * SIZE * SIZE rows
        n[r["random"]][r["a"]][r["b"]] += r["count"]

    def share(side: list[list[float]], a: int, b: int) -> float:
        return (side[a][b] + BACKOFF * any_[id(side)][b]) / (sums[id(side)][a] + BACKOFF)

    sums = {id(side): [sum(row) for row in side] for side in n}
    any_ = {id(side): [(sum(row[b] for row in side) + 1) / (sum(sums[id(side)]) + SIZE) for b in range(SIZE)] for side in n}
    return [math.log(share(n[1], a, b)) - math.log(share(n[0], a, b)) for a in range(SIZE) for b in range(SIZE)]


def log_ratio(token: Column, ratio: list[float]) -> Column:
    """The log-likelihood ratio of a token's characters, each after the one before it."""
    table = F.expr("cast(split('" + ",".join(f"{x:.6f}" for x in ratio) + "', ',') AS array<double>)")  # folded to one constant
    place = lambda c: F.instr(F.lit(ALPHABET), c)
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    steps = F.transform(F.array(letters), lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.get(table, place(a) * SIZE + place(b))))[0]
    return F.aggregate(steps, F.lit(0.0), lambda s, x: s + x)


def secret_spans(docs: DataFrame, ratio: list[float], min_rate: float = MIN_RATE) -> DataFrame:
    """(doc_id, found array<struct<s, kind, e, v>>) in the order of start and kind; one row per row of docs.

    kind is the place in KINDS. Null and empty texts have no spans; a null doc_id is scanned like any other; repeated
    rows are scanned each. A token of the models may overlap base spans; one that a base span holds whole is left to that
    span. Texts of any length and with any number of matches are scanned whole. Only doc_id and text of docs are read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    cut = docs.select("doc_id", spans(text, ASSIGN, 2, 6).alias("assign"), spans(text, ACCESS).alias("access"), spans(text, HEX).alias("hex"), spans(text, TOKEN).alias("tokens"))
    named = lambda kind: F.transform(KINDS[kind], lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e"), x["v"].alias("v")))
    likely = F.filter("tokens", lambda x: (log_ratio(x["v"], ratio) >= min_rate * (F.length(x["v"]) - 1)) & ~x["v"].rlike(NAMED))
    cut = cut.select("doc_id", F.array_sort(F.concat(*(named(i) for i in range(3)))).alias("base"), F.when(F.size("tokens") > 0, likely).otherwise(F.col("tokens")).alias("markov"))
    cut = cut.select("doc_id", "base", F.when(F.size("markov") > 0, F.array_sort(F.concat("base", named(3)))).alias("both"))

    def free(all_: Column) -> Column:
        reach = running(F.transform(all_, lambda x: F.when(x["kind"] < 3, x["e"]).otherwise(0).cast("bigint")), lambda a, b: F.greatest(a, b))
        kept = F.filter(F.arrays_zip(all_.alias("x"), reach.alias("reach")), lambda p: (p["x"]["kind"] < 3) | (p["x"]["e"] > p["reach"]))
        return F.transform(kept, lambda p: p["x"])

    return cut.select("doc_id", F.when(F.col("both").isNull(), F.col("base")).otherwise(let(F.col("both"), free)).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_digests(docs: DataFrame, ratio: list[float], min_rate: float = MIN_RATE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) of secret_spans()."""
    found = secret_spans(docs, ratio, min_rate)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint")
    base = F.filter("found", lambda x: x["kind"] < 3)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count(3).alias("n_markov"))


def scan(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """Fit the models on docs' samples and scan docs."""
    return secret_digests(docs, markov_ratio(labelled_samples(docs, **options)))

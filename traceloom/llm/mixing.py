"""Mixing sources to target weights by Poisson replication, with DataFrame operations only.

A source with n documents and target share w gets the mean repetition rate w * target / n. Each document draws its
count from a Poisson distribution with that mean: a uniform number from the MD5 of (seed, doc_id) is looked up in the
source's cumulative probabilities. Documents are exploded by their counts and dealt out by a hash of (seed, doc_id, copy),
so any partition of the result is a random mixture. Counts depend on nothing but seed, id, sizes and weights: a task
that runs again draws the same.

Only counts per source are gathered. The table of rates is broadcast if there are at most ``BROADCAST_SOURCES`` of them
(counted first, about a hundred numbers each); beyond, the join back to the documents is an ordinary equi-join in which
adaptive execution splits the partition of a hot source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.llm.common import let

#: Poisson rates above this are drawn as sums of independent draws, as exp(-rate) would underflow.
STEP = 500.0
BROADCAST_SOURCES = 20_000


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float], other: float = 1.0, epochs: float = 1.0) -> DataFrame:
    """(mix_source, draws, cdf): for each source, how many draws a document makes and P(X <= k) of each draw."""
    sizes = docs.groupBy(F.col("source").cast("string").alias("mix_source")).agg(F.count("*").alias("n"))
    given = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair]) if weights else None
    weight = F.coalesce(given[F.col("mix_source")], F.lit(float(other))) if weights else F.lit(float(other))
    sums = sizes.withColumn("weight", weight).groupBy().agg(F.sum("weight").alias("weights"), F.sum("n").alias("total"), F.count("*").alias("sources"))
    all_weights, total, sources = sums.first()
    if not total or not all_weights:
        return sizes.select("mix_source", F.lit(1).alias("draws"), F.array(F.lit(1.0)).alias("cdf"))
    # the sums run over doubles in an order that may vary, so they are rounded to what doubles hold surely
    goal = F.lit(float(epochs) * float(total) / round(float(all_weights), 9))
    rate = sizes.select("mix_source", (goal * weight / F.col("n")).alias("rate"))
    rate = rate.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP).cast("int"))).withColumn("step", F.col("rate") / F.col("draws"))
    cdf = F.expr("""
        aggregate(
            sequence(1, cast(ceil(step + 12 * sqrt(step) + 20) AS int)),
            named_struct('p', exp(-step), 'c', exp(-step), 'cdf', array(exp(-step))),
            (s, k) -> named_struct('p', s.p * step / k, 'c', s.c + s.p * step / k, 'cdf', array_append(s.cdf, s.c + s.p * step / k)),
            s -> s.cdf)
    """)
    table = rate.select("mix_source", "draws", cdf.alias("cdf"))
    return F.broadcast(table) if sources <= BROADCAST_SOURCES else table


def _mixed(docs: DataFrame, weights: dict[str, float], other: float, epochs: float, seed: int) -> DataFrame:
    """(row, copy, mix_at): docs' rows as structs, so that no name of theirs can clash with those used here."""
    table = rates(docs, weights, other, epochs)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("mix_id"), F.col("source").cast("string").alias("mix_key"))
    rows = rows.join(table, F.col("mix_key").eqNullSafe(F.col("mix_source")))
    draw = lambda j: let(uniform(seed, F.col("mix_id"), j), lambda u: F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    first = F.col("draws") == 1
    count = F.when(first, draw(F.lit(1))).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda n, j: n + draw(j)))
    rows = rows.withColumn("mix_n", count).where("mix_n > 0")
    rows = rows.select("row", "mix_id", F.explode(F.sequence(F.lit(1), F.col("mix_n"))).alias("copy"))
    rows = rows.select("row", "copy", F.xxhash64(F.lit(seed), F.col("mix_id"), F.col("copy")).alias("mix_at"))
    return rows.repartition(F.col("mix_at")).sortWithinPartitions("mix_at")


def poisson_mix(docs: DataFrame, weights: dict[str, float], other: float = 1.0, epochs: float = 1.0, seed: int = 11) -> DataFrame:
    """docs with each row repeated by its Poisson count, and the columns copy (1, 2, ...) and mix_at (place of the shuffle).

    weights: target share of each source, in any unit; sources that it doesn't name have the share other, a null source
    too. A share of zero removes a source. epochs: size of the result as a multiple of the rows. Rows that repeat a
    doc_id repeat its count; a null id draws as 'null'. Texts play no part. Empty docs give no rows. Columns of docs that
    are called copy or mix_at give way to the new ones; mixed_rows() keeps them.
    """
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("copy", "mix_at")]
    return _mixed(docs, weights, other, epochs, seed).select(*own, "copy", "mix_at")


def mixed_rows(docs: DataFrame, weights: dict[str, float], other: float = 1.0, epochs: float = 1.0, seed: int = 11) -> DataFrame:
    """poisson_mix() with the columns of docs alone."""
    return _mixed(docs, weights, other, epochs, seed).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mixing_sql(weights: dict[str, float], other: float = 1.0, epochs: float = 1.0, seed: int = 11, docs: str = "documents", columns: str = "doc_id, source, lang, n_chars, text") -> str:
    """DuckDB SQL for poisson_mix, for rates up to STEP."""
    weight = "CASE source " + " ".join(f"WHEN '{s}' THEN {float(w)!r}" for s, w in sorted(weights.items())) + f" ELSE {float(other)!r} END" if weights else repr(float(other))
    return f"""
    WITH RECURSIVE sized AS (SELECT source, count(*) AS n, ({weight})::DOUBLE AS w FROM {docs} GROUP BY source),
    goal AS (SELECT {float(epochs)!r}::DOUBLE * sum(n)::DOUBLE / round(sum(w), 9) AS g FROM sized),
    rate AS (SELECT source, g * w / n::DOUBLE AS step FROM sized, goal),
    cdf AS (
        SELECT source, step, 0 AS k, exp(-step) AS p, exp(-step) AS c FROM rate
        UNION ALL
        SELECT source, step, k + 1, p * step / (k + 1), c + p * step / (k + 1) FROM cdf WHERE k < ceil(step + 12 * sqrt(step) + 20)
    ),
    steps AS (SELECT source, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
    drawn AS (
        SELECT d.*, len(list_filter(s.cdf, lambda c: c <= ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) AS mix_n
        FROM {docs} d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source
    )
    SELECT {columns}, unnest(range(1, mix_n + 1))::INTEGER AS copy FROM drawn WHERE mix_n > 0
    """

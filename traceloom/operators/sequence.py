"""Ordered operators on event tables: change detection, run collapse, caps, value sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traceloom.functions import patterns as P


def traced(events: DataFrame) -> DataFrame:
    """Events of variables that are traced: no dunder names, inputs, functions or modules (column kind, if there is one)."""
    kept = ~F.startswith("var", F.lit("__")) & ~F.col("var").isin(*P.UNTRACED_NAMES)
    if "kind" in events.columns:
        kept = kept & ~F.coalesce(F.col("kind").isin("callable", "module"), F.lit(False))
    return events.where(kept)


def changes(events: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Events whose value differs from the one before in the same keys; the first always counts, a NaN always differs.

    Values are compared as given (a rendered text for programs' values): null equals null.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(value).over(w)
    differs = (F.row_number().over(w) == 1) | ~F.col(value).eqNullSafe(before)
    if dict(events.dtypes)[value] in ("double", "float"):
        differs = differs | F.isnan(value)
    elif dict(events.dtypes)[value] == "string":
        differs = differs | F.coalesce(F.col(value) == "nan", F.lit(False))
    return events.withColumn("_new", differs).where("_new").drop("_new")


def deltas(events: DataFrame, keys: list[str], order: str, var: str = "var", value: str = "value") -> DataFrame:
    """Per step the map of variables that changed in their frame: keys, order and changes."""
    new = changes(events, [*keys, var], order, value)
    return new.groupBy(*keys, order).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(var, value)))).alias("changes"))


def block_steps(events: DataFrame, keys: list[str], order: str, block: str, max_events: int | None = None) -> DataFrame:
    """The heads of runs of the same block, numbered in path_no; null blocks are skipped, events beyond max_events too."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = events
    if max_events is not None:
        rows = rows.withColumn("_no", F.row_number().over(w)).where(F.col("_no") <= max_events).drop("_no")
    heads = changes(rows.where(F.col(block).isNotNull()), keys, order, block)
    return heads.withColumn("path_no", F.row_number().over(w))


def capped(steps: DataFrame, keys: list[str], block: str, cap: int = P.MOST_BLOCKS, mark: str = P.TRUNCATED) -> DataFrame:
    """The first cap steps, and one step that says so where there were more."""
    more = steps.where(F.col("path_no") == cap + 1)
    others = [F.lit(None).cast(t).alias(c) for c, t in steps.dtypes if c not in (*keys, block, "path_no")]
    marks = more.select(*keys, F.lit(mark).alias(block), "path_no", *others)
    return steps.where(F.col("path_no") <= cap).unionByName(marks)


def value_steps(steps: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of the kept block steps those whose value differs from the one before."""
    return changes(steps.withColumn("_text", F.coalesce(F.col(value).cast("string"), F.lit("None"))), keys, "path_no", "_text").drop("_text")


def collected(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """keys and the values as an array, in order."""
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias(out))


def block_traces(events: DataFrame, keys: list[str], order: str, block: str, value: str, cap: int = P.MOST_BLOCKS, max_events: int | None = P.MOST_LINE_EVENTS) -> DataFrame:
    """keys, block_sequence (capped), values and paired of an event table, from one pass over the kept steps."""
    w = Window.partitionBy(*keys).orderBy("path_no")
    steps = block_steps(events, keys, order, block, max_events)
    steps = steps.withColumn("_text", F.coalesce(F.col(value).cast("string"), F.lit("None")))
    new = (F.row_number().over(w) == 1) | (F.col("_text") != F.lag("_text").over(w))
    steps = steps.withColumn("_new", new).where(F.col("path_no") <= cap + 1)
    kept = F.col("path_no") <= cap
    ordered = lambda cond, v: F.array_sort(F.collect_list(F.when(cond, F.struct("path_no", v))))
    out = steps.groupBy(*keys).agg(
        F.transform(ordered(F.lit(True), F.when(kept, F.col(block)).otherwise(P.TRUNCATED).alias("v")), lambda x: x["v"]).alias("block_sequence"),
        F.transform(ordered(kept & F.col("_new"), F.col("_text").alias("v")), lambda x: x["v"]).alias("values"),
        F.transform(ordered(kept, F.struct(F.col(block).alias("block"), F.col("_text").alias("value")).alias("v")), lambda x: x["v"]).alias("paired"),
    )
    return out


def line_blocks(events: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Events with the block of their line; unmapped events go. lines: keys, line_no, block_id, one row per line."""
    return events.join(lines, [*keys, "line_no"])


def range_blocks(events: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: int) -> DataFrame:
    """The same by spans low..high (both in): spans are dealt to buckets of width, the join is one of equal buckets, then exact."""
    at_bucket = F.floor(F.col(at) / width)
    dealt = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return events.withColumn("_bucket", at_bucket).join(dealt, "_bucket").where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("_bucket")


def innermost(events: DataFrame, spans: DataFrame, keys: list[str], at: str, low: str, high: str, block: str) -> DataFrame:
    """Events with the block of the innermost span low..high (both in) of their keys that holds at; events outside all spans go.

    Spans nest or lie apart, and are of any length: a sweep over their ends. A span's depth is the number of open ones at its
    start; its parent is the last span before it that is one less deep. The innermost span changes only where a span starts (to
    it) or has ended (to its parent), so each span makes two marks, and an event takes the last mark at or before it. Of spans with
    the same ends the one with the greater block is inner. Columns of events that are called like low, high or block stay apart.
    """
    own = spans.select(*keys, F.col(low).cast("long").alias("_low"), F.col(high).cast("long").alias("_high"), F.col(block).alias("_block")).where("_low <= _high")
    # at one place ends come before starts, and of starts the outer before the inner
    starts = own.select(*keys, F.col("_low").alias("_at"), F.lit(1).alias("_step"), (-F.col("_high")).alias("_turn"), "_block", "_high")
    ends = own.select(*keys, (F.col("_high") + 1).alias("_at"), F.lit(-1).alias("_step"), F.lit(None).cast("long").alias("_turn"), F.lit(None).cast(own.schema["_block"].dataType).alias("_block"), "_high")
    order = [F.col("_at"), F.col("_step"), F.col("_turn").asc_nulls_first(), F.col("_block").asc_nulls_first()]
    depth = F.sum("_step").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    opened = starts.unionByName(ends).withColumn("_depth", depth).where("_step = 1")
    # a span asks on its parent's level, and answers on its own
    asks = opened.select(*keys, (F.col("_depth") - 1).alias("_level"), "_at", "_turn", "_block", "_high", F.col("_depth"), F.lit(None).cast(own.schema["_block"].dataType).alias("_open"))
    answers = opened.select(*keys, F.col("_depth").alias("_level"), "_at", "_turn", "_block", "_high", F.lit(None).cast("long").alias("_depth"), F.col("_block").alias("_open"))
    level = Window.partitionBy(*keys, "_level").orderBy("_at", "_turn", "_block").rowsBetween(Window.unboundedPreceding, 0)
    known = asks.unionByName(answers).withColumn("_parent", F.last("_open", ignorenulls=True).over(level)).where("_depth IS NOT NULL")
    held = lambda pos, rank, b: known.select(*keys, pos.alias("_at"), F.struct(rank.alias("rank"), b.alias("block")).alias("_mark"))
    # at one place the deepest start counts, and without one the outermost end
    begin = held(F.col("_at"), F.col("_depth"), F.col("_block"))
    end = held(F.col("_high") + 1, -F.col("_depth"), F.when(F.col("_depth") > 1, F.col("_parent")))
    marks = begin.unionByName(end).groupBy(*keys, "_at").agg(F.max("_mark").alias("_mark"))
    rows = events.select(*keys, F.col(at).cast("long").alias("_at"), F.struct(*events.columns).alias("_row"))
    both = rows.withColumn("_mark", F.lit(None).cast(marks.schema["_mark"].dataType)).unionByName(marks.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    # marks come before the events of their place
    sweep = Window.partitionBy(*keys).orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_mark", ignorenulls=True).over(sweep)).where("_row IS NOT NULL AND _last.block IS NOT NULL")
    return found.select("_row.*", F.col("_last.block").alias("innermost"))


def writes(events: DataFrame, keys: list[str], order: str, var: str, value: str) -> DataFrame:
    """Every write of each variable, in order, repeats too."""
    return collected(events, [*keys, var], order, value, "values")


def final_value(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def sampled(rows: DataFrame, keys: list[str], order: str, k: int, seed: int) -> DataFrame:
    """k rows of each key by the digest of (seed, keys, order): the same rows every time, on every engine."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in keys], F.col(order).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_digest", order))
    return rows.withColumn("_digest", digest).withColumn("sample_rank", rank).where(F.col("sample_rank") <= k).drop("_digest")

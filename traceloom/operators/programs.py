"""Program analysis over tables of source texts: functions, syntax, literals, control flow. Arrow batches in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import patterns as P
from traceloom.functions import programs, writes
from traceloom.functions.flow import Flow
from traceloom.schemas import CFG_BLOCKS, CFG_JSON


def mapped(c: Column, f: Callable, kind: str) -> Column:
    """f of each text of a column, batch by batch; null stays null.

    It is never worked out elsewhere than where it stands: else the filter that Spark makes of an explode takes it below a
    distinct or a join, to every row there, and once more above.
    """

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: None if x is None else f(x))

    return run.asNondeterministic()(c)


def syntax_gate(tasks: DataFrame, code: str = "code") -> DataFrame:
    """tasks with syntax_ok and syntax_error."""
    return tasks.withColumn("_s", mapped(F.col(code), lambda x: "" if programs.syntax(x)[0] else programs.syntax(x)[1] or "error", "string")).withColumn("syntax_ok", F.col("_s") == "").withColumnRenamed("_s", "syntax_error")


def functions(tasks: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """keys, ordinal, name, required, positional and any_number of each top-level function."""
    kind = "array<struct<ordinal:int,name:string,required:int,positional:int,any_number:boolean>>"
    found = mapped(F.col(code), lambda x: [dict(zip(("ordinal", "name", "required", "positional", "any_number"), f, strict=True)) for f in programs.functions(x)], kind)
    return tasks.select(*keys, found.alias("f")).select(*keys, F.explode("f").alias("f")).select(*keys, "f.*")


def accepts(arity: Column) -> Column:
    """Whether a functions() row takes so many arguments."""
    return (F.col("required") <= arity) & (F.col("any_number") | (arity <= F.col("positional")))


def callable_functions(functions_of: DataFrame, arities: DataFrame, preferred: DataFrame, keys: list[str]) -> DataFrame:
    """keys and name of the function to call: the preferred one, else the last that takes all arities, else the last.

    arities: keys, arity (rows may repeat); preferred: keys, preferred. All after the parse is joins and aggregates.
    """
    sizes = arities.groupBy(*keys).agg(F.min("arity").alias("least"), F.max("arity").alias("most"))
    rows = functions_of.join(sizes, keys, "left").join(preferred, keys, "left")
    fits = F.coalesce(accepts(F.col("least")) & accepts(F.col("most")), F.lit(False))
    last = lambda cond: F.max_by(F.when(cond, F.col("name")), F.when(cond, F.col("ordinal")))
    return rows.groupBy(*keys).agg(F.coalesce(last(F.col("name") == F.col("preferred")), last(fits), F.max_by("name", "ordinal")).alias("name"))


def entry_names(tasks: DataFrame, keys: list[str], test: str = "test", test_list: str = "test_list") -> DataFrame:
    """keys, preferred: the function of the last assertion, else of the last listed test that calls one."""
    asserted = F.try_element_at(F.regexp_extract_all(F.coalesce(F.col(test), F.lit("")), F.lit(P.ASSERTED_FUNCTION), F.lit(1)), F.lit(-1))
    calls = F.transform(F.coalesce(F.col(test_list), F.array().cast("array<string>")), lambda t: F.regexp_extract(t, P.CALLED_NAME, 1))
    return tasks.select(*keys, F.coalesce(asserted, F.try_element_at(F.filter(calls, lambda x: x != ""), F.lit(-1))).alias("preferred"))


def test_inputs(tasks: DataFrame, keys: list[str], test: str = "test") -> DataFrame:
    """keys, line_no (from 1) and literal of each input of a test."""
    found = mapped(F.col(test), programs.test_inputs, "array<string>")
    return tasks.select(*keys, found.alias("x")).select(*keys, F.posexplode("x").alias("p", "literal")).select(*keys, (F.col("p") + 1).alias("line_no"), "literal")


def parsed_inputs(inputs: DataFrame, literal: str = "literal") -> DataFrame:
    """inputs with the column parsed: each literal as JSON (see functions.programs.tagged)."""
    return inputs.withColumn("parsed", mapped(F.col(literal), programs.parsed_or_text, "string"))


def input_values(inputs: DataFrame, literal: str = "literal") -> DataFrame:
    """inputs with the column value: each literal as a variant, tuples, sets and what JSON lacks tagged; what is no literal is its text.

    value_at() reads a place in it with a type, so inputs can be filtered and compared by value: [1, 2] is [1.0,2], "1" isn't 1.
    """
    return inputs.withColumn("value", F.parse_json(mapped(F.col(literal), programs.parsed_or_text, "string")))


def value_at(value: Column, path: str, kind: str) -> Column:
    """The typed value at a path like $[0] or $.x of a variant; null where there is none, or none of that type."""
    return F.try_variant_get(value, path, kind)


def value_text(value: Column) -> Column:
    """A variant as JSON text, the same for equal values however they were written."""
    return F.to_json(value)


def sequence_column(c: Column) -> Column:
    """array<string> of list literals, repaired where block names are bare."""
    return mapped(c, programs.sequence_items, "array<string>")


def cfg_blocks(tasks: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """keys and a CFG_BLOCKS row for each basic block; none for code that doesn't parse."""
    names = [x.split()[0] for x in CFG_BLOCKS.split(", ")]
    kind = "array<struct<" + ",".join(x.replace(" ", ":", 1) for x in CFG_BLOCKS.split(", ")) + ">>"
    found = mapped(F.col(code), lambda x: [dict(zip(names, r, strict=True)) for r in Flow(x).rows()], kind)
    return tasks.select(*keys, found.alias("b")).select(*keys, F.explode("b").alias("b")).select(*keys, "b.*")


PART = "part string, ordinal int, name string, kind string, line_start int, line_end int, lines array<int>, successors array<string>, required int, positional int, any_number boolean"


class ProgramParts:
    """A table function: the parts of one program from one parse.

    part is function (name, required, positional, any_number), block (name, kind, lines, successors), inputs (the top-level
    assignment's lines) or write (the variable and its lines); ordinal counts each part from 0. None for null code and code
    that doesn't parse.
    """

    def eval(self, code: str | None) -> Iterator[tuple]:
        if code is None or not programs.syntax(code)[0]:
            return
        for i, name, required, positional, any_number in programs.functions(code):
            yield ("function", i, name, None, None, None, None, None, required, positional, any_number)
        for i, (name, kind, first, last, lines, after, _) in enumerate(Flow(code).rows()):
            yield ("block", i, name, kind, first, last, lines, after, None, None, None)
        span = programs.inputs_span(code)
        if span:
            yield ("inputs", 0, "inputs", None, *span, None, None, None, None, None)
        for i, (_, name, first, _, last, _) in enumerate(writes.instrumented(code)[1]):
            yield ("write", i, name, None, first, last, None, None, None, None, None)


def program_parts(tasks: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """keys and a PART row for each part of each program, by a lateral join; also SQL's program_parts(code) from then on."""
    spark = tasks.sparkSession
    spark.udtf.register("program_parts", F.udtf(ProgramParts, returnType=PART))
    rows = tasks.select(*keys, F.col(code).alias("_code"))
    return spark.sql(f"SELECT {', '.join(f't.`{k}`' for k in keys)}, p.* FROM {{rows}} t, LATERAL program_parts(t._code) p", rows=rows)


def cfg_edges(blocks: DataFrame, keys: list[str]) -> DataFrame:
    return blocks.select(*keys, F.col("block_id").alias("src"), F.explode("successors").alias("dst"))


def cfg_lines(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, block_id: of the blocks that held a line the last, which outranks those before."""
    rows = blocks.select(*keys, "block_id", F.substr("block_id", F.lit(2)).cast("int").alias("n"), F.explode("lines").alias("line_no"), F.create_map(*[F.lit(x) for pair in P.BLOCK_RANKS.items() for x in pair])[F.col("block_type")].alias("rank"))
    return rows.groupBy(*keys, "line_no").agg(F.max_by("block_id", F.struct(F.col("rank"), -F.col("n"))).alias("block_id"))


def cfg_text(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cfg: the blocks in the order of their first lines, as a prompt shows them."""
    code = F.split("source_snippet", "\n")
    head = F.format_string("[%s] %-12s line %d-%d:  %s", "block_id", "block_type", "line_start", "line_end", code[0])
    rest = F.transform(F.slice(code, F.lit(2), F.size(code)), lambda x: F.concat(F.lit(" " * 22), x))
    shown = F.array_join(F.concat(F.array(head), rest), "\n")
    rows = blocks.select(*keys, F.struct("line_start", F.substr("block_id", F.lit(2)).cast("int").alias("n"), shown.alias("text")).alias("x"))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n").alias("cfg"))


def cfg_json(blocks: DataFrame, keys: list[str], output_var: str = "result") -> DataFrame:
    """keys, json: the blocks by name and the output variable."""
    fields = [x.split()[0] for x in CFG_BLOCKS.split(", ")]
    entry = F.struct(F.col("block_id").alias("key"), F.struct(*fields).alias("value"))
    return blocks.groupBy(*keys).agg(F.to_json(F.struct(F.lit(output_var).alias("output_var"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("blocks"))).alias("json"))


def blocks_from_json(graphs: DataFrame, keys: list[str], column: str = "json") -> DataFrame:
    """keys, output_var and a CFG_BLOCKS row for each block of cfg_json() texts; a text that is no such graph has none."""
    parsed = graphs.select(*keys, F.from_json(column, CFG_JSON).alias("g"))
    return parsed.select(*keys, "g.output_var", F.explode("g.blocks").alias("_id", "b")).select(*keys, "output_var", "b.*")


def stored_or_built(tasks: DataFrame, stored: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """keys, cfg: the text of a stored graph (keys, cfg) where there is one, else of the graph built from the code."""
    missing = tasks.join(stored.select(*keys), keys, "left_anti")
    return stored.select(*keys, "cfg").unionByName(cfg_text(cfg_blocks(missing, keys, code), keys))


def with_new_inputs(tasks: DataFrame, inputs: DataFrame, keys: list[str], script: str = "script") -> DataFrame:
    """keys, script: scripts whose assignment to inputs is replaced by the literals of inputs (line_no, literal); null where they have none."""
    lists = inputs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "literal"))), lambda x: x["literal"]).alias("literals"))
    rows = tasks.join(lists, keys)

    @F.pandas_udf("string")
    def swapped(code: pd.Series, literals: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else programs.with_inputs(c, list(x)) for c, x in zip(code, literals, strict=True)], dtype=object)

    return rows.select(*keys, swapped(F.col(script), F.col("literals")).alias("script"))

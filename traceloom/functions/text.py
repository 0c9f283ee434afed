"""Text and parse expressions: columns to columns, inside whole-stage code generation where Spark has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traceloom.functions import patterns as P

#: Line ends of a child's standard output: more than those of a text file.
OUTPUT_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """White space of all of Unicode off both ends; a run of it is tried from its start alone, so long runs cost no more."""
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]++|(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++\z", "")


def file_lines(c: Column, ends: str = "\r\n|\r|\n") -> Column:
    """The lines of a file's text: a last line end starts no line, an empty text has none; null stays null."""
    cut = F.split(c, ends)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut))


def numbered_lines(texts: DataFrame, keys: list[str], text: str, ends: str = "\r\n|\r|\n") -> DataFrame:
    """keys, line_no (from 1) and value of each line."""
    return texts.select(*keys, F.posexplode(file_lines(F.col(text), ends)).alias("pos", "value")).select(*keys, (F.col("pos") + 1).alias("line_no"), "value")


def result_block(c: Column, empty: str = "ERROR: empty", fence: str | None = None) -> Column:
    """The first <result> block, stripped; without one the whole text, stripped; empty for a null or empty text.

    fence: another opening mark, such as a fenced block's, that ends at the next fence.
    """
    pattern = P.RESULT_BLOCK if fence is None else rf"(?s)```{fence}(.*?)```"
    found = F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1)).otherwise(c)
    return F.when(c.isNull() | (c == ""), F.lit(empty)).otherwise(strip(found))


def key_values(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, var, value, line_no of lines with a colon: parted at the first, quotes off the name, values as raw text; of a repeated name the last."""
    line = strip(F.col("value"))
    parts = F.split(line, ":", 2)
    name = F.expr("""trim(BOTH '"' FROM trim(BOTH "'" FROM _name))""")
    rows = lines.where(F.contains(line, F.lit(":"))).select(*keys, "line_no", strip(parts[0]).alias("_name"), strip(parts[1]).alias("_value"))
    rows = rows.select(*keys, "line_no", name.alias("var"), F.col("_value").alias("value"))
    last = rows.groupBy(*keys, "var").agg(F.max(F.struct("line_no", "value")).alias("x"))
    return last.select(*keys, "var", F.col("x.value").alias("value"), F.col("x.line_no").alias("line_no"))


def as_list_text(c: Column) -> Column:
    """Double quotes to single ones, and quotes round bare block names."""
    return F.regexp_replace(F.regexp_replace(c, '"', "'"), r"(?<!')\b(B\d+)\b(?!')", "'$1'")


def list_items(c: Column) -> Column:
    """Items of a flat list of quoted names, in order; other texts give none."""
    body = F.regexp_extract(as_list_text(c), r"^\s*\[(.*)\]\s*$", 1)
    return F.regexp_extract_all(body, F.lit(r"'([^']*)'"), F.lit(1))


def as_strings(c: Column) -> Column:
    """A null sequence is empty; items as strings."""
    return F.transform(F.coalesce(c, F.array()), lambda x: x.cast("string"))


def output_variable(source: Column) -> Column:
    """The variable that a program builds its output in: result if it appends to or writes that, else the first name returned, else result."""
    returned = F.regexp_extract(source, P.RETURNED_NAME, 1)
    builds = source.rlike(P.APPENDS_TO_RESULT) | source.rlike(P.WRITES_RESULT)
    return F.when(builds | (returned == ""), "result").otherwise(returned)


def test_field(c: Column) -> Column:
    """A test's text from its first 'inputs' on; a line of an assertion is cut at its first closing bracket."""
    kept = F.when(F.instr(c, "inputs") > 0, F.substr(c, F.instr(c, "inputs"))).otherwise(c)
    return F.array_join(F.transform(file_lines(kept), lambda x: F.when(F.contains(x, F.lit("assertion")), F.concat(F.split(x, r"\)")[0], F.lit(")"))).otherwise(x)), "\n")


def test_fields(c: Column) -> Column:
    """test_field() of each item of a list, joined by line ends."""
    return F.array_join(F.transform(c, test_field), "\n")


def input_literal(test: Column) -> Column:
    """The list literal between 'inputs =' and a line of results; null if that shape isn't there."""
    return F.when(test.rlike(P.INPUTS_BEFORE_RESULTS), F.regexp_extract(test, P.INPUTS_BEFORE_RESULTS, 1))


def routed_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of a test with their kind and routed text: results lines, loop heads, assertions (as appended results), others."""
    start = F.ltrim(strip(F.col("value")))
    results, loop, assertion = (F.startswith(start, F.lit(w)) for w in P.ROUTED_WORDS)
    kind = F.when(results, "results").when(loop, "loop").when(assertion, "assertion").otherwise("plain")
    v = F.col("value")
    rest = {k: F.substr(v, F.lit(n + 1)) for k, n in P.ROUTED_OFFSETS.items()}
    call = F.concat(F.lit(P.APPENDED[0]), rest["assertion"], F.lit(P.APPENDED[1]))
    text = F.when(F.col("kind") == "results", rest["results"]).when(F.col("kind") == "loop", P.LOOP_HEAD).when(F.col("kind") == "assertion", call).otherwise(v)
    return lines.withColumn("kind", kind).withColumn("routed", text)


def combined_script(routed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, script (routed lines but the results, in order) and results."""
    pick = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("line_no", "routed")))), lambda x: x["routed"]), "\n")
    return routed.groupBy(*keys).agg(pick(F.col("kind") != "results").alias("script"), pick(F.col("kind") == "results").alias("results"))


def assigned_input(source: Column) -> Column:
    """What stands right of the first = of the first line that starts with input or inputs: comment off, white space single; null if there is none."""
    line = F.regexp_extract(source, r"(?m)^[ \t]*inputs?\b.*$", 0)
    right = F.split(line, "=", 2)
    return F.when((line != "") & (F.size(right) > 1), strip(F.regexp_replace(F.split(right[1], "#")[0], r"\s+", " ")))


def with_inputs_line(source: Column, line: Column, everywhere: bool = False) -> Column:
    """source with its first 'inputs =' line (or each of them) replaced by line."""
    pattern = r"(?m)^[ \t]*inputs?[ \t]*=.*$"
    cut = F.split(source, pattern, -1 if everywhere else 2)
    return F.when(source.rlike(pattern), F.aggregate(F.slice(cut, F.lit(2), F.size(cut)), cut[0], lambda acc, x: F.concat(acc, line, x))).otherwise(source)


def literal_arity(literal: Column) -> Column:
    """How many items a list or tuple literal has at its top level; 1 for other literals. Brackets at any depth and quotes are told apart.

    One fold over the characters: depth, the quote that is open, whether the next character is escaped, commas at the top
    level, and whether anything stands behind the last of them.
    """
    start = F.expr("named_struct('depth', 0, 'quote', '', 'escaped', false, 'commas', 0, 'behind', false)")

    def step(at: Column, c: Column) -> Column:
        quoted, escaped = at["quote"] != "", at["escaped"]
        opens, closes, quotes = (~quoted & c.isin(*x) for x in ("([{", ")]}", "'\""))
        comma = ~quoted & (c == ",") & (at["depth"] == 1)
        seen = quoted | quotes | (at["depth"] > 1) | (at["depth"] == 1) & ~closes & ~c.rlike(r"^\s$")
        return F.struct(
            (at["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
            F.when(quotes, c).when(quoted & ~escaped & (c == at["quote"]), "").otherwise(at["quote"]).alias("quote"),
            (quoted & ~escaped & (c == "\\")).alias("escaped"),
            (at["commas"] + F.when(comma, 1).otherwise(0)).alias("commas"),
            (~comma & (at["behind"] | seen)).alias("behind"),
        )

    count = F.aggregate(F.filter(F.split(literal, ""), lambda c: c != ""), start, step, lambda at: at["commas"] + at["behind"].cast("int"))
    return F.when(~literal.rlike(r"(?s)^\s*[\[(].*[\])]\s*$"), 1).otherwise(count)


def task_ids(raw: Column) -> Column:
    """Distinct task ids of a comma list, numbers with their prefix, in the order of their numbers."""
    cut = F.filter(F.transform(F.split(raw, ","), strip), lambda x: x != "")
    named = F.array_distinct(F.transform(cut, lambda x: F.when(F.startswith(x, F.lit("task_")), x).otherwise(F.concat(F.lit("task_"), x))))
    return F.transform(F.array_sort(F.transform(named, lambda x: F.struct(task_number(x).alias("n"), x.alias("x")))), lambda s: s["x"])


def task_number(task_id: Column) -> Column:
    """The number at a task id's end; null for others."""
    return F.nullif(F.regexp_extract(task_id, r"([0-9]{1,9})$", 1), F.lit("")).cast("int")


def dictionary_lines(entries: Column) -> Column:
    """map<string,array<string>> as lines 'name': [items]."""
    return F.array_join(F.transform(F.map_entries(entries), lambda e: F.concat(F.lit("'"), e["key"], F.lit("': ["), F.array_join(e["value"], ", "), F.lit("]"))), "\n")


def split_items(c: Column, kind: str = "output") -> Column:
    """Items of a text that came as one line: at white space, or for traces before each quoted name with a colon. More lines stay as they are."""
    lines = file_lines(c)
    pattern = r"\s+" if kind == "output" else P.TRACE_ITEM_GAP
    return F.when(F.size(lines) == 1, F.filter(F.split(strip(c), pattern), lambda x: x != "")).otherwise(lines)


def variable_of_span(source: Column, start_line: Column, start_column: Column, end_line: Column, end_column: Column, iid: Column) -> Column:
    """The name written at a source span (lines from 1, columns from 0): left of an assignment, loop variable, bare name, augmented assignment; else var_iid_<iid>."""
    lines = F.split(source, "\n")
    part = F.slice(lines, start_line, F.greatest(end_line - start_line + 1, F.lit(1)))
    one = F.substr(part[0], start_column + 1, end_column - start_column)
    more = F.concat_ws("\n", F.substr(part[0], start_column + 1), F.slice(part, F.lit(2), F.greatest(F.size(part) - 2, F.lit(0))), F.substr(F.element_at(part, -1), F.lit(1), end_column))
    text = strip(F.when(start_line == end_line, one).otherwise(more))
    ident = r"^[\p{L}_][\p{L}\p{N}_]*$"
    left = strip(F.split(text, "=", 2)[0])
    loop = F.regexp_extract(text, r"^for\s+([\p{L}_][\p{L}\p{N}_]*)\s+in\b", 1)
    augmented = F.regexp_extract(text, r"^([\p{L}_][\p{L}\p{N}_]*)\s*(?:\+|-|\*\*?|//?|%|&|\||\^|<<|>>|@)=", 1)
    plain = F.contains(text, F.lit("=")) & ~F.contains(text, F.lit("==")) & ~F.contains(text, F.lit("!="))
    return F.when(plain & left.rlike(ident), left).when(loop != "", loop).when(text.rlike(ident), text).when(augmented != "", augmented).otherwise(F.concat(F.lit("var_iid_"), iid.cast("string")))


def code_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def up_to(task_id: Column, most: int) -> Column:
    """Whether a task's number is at most that; tasks without a number are in."""
    return F.coalesce(task_number(task_id) <= most, F.lit(True))


def none_of(c: Column, parts: list[str]) -> Column:
    """Whether a name has none of the parts in it."""
    keep = F.lit(True)
    for p in parts:
        keep = keep & ~F.contains(c, F.lit(p))
    return keep


def shown(items: Column, most: int = 30) -> Column:
    """The first items, comma-joined, and how many more there are."""
    more = F.size(items) - most
    return F.concat(F.array_join(F.slice(items, F.lit(1), F.lit(most)), ", "), F.when(more > 0, F.concat(F.lit(", and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def block_trace_lines(path: Column, variable: Column, values: Column) -> Column:
    """A block trace as its two lines: quoted blocks, then the variable's values as they are."""
    quoted = F.transform(path, lambda b: F.concat(F.lit("'"), b, F.lit("'")))
    return F.concat(F.lit("'block_sequence': ["), F.array_join(quoted, ", "), F.lit("]\n'"), variable, F.lit("': ["), F.array_join(values, ", "), F.lit("]\n"))


def percent(part: Column, whole: Column) -> Column:
    """Two places and a percent sign; n/a of nothing."""
    return F.when(whole == 0, "n/a").otherwise(F.format_string("%.2f%%", 100.0 * part / whole))

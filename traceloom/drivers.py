"""Stages from files to reports: trace and block scores, validation with retries, mutation, repair, cleaning.

Each is a plain function over tables; what has side effects is written before it is read again, and what a stage
changes makes the results that were built on it void.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traceloom.functions import prompts, similarity, text
from traceloom.operators import compare, execute, programs, rollup, sequence
from traceloom.sources import files, sinks

KEYS = ["label", "task_id"]


def labelled_lines(spark: SparkSession, root: str, labels: list[str], glob: str = "*.txt") -> DataFrame:
    """label, task_id, line_no, value of the files below root/<label>; a label without a folder has none."""
    found = [files.result_lines(spark, f"{root}/{x}", glob, x, "file") for x in labels if sinks.exists(spark, f"{root}/{x}")]
    rows = found[0] if found else spark.createDataFrame([], "mode string, source string, task_id string, line_no int, value string")
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.select(F.col("mode").alias("label"), "task_id", "line_no", "value")


def evaluate_traces(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Scores of predicted variable traces by label and in total. truth, predicted: labelled_lines()."""
    sides = [text.key_values(rows, KEYS).select(*KEYS, "var", "value") for rows in (truth, predicted)]
    return rollup.variable_rollup(rollup.variable_scores(*sides, KEYS), "label")


def block_pairs(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, task_id, paths and values of tasks on both sides; values are those of the truth's first variable."""

    def sequences(lines, side, variables):
        named = text.key_values(lines, KEYS).join(variables, KEYS)
        return named.withColumn("items", programs.sequence_column(F.col("value"))).groupBy(*KEYS).agg(F.max(F.when(F.col("var") == "block_sequence", F.col("items"))).alias(f"{side}_path"), F.max(F.when(F.col("var") == F.col("variable"), F.col("items"))).alias(f"{side}_values"))

    variables = rollup.output_variables(truth, KEYS)
    both = sequences(truth, "truth", variables).join(sequences(predicted, "pred", variables), KEYS)
    empty = F.array().cast("array<string>")
    return both.select(*KEYS, *[F.coalesce(c, empty).alias(c) for c in ("truth_path", "pred_path", "truth_values", "pred_values")])


def evaluate_blocks(truth: DataFrame, predicted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of predicted block traces by label and in total, and the error classes by falling count."""
    scored = similarity.score_pairs(block_pairs(truth, predicted)).withColumn("_all", F.lit("total"))
    return rollup.block_rollup(scored, "label"), rollup.by_count(scored, ["_all"], "error_type", "task_id").drop("_all")


@dataclasses.dataclass
class Validation:
    """verdicts (kind, task_id, reason), their summary, and what differs in the failures."""

    verdicts: DataFrame
    summary: DataFrame
    examples: DataFrame


def validate(original: DataFrame, mutants: dict[str, DataFrame], inputs: DataFrame, most: int = 3) -> Validation:
    """original, inputs and each kind's mutant lines: task_id, line_no, value. Kind 'equivalent' has to print the same, others not."""
    parts, shown = [], []
    for kind, lines in mutants.items():
        verdicts = compare.validate(original, lines, ["task_id"], equivalent=kind == "equivalent")
        parts.append(verdicts.select(F.lit(kind).alias("kind"), "task_id", "reason"))
        failed = verdicts.where("reason NOT IN ('passed', 'missing_result')").select("task_id")
        differing = lines if kind == "equivalent" else None
        found = compare.examples(["task_id"], most, original, inputs, differing)
        found = found if differing is not None else found.withColumn("mutated", F.col("original"))
        shown.append(found.join(failed, "task_id", "left_semi").select(F.lit(kind).alias("kind"), "task_id", "rank", "input", "original", "mutated"))
    verdicts, examples = parts[0], shown[0]
    for a, b in zip(parts[1:], shown[1:], strict=True):
        verdicts, examples = verdicts.unionByName(a), examples.unionByName(b)
    return Validation(verdicts, compare.validation_summary(verdicts, ["kind"]), examples)


def validation_report(found: Validation) -> DataFrame:
    """One document per kind: its summary, and its failures with their examples (at most a few each)."""
    cases = found.examples.groupBy("kind", "task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "input", "original", "mutated"))).alias("examples"))
    rows = compare.failures(found.verdicts, include_missing=True).join(cases, ["kind", "task_id"], "left")
    return sinks.json_report(found.summary, rows, ["kind"])


def retry_prompts(found: Validation, programs_of: DataFrame, kind: str = "equivalent") -> DataFrame:
    """task_id, prompt: asks again for the mutants that failed, with what they got wrong. programs_of: task_id, code, mutant."""
    line = F.format_string("input %s: %s instead of %s", F.coalesce("input", F.lit("")), F.coalesce("mutated", F.lit("nothing")), F.coalesce("original", F.lit("nothing")))
    mine = found.examples.where(F.col("kind") == kind)
    told = mine.groupBy("task_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("said")))), lambda x: x["said"]), "\n").alias("told"))
    rows = programs_of.join(told, "task_id")
    ask = prompts.feedback(F.col("code"), F.col("mutant"), F.col("told")) if kind == "equivalent" else prompts.repair(F.col("code"), F.col("mutant"), F.lit(""), F.col("told"), F.lit("its outputs are the same"))
    return rows.select("task_id", ask.alias("prompt"))


def run_validation(tasks: DataFrame, mutants: DataFrame, make: Callable | None, to: str, timeout: float = 30, tries: int = 1, revalidate: bool = True, most: int = 3, skip_original: bool = False, stop_on_error: bool = False) -> Validation:
    """Run originals and mutants, validate, ask once more for the equivalent mutants that failed, run and validate those again.

    tasks: task_id, code, preferred, and inputs as array literals; mutants: kind, task_id, mutant. make: a predictor, or None for
    no retries; most: examples of a failure. Runs are written below the folder to; a retry always replaces what failed.
    skip_original: originals that ran before are not run again; stop_on_error: an error after the first stage with runs that fail.
    """
    spark = tasks.sparkSession
    inputs = tasks.select("task_id", F.posexplode("literals").alias("p", "literal")).select("task_id", (F.col("p") + 1).alias("line_no"), "literal")

    def outputs(code: DataFrame, name: str) -> DataFrame:
        if name == "original" and skip_original and sinks.exists(spark, f"{to}/{name}"):
            runs = spark.read.parquet(f"{to}/{name}")
        else:
            scripts = execute.spliced(code.join(tasks.select("task_id", "preferred"), "task_id"), inputs, ["task_id"])
            runs = sinks.resume(execute.run_scripts(scripts, ["task_id"], timeout=timeout), f"{to}/{name}", ["task_id"], overwrite=True)
        if stop_on_error and (failed := runs.where("status <> 'success'").count()):
            raise RuntimeError(f"{failed} runs of {name} failed, see {to}/{name}")
        return execute.output_lines(runs, ["task_id"])

    kinds = [r.kind for r in mutants.select("kind").distinct().collect()]  # a few kinds
    values = inputs.withColumnRenamed("literal", "value")
    original = outputs(tasks.select("task_id", "code"), "original")
    lines = {k: outputs(mutants.where(F.col("kind") == k).select("task_id", F.col("mutant").alias("code")), k) for k in sorted(kinds)}
    found = validate(original, lines, values, most)
    if make is None or "equivalent" not in kinds:
        return found
    both = mutants.where("kind = 'equivalent'").join(tasks.select("task_id", "code"), "task_id")
    answers = execute.predict(retry_prompts(found, both), ["task_id"], make, tries)
    answers = sinks.resume(programs.syntax_gate(answers.where("status = 'ok'"), "result"), f"{to}/retried", ["task_id"], overwrite=True)
    if not revalidate:
        return found
    new = outputs(answers.where("syntax_ok").select("task_id", F.col("result").alias("code")), "equivalent_retried")
    old = lines["equivalent"].join(answers.where("syntax_ok").select("task_id"), "task_id", "left_anti")
    kept = sinks.resume(old.unionByName(new), f"{to}/equivalent_lines", ["task_id"], overwrite=True)
    return validate(original, lines | {"equivalent": kept}, values, most)


def mutate(tasks: DataFrame, kind: str, make: Callable, tries: int = 5, parallel: int | None = None, **calls) -> DataFrame:
    """kind, task_id, status (ok, empty, no_syntax) and mutant of tasks (task_id, code, literals): a predictor's rewrite, kept if it parses. calls: as of predict()."""
    if kind not in ("equivalent", "non_equivalent"):
        raise ValueError(f"no kind of mutant: {kind}")
    ask = prompts.equivalent(F.col("code")) if kind == "equivalent" else prompts.non_equivalent(F.col("code"), F.array_join("literals", "\n"))
    answers = programs.syntax_gate(execute.predict(tasks.select("task_id", ask.alias("prompt")), ["task_id"], make, tries, parallel, **calls), "result")
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("syntax_ok"), "ok").otherwise("no_syntax")
    return answers.select(F.lit(kind).alias("kind"), "task_id", status.alias("status"), F.when(status == "ok", F.col("result")).alias("mutant"))


def compare_results(original: DataFrame, mutant: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The compare lines of tasks that have results on both sides, and task_id, reason of those that were skipped."""
    one, two = (x.select("task_id").distinct() for x in (original, mutant))
    both = one.join(two, "task_id", "left_semi")
    skipped = one.join(two, "task_id", "left_anti").withColumn("reason", F.lit("no_mutant_result")).unionByName(two.join(one, "task_id", "left_anti").withColumn("reason", F.lit("no_original_result")))
    lines = compare.compare_lines(*(x.join(both, "task_id", "left_semi") for x in (original, mutant)), ["task_id"])
    return lines, skipped


def selected_problems(problems: DataFrame, task_ids: str | None = None, limit: int | None = None) -> DataFrame:
    """problems of the named tasks (a comma list; None: all), in the order of their numbers, the first limit of them."""
    rows = problems
    if task_ids:
        named = problems.sparkSession.range(1).select(F.explode(text.task_ids(F.lit(task_ids))).alias("task_id"))
        rows = rows.join(named, "task_id", "left_semi")
    rows = rows.orderBy(text.task_number(F.col("task_id")), "task_id")
    return rows.limit(limit) if limit else rows


def repair(tasks: DataFrame, problems: DataFrame, make: Callable | None, attempts: int = 5, tries: int = 1, timeout: float = 30) -> DataFrame:
    """REPAIR_RESULT-like rows of tasks (task_id, code, mutant, original array, literals array) with a problem.

    Without a predictor the mutants are only judged again (refresh): status valid or failed. Otherwise each is asked for
    until a candidate passes. Hashes tell what changed; a changed task's dependent results are void (see invalidated()).
    """
    rows = tasks.join(problems.select("task_id"), "task_id", "left_semi")
    if make is None:
        judged = execute.gate(rows.withColumn("candidate", F.col("mutant")), ["task_id"], timeout)
        out = judged.select("task_id", F.when(F.col("ok"), "valid").otherwise("failed").alias("status"), F.array(F.struct(F.lit(1).alias("attempt"), "ok", "reason", "diff_indices")).alias("attempts"), F.lit(None).cast("string").alias("new"))
    else:
        asked = rows.withColumn("prompt", prompts.repair(F.col("code"), F.coalesce("mutant", F.lit("")), F.array_join("literals", "\n"), F.array_join("original", "\n"), F.lit("it gives the same outputs, or none")))
        done = execute.repair(asked, ["task_id"], make, attempts, timeout, tries)
        out = done.select("task_id", "status", "attempts", F.when(F.col("status") == "fixed", F.col("code")).alias("new"))
    last = F.element_at("attempts", -1)["diff_indices"]
    both = out.join(rows.select("task_id", "mutant"), "task_id")
    return both.select("task_id", "status", "attempts", F.size(last).alias("diff_count"), last.alias("diff_indices"), text.code_hash(F.col("mutant")).alias("old_hash"), F.coalesce(text.code_hash(F.col("new")), text.code_hash(F.col("mutant"))).alias("new_hash"), "new")


def repair_report(problems: DataFrame, results: DataFrame) -> DataFrame:
    """One row: how many tasks were selected, the problems found by kind and the outcomes by status."""
    kinds = [F.count_if(F.col("problem") == k).alias(k) for k in ("failed_or_timeout", "empty_compare", "fully_same")]
    statuses = [F.count_if(F.col("status") == s).alias(s) for s in ("fixed", "valid", "failed")]
    found = problems.agg(F.struct(*kinds).alias("discovered"))
    return found.crossJoin(results.agg(F.count("*").alias("selected_task_count"), F.struct(*statuses).alias("outcomes")))  # one row each


def invalidated(results: DataFrame, dependent: DataFrame) -> DataFrame:
    """The rows of a dependent table that still hold: those of tasks whose program didn't change."""
    changed = results.where(~F.col("old_hash").eqNullSafe(F.col("new_hash"))).select("task_id")
    return dependent.join(changed, "task_id", "left_anti")


def cleaned(texts: DataFrame, kind: str = "output") -> tuple[DataFrame, DataFrame]:
    """Texts (label, task_id, text) with one-line files split into their items, and counts by label: files, split, errors."""
    items = text.split_items(F.col("text"), kind)
    one = F.size(text.file_lines(F.col("text"))) == 1
    rows = texts.select("label", "task_id", F.when(one, F.concat(F.array_join(items, "\n"), F.lit("\n"))).otherwise(F.col("text")).alias("text"), (one & (F.size(items) > 1)).alias("split"), (F.trim("text") == "ERROR: empty").alias("error"))
    counts = rows.groupBy("label").agg(F.count("*").alias("files"), F.count_if("split").alias("split"), F.count_if("error").alias("errors"))
    return rows.where("NOT error").select(*KEYS, "text"), counts


def literals_of(inputs: DataFrame) -> DataFrame:
    """task_id, literals: a task's inputs (line_no, literal) in order."""
    return sequence.collected(inputs, ["task_id"], "line_no", "literal", "literals")


def first_inputs(spark: SparkSession, truth: str, predicted: str, inputs: str | None, mode: str) -> DataFrame:
    """mode, task_id, status, text: the inputs of each task's first same (correct) and first different (error) case of a mode; without inputs, the truth's lines."""
    lines = lambda d, source: files.result_lines(spark, f"{d}/{mode}", "*.txt", mode, source)
    values = files.input_literals(spark, f"{inputs}/{mode}", "*.txt").withColumnRenamed("literal", "value") if inputs else lines(truth, "local").select("task_id", "line_no", "value")
    found = compare.first_cases(files.marked_valid(lines(truth, "local")), lines(predicted, "predicted"), values, ["task_id"])
    return sinks.first_case_columns(found).select(F.lit(mode).alias("mode"), "task_id", "status", F.concat("literal", F.lit("\n")).alias("text"))


def swapped(spark: SparkSession, scripts: str, inputs: str, of_modes: list[str], of_statuses: list[str], glob: str = "*.py", choose: Callable = lambda rows: rows) -> DataFrame:
    """label (<mode>/<status>), task_id, outcome (written, missing_inputs, no_inputs_in_script) and script: scripts below <mode> with the inputs below <mode>/<status>."""
    parts = []
    for mode in of_modes:
        if not sinks.exists(spark, f"{scripts}/{mode}"):
            continue
        rows = choose(files.whole_texts(spark, f"{scripts}/{mode}", glob).select("task_id", F.col("text").alias("script")))
        for status in of_statuses:
            at = f"{inputs}/{mode}/{status}"
            literals = files.input_literals(spark, at, "*.txt") if sinks.exists(spark, at) else spark.createDataFrame([], "task_id string, line_no int, literal string")
            made = programs.with_new_inputs(rows, literals, ["task_id"]).withColumn("has_inputs", F.lit(True))
            both = rows.select("task_id").join(made, "task_id", "left")
            outcome = F.when(F.col("has_inputs").isNull(), "missing_inputs").when(F.col("script").isNull(), "no_inputs_in_script").otherwise("written")
            parts.append(both.select(F.lit(f"{mode}/{status}").alias("label"), "task_id", outcome.alias("outcome"), "script"))
    if not parts:
        raise ValueError(f"no folders of {', '.join(of_modes)} below {scripts}")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def materialised(tasks: DataFrame, inputs: DataFrame, sampled: DataFrame, header: str = "", footer: str = "") -> DataFrame:
    """task_id, file, text: the files of each task's folder, for task_tree.write_task_files() with the name {task_id}/{file}.

    tasks: TASKS with test as text.test_field() gives it; inputs and sampled: task_id, line_no, literal. <task>.json has the task, code.py
    its code, combined.py the code with the routed test between header and footer, results.txt the expected results,
    code_inputs.txt and sample_code_inputs.txt a line for each input. A task without inputs or results lacks those files.
    """
    routed = text.combined_script(text.routed_lines(text.numbered_lines(tasks, ["task_id"], "test"), ["task_id"]), ["task_id"])
    rows = tasks.join(routed, "task_id", "left")
    lines = lambda *c: F.concat(F.concat_ws("\n", *c), F.lit("\n"))
    ends = [F.lit(x) if x else F.lit(None).cast("string") for x in (header, footer)]
    code = F.coalesce("code", F.lit(""))
    entries = [
        (F.concat("task_id", F.lit(".json")), F.to_json(F.struct(*tasks.columns))),
        (F.lit("code.py"), lines(code)),
        (F.lit("combined.py"), lines(code, ends[0], F.when(F.col("script") != "", F.col("script")), ends[1])),
        (F.lit("results.txt"), F.when(F.col("results") != "", F.col("results"))),
    ]
    each = F.explode(F.array(*[F.struct(name.alias("file"), content.alias("text")) for name, content in entries]))
    found = rows.select("task_id", each.alias("x")).select("task_id", "x.*").where("text IS NOT NULL")
    for name, literals in (("code_inputs.txt", inputs), ("sample_code_inputs.txt", sampled)):
        known = literals.withColumnRenamed("literal", "value").join(tasks.select("task_id"), "task_id", "left_semi")
        found = found.unionByName(sinks.text_lines(known, ["task_id"]).select("task_id", F.lit(name).alias("file"), "text"))
    return found

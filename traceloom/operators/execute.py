"""Side effects behind mapInPandas: script runs, traces, candidate gates, predictors, repairs.

Tasks that run again would run their programs, or ask their predictor, again: write such a frame before it is read
twice (sources.sinks.resume does), and give predict() a journal where a call costs money.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.functions import programs, sandbox, text, writes
from traceloom.operators import fanout
from traceloom.schemas import ATTEMPT, ERROR_EMPTY, SPAN
from traceloom.sources.files import from_environment


def _each(rows: DataFrame, keys: list[str], take: list[str], schema: str, f: Callable[..., list[tuple]]) -> DataFrame:
    """keys and the rows that f gives for each row's columns take."""
    kinds = dict(rows.dtypes)
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                key, values = row[: len(keys)], [None if v is pd.NA or (isinstance(v, float) and v != v) else v for v in row[len(keys) :]]
                out += [(*key, *r) for r in f(*values)]
            yield pd.DataFrame(out, columns=[*keys, *names])

    return rows.select(*keys, *take).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", " + schema)


def run_scripts(tasks: DataFrame, keys: list[str], script: str = "script", timeout: float = 30) -> DataFrame:
    """keys, status (success, failed, timeout, missing; cut: output beyond what is kept), output, error."""
    return _each(tasks, keys, [script], "status string, output string, error string", lambda s: [sandbox.run_script(s, timeout)])


def output_lines(runs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line_no, value of the output of runs that succeeded."""
    return text.numbered_lines(runs.where("status = 'success'"), keys, "output", text.OUTPUT_ENDS)


def trace_events(tasks: DataFrame, keys: list[str], script: str = "script", timeout: float = 30, most: int = sandbox.MOST_EVENTS) -> DataFrame:
    """keys and TRACE_EVENTS-like rows (step, func, frame_id, event, line_no, var, value, kind): a row per variable, one with a null variable per step without any."""

    def rows(s):
        out = []
        for step, func, frame, event, line, held in sandbox.trace_script(s, timeout, most)[1]:
            out += [(step, func, frame, event, line, k, v[0], v[1]) for k, v in held.items()] or [(step, func, frame, event, line, None, None, None)]
        return out

    return _each(tasks, keys, [script], "step long, func string, frame_id long, event string, line_no int, var string, value string, kind string", rows)


def instrumented(tasks: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """keys, script (null for code that doesn't parse) and spans: programs that report their writes, and where each iid is in the code."""

    def build(c):
        script, spans = writes.instrumented(c) if c is not None else (None, [])
        return [(script, [dict(zip(("iid", "variable", "start_line", "start_column", "end_line", "end_column"), (str(s[0]), *s[1:]), strict=True)) for s in spans])]

    return _each(tasks, keys, [code], f"script string, spans array<struct<{SPAN}>>", build)


def spans_of(programs_of: DataFrame, keys: list[str]) -> DataFrame:
    """keys, iid, variable and span: a row for each write of instrumented() programs."""
    return programs_of.select(*keys, F.explode("spans").alias("s")).select(*keys, "s.*")


def write_runs(programs_of: DataFrame, keys: list[str], timeout: float = 30, most: int = sandbox.MOST_EVENTS) -> DataFrame:
    """keys, status, written (how many writes there were; null if the program was stopped) and events of instrumented() programs: the first most writes."""

    def rows(s):
        status, count, events = sandbox.writing_script(s, writes.HOOK, timeout, most)
        return [(status, count, [{"step": a, "iid": str(b), "value": c, "kind": d} for a, b, c, d in events])]

    found = _each(programs_of, keys, ["script"], "status string, written double, events array<struct<step:bigint,iid:string,value:string,kind:string>>", rows)
    return found.withColumn("written", F.col("written").cast("long"))


def write_events(runs: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, step, iid, var, value, kind: the events of write_runs() with the variable that each iid writes."""
    events = runs.select(*keys, F.explode("events").alias("e")).select(*keys, "e.*")
    named = events.join(spans.select(*keys, "iid", F.col("variable").alias("var")), [*keys, "iid"], "left")
    return named.select(*keys, "step", "iid", F.coalesce("var", F.concat(F.lit("var_iid_"), "iid")).alias("var"), "value", "kind")


def line_events(events: DataFrame, keys: list[str], functions: list[str], variable: str) -> DataFrame:
    """One row per line event of the functions (and of the module): step, line_no and the variable's value then."""
    kept = events.where((F.col("event") == "line") & F.col("func").isin(*functions, "<module>"))
    return kept.groupBy(*keys, "step", "line_no").agg(F.max(F.when(F.col("var") == variable, F.col("value"))).alias("value"))


def runner_script(code: str, literals: list[str], function: str | None) -> str:
    """A script that calls the function with each input (lists and tuples spread) and prints a line each."""
    if function is None:
        raise ValueError("the code defines no function")
    block = "\n".join(["inputs = [", *[f"    {x}," for x in literals], "]"])
    calls = "from math import inf, nan\n" if any("inf" in x or "nan" in x for x in literals) else ""
    loop = f"for one in inputs:\n    print({function}(*one) if isinstance(one, (list, tuple)) else {function}(one))\n"
    return f"{code}\n\n{calls}\n{block}\n\n{loop}"


def spliced(tasks: DataFrame, inputs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and script of tasks (code, preferred) and their inputs (line_no, literal); null where no function is found."""
    lists = inputs.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "literal"))), lambda x: x["literal"]).alias("literals"))
    rows = tasks.join(lists, keys, "left").withColumn("literals", F.coalesce("literals", F.array().cast("array<string>")))

    def build(code, literals, preferred):
        name = programs.called_function(code or "", list(literals), preferred)
        return [(runner_script(code, list(literals), name) if name else None,)]

    return _each(rows, keys, ["code", "literals", "preferred"], "script string", build)


def judge(candidate: str | None, original: list[str], literals: list[str], timeout: float = 30) -> tuple[bool, str, list[int]]:
    """Whether a changed program may stay, why not, and the places (from 0) where its outputs differ.

    In this order: it parses, has a function to call, ends in time, ends well, prints as many lines, and differs.
    """
    ok, error = programs.syntax(candidate or "")
    if not candidate or not ok:
        return False, f"syntax: {error or 'empty'}", []
    name = programs.called_function(candidate, literals)
    if name is None:
        return False, "no function to call", []
    status, output, error = sandbox.run_script(runner_script(candidate, literals, name), timeout)
    if status != "success":
        return False, "timeout" if status == "timeout" else f"failed: {error.strip().splitlines()[-1] if error.strip() else ''}", []
    lines = output.splitlines()
    if len(lines) != len(original):
        return False, f"{len(lines)} outputs for {len(original)}", []
    differ = [i for i, (a, b) in enumerate(zip(original, lines, strict=True)) if a != b]
    return bool(differ), "" if differ else "no output differs", differ


def gate(candidates: DataFrame, keys: list[str], timeout: float = 30) -> DataFrame:
    """keys, ok, reason, diff_indices of candidates (candidate, original array, literals array)."""
    return _each(candidates, keys, ["candidate", "original", "literals"], "ok boolean, reason string, diff_indices array<int>", lambda c, o, x: [judge(c, list(o), list(x), timeout)])


class Predictor(Protocol):
    """Answers prompts; one is made in each Python worker."""

    def answer(self, key: str, prompt: str) -> str | None: ...


class Replay:
    """Answers from stored texts by key, for work without a network; the k-th time a key is asked its k-th answer."""

    def __init__(self, answers: dict[str, list[str]]):
        self.answers, self.asked = answers, {}

    def answer(self, key: str, prompt: str) -> str | None:
        n = self.asked[key] = self.asked.get(key, 0) + 1
        found = self.answers.get(key, [])
        return found[min(n, len(found)) - 1] if found else None


class Service:
    """Answers of a chat service over HTTP: POST of model and messages as JSON, the text of the first choice back.

    Address and key may be written as ${NAME}: they are read from the environment of the worker that asks, so no key is in a
    plan. Each Python worker makes its own.
    """

    def __init__(self, address: str, model: str, key: str = "", timeout: float = 60):
        self.address, self.model, self.key, self.timeout = address, model, key, timeout

    def answer(self, key: str, prompt: str) -> str | None:
        body = json.dumps({"model": self.model, "messages": [{"role": "user", "content": prompt}]}).encode()
        headers = {"Content-Type": "application/json"}
        if secret := from_environment(self.key):
            headers["Authorization"] = f"Bearer {secret}"
        request = urllib.request.Request(from_environment(self.address), body, headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["choices"][0]["message"]["content"]


def with_retries(ask: Callable[[], str | None], tries: int = 5, wait: Callable[[float], None] = time.sleep) -> str | None:
    """The first answer that isn't empty; waits 1, 2, 4, ... seconds after a failure; None after the last."""
    for i in range(tries):
        try:
            if found := ask():
                return found
        except Exception:
            if i == tries - 1:
                return None
        if i < tries - 1:
            wait(2.0**i)
    return None


def predict(prompts: DataFrame, keys: list[str], make: Callable[[], Predictor], tries: int = 5, parallel: int | None = None, at_once: int = 1, per_second: float | None = None, journal: str | None = None) -> DataFrame:
    """keys, status (ok, empty), raw and result of prompts (prompt).

    parallel: partitions; at_once: calls that a partition has in flight, so the predictor's answer() is called from as many threads;
    per_second: calls started a second by all tasks together; journal: a folder where answers are kept as they come, so that a
    task, or query, that runs again asks only the rest (the same parallel finds them; an empty answer is asked for again).
    """
    context = prompts.sparkSession.sparkContext
    n = parallel or (context.defaultParallelism if journal else None)
    rows = prompts.select(*keys, "prompt")
    rows = rows.repartition(n, *keys) if journal else rows.repartition(n) if n else rows
    # a task has its share of the rate: no more than so many run at a time
    share = per_second / min(n or context.defaultParallelism, context.defaultParallelism) if per_second else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor, pace = make(), fanout.Pace(share)
        log = fanout.Journal(journal, TaskContext.get().partitionId()) if journal else None

        def paced(key: str, prompt: str) -> str | None:
            pace.wait()
            return predictor.answer(key, prompt)

        def call(item: tuple) -> str | None:
            _, key, prompt = item
            known = log.known.get(log.digest(key, prompt)) if log else None
            return known or with_retries(lambda: paced(key, prompt), tries)

        def items() -> Iterator[tuple]:
            for b in batches:
                for i, row in enumerate(b.to_pylist()):
                    yield b.slice(i, 1).select(keys), "/".join(str(row[k]) for k in keys), row["prompt"] or ""

        try:
            for (row, key, prompt), raw in fanout.completed(items(), call, at_once):
                if log and raw and log.digest(key, prompt) not in log.known:
                    log.put(key, prompt, raw)
                yield row.append_column("raw", pa.array([raw], pa.string()))
        finally:
            if log:
                log.close()

    kinds = dict(prompts.dtypes)
    out = rows.mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", raw string")
    return out.withColumn("status", F.when(F.coalesce(F.col("raw"), F.lit("")) == "", "empty").otherwise("ok")).withColumn("result", text.result_block(F.col("raw"), ERROR_EMPTY))


def repair(tasks: DataFrame, keys: list[str], make: Callable[[], Predictor], attempts: int = 5, timeout: float = 30, tries: int = 1) -> DataFrame:
    """keys, status, attempts, code of problem tasks (prompt, original array, literals array, code): each asks until a candidate passes the gate.

    Attempts of one task follow one another, as each names the reason of the last; tasks run side by side.
    """

    def run(key, prompt, original, literals, code):
        predictor, done, reason = make(), [], ""
        for i in range(1, attempts + 1):
            asked = f"{prompt}\n\nThe last attempt was rejected: {reason}" if reason else prompt
            candidate = with_retries(lambda: predictor.answer(key, asked), tries)
            ok, reason, differ = judge(candidate, list(original), list(literals), timeout)
            done.append({"attempt": i, "ok": ok, "reason": reason, "diff_indices": differ})
            if ok:
                return [("fixed", done, candidate)]
        return [("failed", done, code)]

    rows = tasks.withColumn("_key", F.concat_ws("/", *keys))
    out = _each(rows, keys, ["_key", "prompt", "original", "literals", "code"], "status string, attempts string, code string", lambda *a: [(s, json.dumps(d), c) for s, d, c in run(*a)])
    return out.withColumn("attempts", F.from_json("attempts", f"array<{ATTEMPT}>"))

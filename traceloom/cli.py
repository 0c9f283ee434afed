"""Command line: list the queries, run one, explain one, check one against its SQL, score stored outputs, trace scripts.

    python -m traceloom list
    python -m traceloom run rq1_summary --data DIR [--out DIR] [--limit N]
    python -m traceloom explain rq1_summary --data DIR
    python -m traceloom evaluate --truth DIR --predicted DIR [--mode all] [--report DIR] [--inputs DIR --first-cases DIR]
    python -m traceloom execute --scripts DIR [--timeout 30] [--limit N] [--overwrite] [--files DIR] --out DIR
    python -m traceloom trace --scripts DIR [--timeout 30] --out DIR
    python -m traceloom writes --scripts DIR [--timeout 30] --out DIR
    python -m traceloom blocks --scripts DIR --out DIR
    python -m traceloom swap --scripts DIR --inputs DIR [--files DIR] --out DIR
    python -m traceloom load --tasks FILE --out DIR [--sample-size 10] [--seed 0] [--limit N] [--files DIR [--footer FILE]]
    python -m traceloom splice --tasks FILE --out DIR
    python -m traceloom predict --scripts DIR --out DIR [--kind output|variables|blocks] (--answers DIR | --service URL --model NAME [--key ${NAME}] [--tries 5] [--workers N] [--at-once K] [--per-second R] [--journal DIR])
    python -m traceloom mutate --tasks FILE --out DIR --kind equivalent|non_equivalent --service URL --model NAME
    python -m traceloom repair --tasks FILE --mutants DIR --results DIR --compared DIR --out DIR [--task-ids 1,2] [--dry-run] [--refresh-only] [--service URL --model NAME]
    python -m traceloom compare --original DIR --mutant DIR --out DIR
    python -m traceloom evaluate-traces --truth DIR --predicted DIR [--label NAME ...]
    python -m traceloom evaluate-blocks --truth DIR --predicted DIR [--label NAME ...]
    python -m traceloom clean --texts DIR --out DIR [--label NAME ...] [--kind output|trace]
    python -m traceloom problems --results DIR --compared DIR --tasks FILE
    python -m traceloom validate --original DIR --mutant DIR [--non-equivalent] [--include-missing]
    python -m traceloom validate --original DIR --equivalent DIR --different DIR [--inputs DIR] [--report DIR] [--max-examples 3]
    python -m traceloom validate --run-exec --tasks FILE --mutants DIR --out DIR [--retry --service URL --model NAME] [--no-revalidate] [--skip-original] [--stop-on-error] [--timeout 30] [--limit N] [--report DIR]
    python -m traceloom stale --tables STAGE=DIR ... --records DIR [--drop]
    python -m traceloom record --tables STAGE=DIR ... --records DIR [--stage NAME ...]

execute, trace, writes, blocks, swap, splice and predict take --mode and --status (all, or one): the scripts are then below DIR/<mode> or
DIR/<mode>/<status>, results have the route as their label, and one run covers all routes that are there.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom import drivers, modes
from traceloom.functions import prompts, text
from traceloom.operators import compare, execute, lineage, programs, sequence
from traceloom.plans.catalogue import ORACLES, QUERIES
from traceloom.session import session
from traceloom.sources import files, sinks, task_tree


def _routes(p: argparse.ArgumentParser) -> None:
    p.add_argument("--mode", choices=["all", *modes.MODES])
    p.add_argument("--status", choices=["all", *modes.STATUSES])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="traceloom")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    for name in ("run", "explain"):
        q = sub.add_parser(name)
        q.add_argument("query", choices=sorted(QUERIES))
        q.add_argument("--data", required=True)
        q.add_argument("--out")
        q.add_argument("--limit", type=int)
    e = sub.add_parser("evaluate")
    e.add_argument("--truth", required=True)
    e.add_argument("--predicted", required=True)
    e.add_argument("--mode", default="all", choices=["all", *modes.MODES])
    e.add_argument("--report")
    e.add_argument("--include-unpredicted", action="store_true")
    e.add_argument("--inputs", help="folders <mode> of the tasks' inputs")
    e.add_argument("--first-cases", help="the inputs of the first same and first different case of each task, as a file each")
    for name in ("execute", "trace", "writes", "blocks", "swap"):
        x = sub.add_parser(name)
        x.add_argument("--scripts", required=True)
        x.add_argument("--glob", default="*.py")
        x.add_argument("--timeout", type=float, default=30)
        x.add_argument("--limit", type=int)
        x.add_argument("--task", action="append")
        x.add_argument("--overwrite", action="store_true")
        x.add_argument("--out", required=True)
        _routes(x)
        if name in ("execute", "swap"):
            x.add_argument("--files", help="a folder that gets a file for each task too")
        if name == "swap":
            x.add_argument("--inputs", required=True, help="folders <mode>/<status> of the tasks' new inputs")
    for name in ("load", "splice"):
        t = sub.add_parser(name)
        t.add_argument("--tasks", required=True)
        t.add_argument("--out", required=True)
        t.add_argument("--sample-size", type=int, default=10)
        t.add_argument("--seed", type=int, default=0)
        t.add_argument("--limit", type=int)
        t.add_argument("--overwrite", action="store_true")
        if name == "load":
            t.add_argument("--files", help="a folder that gets each task's files too")
            t.add_argument("--footer", help="a file that ends each combined script")
    r = sub.add_parser("predict")
    r.add_argument("--scripts", required=True)
    r.add_argument("--glob", default="*.py")
    r.add_argument("--answers", help="folder of task_*.txt files that a replay answers with")
    r.add_argument("--kind", choices=["output", "variables", "blocks"], default="output")
    r.add_argument("--limit", type=int)
    r.add_argument("--task", action="append")
    r.add_argument("--overwrite", action="store_true")
    r.add_argument("--out", required=True)
    _routes(r)
    d = sub.add_parser("problems")
    d.add_argument("--tasks", required=True)
    d.add_argument("--results", required=True)
    d.add_argument("--compared", required=True)
    v = sub.add_parser("validate")
    v.add_argument("--original")
    v.add_argument("--run-exec", action="store_true", help="run the programs of --tasks and --mutants first")
    v.add_argument("--tasks")
    v.add_argument("--mutants", help="folders equivalent and non_equivalent of programs")
    v.add_argument("--out")
    v.add_argument("--limit", type=int)
    v.add_argument("--exec-timeout", type=float, default=30)
    for flag in ("retry", "no-revalidate", "skip-original", "stop-on-error"):
        v.add_argument(f"--{flag}", action="store_true")
    v.add_argument("--mutant")
    v.add_argument("--equivalent")
    v.add_argument("--different")
    v.add_argument("--inputs")
    v.add_argument("--report")
    v.add_argument("--max-examples", type=int, default=3)
    v.add_argument("--non-equivalent", action="store_true")
    v.add_argument("--include-missing", action="store_true")
    m = sub.add_parser("mutate")
    m.add_argument("--tasks", required=True)
    m.add_argument("--kind", choices=["equivalent", "non_equivalent"], required=True)
    f = sub.add_parser("repair")
    for name in ("tasks", "mutants", "results", "compared"):
        f.add_argument(f"--{name}", required=True)
    f.add_argument("--task-ids")
    f.add_argument("--attempts", type=int, default=5)
    f.add_argument("--dry-run", action="store_true")
    f.add_argument("--refresh-only", action="store_true")
    f.add_argument("--void", help="a table of task_id whose rows of changed tasks are dropped")
    for q in (r, m):
        q.add_argument("--at-once", type=int, default=1)
        q.add_argument("--per-second", type=float)
        q.add_argument("--journal")
    for name in ("stale", "record"):
        q = sub.add_parser(name)
        q.add_argument("--tables", nargs="+", required=True, metavar="STAGE=DIR")
        q.add_argument("--records", required=True)
        q.add_argument("--drop", action="store_true")
        q.add_argument("--stage", action="append")
    for q in (r, m, f, v):
        q.add_argument("--service")
        q.add_argument("--model", default="")
        q.add_argument("--key", default="")
        q.add_argument("--timeout", type=float, default=60)
        q.add_argument("--tries", type=int, default=5)
        q.add_argument("--workers", type=int)
    for q in (m, f):
        q.add_argument("--limit", type=int)
        q.add_argument("--overwrite", action="store_true")
        q.add_argument("--out", required=True)
    c = sub.add_parser("compare")
    c.add_argument("--original", required=True)
    c.add_argument("--mutant", required=True)
    c.add_argument("--out", required=True)
    for name in ("evaluate-traces", "evaluate-blocks"):
        e = sub.add_parser(name)
        e.add_argument("--truth", required=True)
        e.add_argument("--predicted", required=True)
        e.add_argument("--label", action="append")
    k = sub.add_parser("clean")
    k.add_argument("--texts", required=True)
    k.add_argument("--kind", choices=["output", "trace"], default="output")
    k.add_argument("--label", action="append")
    k.add_argument("--out", required=True)
    return p


def _service(args):
    return lambda: execute.Service(args.service, args.model, args.key, args.timeout)


def _tasks(spark, args):
    """task_id, code, preferred and literals of a snapshot's tasks."""
    rows = files.tasks(spark, args.tasks)
    rows = rows.orderBy("task_num").limit(args.limit) if args.limit else rows
    inputs = programs.test_inputs(rows.withColumn("test", text.test_field(F.col("test"))), ["task_id"])
    return rows.join(programs.entry_names(rows, ["task_id"]), "task_id").join(drivers.literals_of(inputs), "task_id").select("task_id", "code", "preferred", "literals")


def _chosen(rows, args):
    rows = rows.where(F.col("task_id").isin(*args.task)) if args.task else rows
    return rows.orderBy("task_id").limit(args.limit) if args.limit else rows


def _scripts(spark, args):
    """The scripts of one folder (task_id, script), or of the routes that --mode and --status name (label too), and the keys of their rows. A limit is one for each route."""
    read = lambda at: _chosen(files.whole_texts(spark, at, args.glob).select("task_id", F.col("text").alias("script")), args)
    labels = modes.routes(args.mode, args.status)
    if labels is None:
        return read(args.scripts), ["task_id"]
    found = [read(f"{args.scripts}/{x}").select(F.lit(x).alias("label"), "task_id", "script") for x in labels if sinks.exists(spark, f"{args.scripts}/{x}")]
    if not found:
        raise SystemExit(f"none of these folders: {', '.join(labels)}")
    return reduce(DataFrame.unionByName, found), ["label", "task_id"]


def _predicted(rows, args, keys):
    return execute.predict(rows, keys, _service(args), args.tries, args.workers, args.at_once, args.per_second, args.journal)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "list":
        for name in sorted(QUERIES):
            print(name, "(with SQL)" if name in ORACLES else "")
        return
    spark = session()
    if args.command in ("run", "explain"):
        df = QUERIES[args.query](spark, args.data)
        df = df.limit(args.limit) if args.limit else df
        if args.command == "explain":
            df.explain("formatted")
        elif args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            df.show(args.limit or 20, truncate=False)
    elif args.command == "evaluate":
        tallies = None
        for mode in modes.selected(args.mode, modes.MODES):
            truth = files.marked_valid(files.result_lines(spark, f"{args.truth}/{mode}", "*.txt", mode, "local"))
            pred = files.result_lines(spark, f"{args.predicted}/{mode}", "*.txt", mode, "predicted")
            part = compare.compare_outputs(truth, pred, ["mode", "task_id"], include_unpredicted=args.include_unpredicted)
            tallies = part if tallies is None else tallies.unionByName(part)
        summary = compare.summarize(tallies, ["mode"])
        summary.show(truncate=False)
        if args.report:
            sinks.json_report(summary, tallies, ["mode"]).write.mode("overwrite").json(args.report)
        if args.first_cases:
            cases = [drivers.first_inputs(spark, args.truth, args.predicted, args.inputs, m) for m in modes.selected(args.mode, modes.MODES)]
            task_tree.write_task_files(reduce(DataFrame.unionByName, cases), args.first_cases, "{task_id}/{mode}_{status}_inputs.txt", exists="overwrite")
    elif args.command == "execute":
        rows, keys = _scripts(spark, args)
        runs = sinks.resume(execute.run_scripts(rows, keys, timeout=args.timeout), args.out, keys, overwrite=args.overwrite)
        runs.groupBy(*keys[:-1], "status").count().orderBy(*keys[:-1], "status").show(100, truncate=False)
        if args.files:
            texts = runs.where("status = 'success'").withColumn("text", F.col("output"))
            task_tree.write_task_files(texts, args.files, ("{label}/" if len(keys) > 1 else "") + "{task_id}.txt", exists="overwrite" if args.overwrite else "skip")
    elif args.command == "trace":
        rows, keys = _scripts(spark, args)
        events = sequence.traced(execute.trace_events(rows, keys, timeout=args.timeout).where("var IS NOT NULL"))
        found = sequence.collected(sequence.changes(events, [*keys, "var"], "step", "value"), [*keys, "var"], "step", "value", "values")
        sinks.resume(found, args.out, keys, overwrite=args.overwrite).groupBy(*keys).count().orderBy(*keys).show(100, truncate=False)
    elif args.command == "writes":
        rows, keys = _scripts(spark, args)
        made = sinks.resume(execute.instrumented(rows, keys, "script"), f"{args.out}-instrumented", keys, overwrite=args.overwrite)
        runs = sinks.resume(execute.write_runs(made, keys, timeout=args.timeout), f"{args.out}-runs", keys, overwrite=args.overwrite)
        found = sequence.writes(sequence.traced(execute.write_events(runs, execute.spans_of(made, keys), keys)), keys, "step", "var", "value")
        sinks.resume(found, args.out, keys, overwrite=args.overwrite).groupBy(*keys).count().orderBy(*keys).show(100, truncate=False)
    elif args.command == "blocks":
        rows, keys = _scripts(spark, args)
        sinks.resume(programs.cfg_blocks(rows, keys, "script"), args.out, keys, overwrite=args.overwrite).groupBy(*keys[:-1], "block_type").count().orderBy(*keys[:-1], "block_type").show(100, truncate=False)
    elif args.command == "swap":
        made = drivers.swapped(spark, args.scripts, args.inputs, modes.selected(args.mode or "all", modes.MODES), modes.selected(args.status or "all", modes.STATUSES), args.glob, lambda rows: _chosen(rows, args))
        made = sinks.resume(made, args.out, ["label", "task_id"], overwrite=args.overwrite)
        made.groupBy("label", "outcome").count().orderBy("label", "outcome").show(100, truncate=False)
        if args.files:
            task_tree.write_task_files(made.where("outcome = 'written'").withColumn("text", F.col("script")), args.files, "{label}/{task_id}.py", exists="overwrite" if args.overwrite else "skip")
    elif args.command in ("stale", "record"):
        tables = dict(x.split("=", 1) for x in args.tables)
        if args.command == "record":
            lineage.record(spark, tables, args.records, args.stage)
        else:
            lineage.invalidate(spark, tables, args.records, drop=args.drop).groupBy("stage").count().orderBy("stage").show(100, truncate=False)
    elif args.command in ("load", "splice"):
        rows = files.tasks(spark, args.tasks)
        rows = rows.orderBy("task_num").limit(args.limit) if args.limit else rows
        fields = rows.withColumn("test", text.test_field(F.col("test")))
        inputs = sequence.sampled(programs.test_inputs(fields, ["task_id"]), ["task_id"], "line_no", args.sample_size, args.seed).drop("sample_rank")
        if args.command == "load":
            sampled = sinks.resume(inputs, args.out, ["task_id"], overwrite=args.overwrite)
            sampled.groupBy("task_id").count().show()
            if args.files:
                made = drivers.materialised(fields, programs.test_inputs(fields, ["task_id"]), sampled, footer=files.template(spark, args.footer))
                task_tree.write_task_files(made, args.files, "{task_id}/{file}", exists="overwrite" if args.overwrite else "skip")
        else:
            named = rows.join(programs.entry_names(rows, ["task_id"]), "task_id")
            sinks.resume(execute.spliced(named, inputs, ["task_id"]), args.out, ["task_id"], overwrite=args.overwrite).groupBy(F.col("script").isNull().alias("no_function")).count().show()
    elif args.command == "predict":
        rows, keys = _scripts(spark, args)
        script = F.col("script")
        if args.kind == "blocks":
            rows = rows.join(programs.cfg_text(programs.cfg_blocks(rows, keys, "script"), keys), keys, "left")
            ask = prompts.predict_blocks(script, F.coalesce("cfg", F.lit("(no blocks)")), text.output_variable(script))
        else:
            ask = prompts.predict_output(script) if args.kind == "output" else prompts.predict_variables(script)
        asked = rows.select(*keys, ask.alias("prompt"))
        if args.service:
            if sinks.exists(spark, args.out) and not args.overwrite:  # ask no question twice
                asked = compare.missing_from(asked, spark.read.parquet(args.out), keys)
            replies = _predicted(asked, args, keys).select(*keys, "status", "result")
            sinks.resume(replies, args.out, keys, overwrite=args.overwrite).groupBy(*keys[:-1], "status").count().orderBy(*keys[:-1], "status").show(100, truncate=False)
            return
        if not args.answers:
            raise SystemExit("predict needs --answers or --service")
        route = F.regexp_extract("path", "([^/]+(?:/(?:" + "|".join(modes.STATUSES) + "))?)/[^/]*$", 1).alias("label")
        answers = files.whole_texts(spark, args.answers, "task_*.txt").select(route, "task_id", F.col("text").alias("answer"))
        # stored answers are a table like any other: joined to the questions, not collected
        replies = asked.join(answers.select(*keys, "answer"), keys, "left").select(*keys, F.when(F.coalesce("answer", F.lit("")) == "", "empty").otherwise("ok").alias("status"), text.result_block(F.col("answer")).alias("result"))
        sinks.resume(replies, args.out, keys, overwrite=args.overwrite).groupBy(*keys[:-1], "status").count().orderBy(*keys[:-1], "status").show(100, truncate=False)
    elif args.command == "problems":
        results = files.result_lines(spark, args.results, "*.txt", "", "local")
        compared = files.marked_valid(files.result_lines(spark, args.compared, "*.txt", "", "compare"))
        compare.problem_tasks(files.tasks(spark, args.tasks), results, compared, ["task_id"]).orderBy("problem", "task_id").show(100, truncate=False)
    elif args.command == "mutate":
        made = drivers.mutate(_tasks(spark, args), args.kind, _service(args), args.tries, args.workers, at_once=args.at_once, per_second=args.per_second, journal=args.journal)
        sinks.resume(made, args.out, ["kind", "task_id"], overwrite=args.overwrite).groupBy("kind", "status").count().show()
    elif args.command == "repair":
        compared = files.marked_valid(files.result_lines(spark, args.compared, "*.txt", "", "compare"))
        results = files.result_lines(spark, args.results, "*.txt", "", "local")
        found = compare.problem_tasks(files.tasks(spark, args.tasks), results, compared, ["task_id"])
        found = drivers.selected_problems(found, args.task_ids, args.limit)
        if args.dry_run:
            found.show(1000, truncate=False)
            return
        mutants = files.whole_texts(spark, args.mutants, "*.py").select("task_id", F.col("text").alias("mutant"))
        tasks = _tasks(spark, args)
        inputs = tasks.select("task_id", F.posexplode("literals").alias("p", "literal")).select("task_id", (F.col("p") + 1).alias("line_no"), "literal")
        runs = execute.run_scripts(execute.spliced(tasks, inputs, ["task_id"]), ["task_id"], timeout=args.timeout)
        original = sequence.collected(execute.output_lines(runs, ["task_id"]), ["task_id"], "line_no", "value", "original")
        rows = tasks.join(mutants, "task_id").join(original, "task_id")
        done = drivers.repair(rows, found, None if args.refresh_only else _service(args), args.attempts, args.tries, args.timeout)
        done = sinks.resume(done, args.out, ["task_id"], overwrite=args.overwrite)
        drivers.repair_report(found, done).write.mode("overwrite").json(f"{args.out}-report")
        if args.void and sinks.exists(spark, args.void):
            drivers.invalidated(done, spark.read.parquet(args.void)).write.mode("overwrite").parquet(f"{args.void}-kept")
        done.groupBy("status").count().show()
    elif args.command == "compare":
        lines, skipped = drivers.compare_results(*(files.result_lines(spark, d, "*.txt", "", "local") for d in (args.original, args.mutant)))
        lines = sinks.resume(lines, args.out, ["task_id"], overwrite=True)
        compare.compare_summary(lines.withColumn("all", F.lit("all")), ["all"], ["all", "task_id"]).show()
        skipped.orderBy("task_id").show(1000, truncate=False)
    elif args.command in ("evaluate-traces", "evaluate-blocks"):
        labels = args.label or [f"{m}/{s}" for m in modes.MODES for s in ("correct", "error")]
        truth, predicted = (drivers.labelled_lines(spark, d, labels) for d in (args.truth, args.predicted))
        if args.command == "evaluate-traces":
            drivers.evaluate_traces(truth, predicted).orderBy("label").show(100, truncate=False)
        else:
            scores, errors = drivers.evaluate_blocks(truth, predicted)
            scores.orderBy("label").show(100, truncate=False)
            errors.orderBy("place").show(truncate=False)
    elif args.command == "clean":
        found = [files.whole_texts(spark, f"{args.texts}/{x}", "*.txt").select(F.lit(x).alias("label"), "task_id", "text") for x in args.label or modes.MODES if sinks.exists(spark, f"{args.texts}/{x}")]
        if not found:
            raise SystemExit("no texts")
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        kept, counts = drivers.cleaned(rows, args.kind)
        kept.write.mode("overwrite").parquet(args.out)
        counts.orderBy("label").show(truncate=False)
    elif args.command == "validate" and args.run_exec:
        if not (args.tasks and args.mutants and args.out):
            raise SystemExit("--run-exec needs --tasks, --mutants and --out")
        kinds = [k for k in ("equivalent", "non_equivalent") if sinks.exists(spark, f"{args.mutants}/{k}")]
        if not kinds:
            raise SystemExit("no mutants")
        mutants = reduce(DataFrame.unionByName, [files.whole_texts(spark, f"{args.mutants}/{k}", "*.py").select(F.lit(k).alias("kind"), "task_id", F.col("text").alias("mutant")) for k in kinds])
        make = _service(args) if args.retry and args.service else None
        if args.retry and not make:
            raise SystemExit("--retry needs --service")
        found = drivers.run_validation(_tasks(spark, args), mutants, make, args.out, args.exec_timeout, args.tries, not args.no_revalidate, args.max_examples, args.skip_original, args.stop_on_error)
        found.summary.orderBy("kind").show()
        compare.failures(found.verdicts, args.include_missing).orderBy("kind", "task_id").show(1000, truncate=False)
        if args.report:
            drivers.validation_report(found).write.mode("overwrite").json(args.report)
    elif args.command == "validate" and not args.original:
        raise SystemExit("validate needs --original, or --run-exec")
    elif args.command == "validate" and not args.mutant:
        lines = lambda d: files.result_lines(spark, d, "*.txt", "", "local").select("task_id", "line_no", "value")
        original = lines(args.original)
        mutants = {k: lines(d) for k, d in (("equivalent", args.equivalent), ("non_equivalent", args.different)) if d}
        if not mutants:
            raise SystemExit("validate needs --mutant, --equivalent or --different")
        inputs = files.input_literals(spark, args.inputs, "*.txt").withColumnRenamed("literal", "value") if args.inputs else original.limit(0)
        found = drivers.validate(original, mutants, inputs, args.max_examples)
        found.summary.orderBy("kind").show()
        compare.failures(found.verdicts, args.include_missing).orderBy("kind", "task_id").show(1000, truncate=False)
        if args.report:
            drivers.validation_report(found).write.mode("overwrite").json(args.report)
    elif args.command == "validate":
        original, mutant = (files.result_lines(spark, d, "*.txt", "", "local") for d in (args.original, args.mutant))
        verdicts = compare.validate(original, mutant, ["task_id"], equivalent=not args.non_equivalent)
        compare.validation_summary(verdicts, []).show()
        compare.failures(verdicts, args.include_missing).show(truncate=False)

"""Command line: ``python -m spanloom inspect|validate|evaluate|detect ...``.

Exit codes: 0 nothing is wrong, 2 the work is done and found something that blocks a release, 1
it could not be done. Only counts are printed, never a text, a value or an id."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import detect, scoring, selection, validation
from .plans import evaluation, reports
from .sources import files, lock, sinks


def _inspect(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = files.snapshot(spark, args.source).select("uid", "split", "text")
    found = evaluation.inspect(rows)
    sinks.write_immutable(args.out, reports.inspection_report(found))
    blocked = selection.ownership(rows, "uid", "split").count() + found["exact_duplicates"].where("crosses").count()
    print(f"blockers: {blocked}")
    return 2 if blocked else 0


def _validate(spark: SparkSession, args: argparse.Namespace) -> int:
    lines = files.read_jsonl(spark, args.source, hardened=True)
    checked = validation.check_records(lines.select("value"), args.split)
    sinks.write_immutable(args.out, reports.validation_report(checked))
    faulty = checked.where(F.size("faults") > 0).count()
    print(f"faulty records: {faulty}")
    return 2 if faulty else 0


def _gold(prepared: DataFrame) -> DataFrame:
    spans = prepared.select("sample_id", F.explode("metadata.entity_spans").alias("s"))
    return spans.select("sample_id", "s.type", "s.start", F.col("s.end").alias("stop"), "s.text")


def _evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.sha256:
        lock.frozen(args.data, args.sha256)
    lines = files.read_jsonl(spark, args.data)
    said = files.read_jsonl(spark, args.predictions)
    predictions = files.predictions(said)
    if not lines.where("fault is not null").isEmpty() or not predictions.where("fault is not null").isEmpty():
        raise ValueError("a line can't be read")
    samples = files.prepared(lines)
    found = scoring.coverage(samples, predictions).first()
    if found["missing"] or found["extra"]:
        raise ValueError(f"predictions don't cover the data: {found['missing']} missing, {found['extra']} extra")
    run = evaluation.evaluate(samples.select("sample_id", "text"), _gold(samples), predictions, args.work)
    sinks.write_immutable(args.out, reports.evaluation_report(run))
    if args.sha256:
        lock.frozen(args.data, args.sha256)
    invalid = run.parsed.where("not schema_valid").count()
    print(f"samples: {found['shared']}, invalid responses: {invalid}")
    return 2 if invalid else 0


def _detect(spark: SparkSession, args: argparse.Namespace) -> int:
    samples = files.prepared(files.read_jsonl(spark, args.data))
    found = detect.respond(detect.detect(samples, id_col="sample_id")).select("sample_id", F.col("response").alias("raw_output"))
    sinks.write_jsonl(found, args.out)
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanloom", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *names: str, **optional: str) -> None:
        own = commands.add_parser(name)
        own.set_defaults(run=run)
        for n in names:
            own.add_argument(f"--{n}", required=True)
        for n, text in optional.items():
            own.add_argument(f"--{n}", help=text)

    command("inspect", _inspect, "source", "out")
    command("validate", _validate, "source", "split", "out")
    command("evaluate", _evaluate, "data", "predictions", "out", sha256="digest that the data must have", work="folder for the parsed and aligned predictions")
    command("detect", _detect, "data", "out")
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("spanloom").getOrCreate()
    try:
        return args.run(spark, args)
    except Exception as e:  # whatever stops the work, its text may hold data
        print(f"failed: {type(e).__name__}" + (f": {e}" if type(e) in (ValueError, FileExistsError, lock.LockError) else ""), file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

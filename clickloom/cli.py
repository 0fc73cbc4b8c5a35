"""The jobs from a command line: ``python -m clickloom.cli JOB ...`` (or through spark-submit)."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from . import contracts, reports, schema
from .operators import metrics, validate
from .plans import pipelines
from .session import build_session
from .sources.clicklog import build_source, read_canonical


def _materialize(spark: SparkSession, a: argparse.Namespace) -> dict:
    config = contracts.resolve_paths(contracts.load_config(a.config), os.path.dirname(os.path.abspath(a.config)))
    totals = pipelines.materialize(spark, config, a.out)
    pipelines.files_index(spark, a.out).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{a.out.rstrip('/')}_files_index")
    return totals


def _load(spark: SparkSession, a: argparse.Namespace) -> dict:
    config = contracts.resolve_paths(contracts.load_config(a.config), os.path.dirname(os.path.abspath(a.config)))
    df = build_source(config).load(spark)
    return {"columns": df.columns, "first": [[str(x) for x in r] for r in df.limit(a.rows).collect()]}


def _validate(spark: SparkSession, a: argparse.Namespace) -> dict:
    log = read_canonical(spark, a.log, features=a.features)
    problems = validate.schema_problems(spark.read.parquet(a.log), a.features)
    by_split = {r["split"]: r.asDict() for r in validate.violations(log).collect()}
    missing = [r.asDict() for r in validate.most_missing(log, a.features).collect()]
    return {"ok": not problems and not any(r["violations"] for r in by_split.values()), "problems": problems, "splits": by_split, "most_missing": missing}


def _profile(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"tables": reports.output_manifest(pipelines.run_profile(spark, a.log, a.out, a.features), a.out)}


def _simulate(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"bidders": pipelines.replay_stream(spark, a.stream, a.out, a.budget, a.slots, a.rule)}


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> dict:
    scored = spark.read.parquet(a.scored)
    return {r["group"]: {k: v for k, v in r.asDict().items() if k != "group"} for r in metrics.evaluate(scored, a.group, a.bins).collect()}


def _runs(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"runs": [r.asDict() for r in contracts.runs(spark, a.root).orderBy("run_id").collect()]}


def _run(spark: SparkSession, a: argparse.Namespace) -> dict:
    return contracts.get_run(a.root, a.run_id)


def _compare(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"metrics": [r.asDict() for r in contracts.compare_runs(spark, a.root, a.first, a.second).orderBy("metric").collect()]}


def _export(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"file": reports.export_run(a.root, a.run_id, a.output)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clickloom")
    jobs = p.add_subparsers(dest="job", required=True)

    def job(name, run, *positional, **options):
        j = jobs.add_parser(name)
        for x in positional:
            j.add_argument(x)
        for x, default in options.items():
            if isinstance(default, list):
                j.add_argument(f"--{x}", nargs="+", default=default)
            else:
                j.add_argument(f"--{x}", type=type(default) if default is not None else str, default=default)
        j.set_defaults(run=run)

    job("materialize", _materialize, "config", "out")
    job("load", _load, "config", rows=5)
    job("validate", _validate, "log", features=list(schema.FEATURES))
    job("profile", _profile, "log", "out", features=list(schema.FEATURES))
    job("simulate", _simulate, "stream", "out", budget=10_000.0, slots=1, rule="second_price")
    job("evaluate", _evaluate, "scored", group=None, bins=10)
    job("runs", _runs, "root")
    job("run", _run, "root", "run_id")
    job("compare", _compare, "root", "first", "second")
    job("export", _export, "root", "run_id", "output")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    out = a.run(spark or build_session(f"clickloom {a.job}"), a)
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()

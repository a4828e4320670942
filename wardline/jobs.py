"""Batch entry points for spark-submit.

    jobs.py prepare  --root DIR --source NAME=FILE ... --output DIR [--side FILE] [--on-conflict report]
    jobs.py train    --data DIR --model DIR [--weighting auto|balanced|sqrt_balanced] ...
    jobs.py classify --model DIR --prompts TABLE --output TABLE
    jobs.py analyze  --model DIR --prompts TABLE --log TABLE --rejected TABLE [--batch NAME] [--max-chars N]
    jobs.py stats    --log TABLE --output DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession, functions as F

from .operators import history
from .operators.admission import rejected
from .plans.preparation import prepare, write_preparation
from .plans.scoring import analyze_prompts, classify_prompts
from .plans.training import TrainSettings, train_and_evaluate
from .sources.corpus import load_labelled_csv, load_split, side_source_rows
from .sources.history import append_analyses, identify, read_log
from .sources.model_store import load_model, save_run


def run_prepare(spark: SparkSession, args: argparse.Namespace) -> None:
    sources = dict(item.split("=", 1) for item in args.source)
    raw = load_labelled_csv(spark, args.root, sources)
    side = side_source_rows(spark, f"{args.root}/{args.side}") if args.side else None
    write_preparation(prepare(raw, args.on_conflict, side_rows=side), args.output, args.format)


def run_train(spark: SparkSession, args: argparse.Namespace) -> None:
    splits = [load_split(spark, f"{args.data}/{name}", args.format) for name in ("train", "validation", "test")]
    settings = TrainSettings(
        args.c_value, args.max_iterations, args.tolerance, args.max_features, weighting=args.weighting
    )
    save_run(train_and_evaluate(*splits, settings=settings), args.model)


def run_classify(spark: SparkSession, args: argparse.Namespace) -> None:
    prompts = spark.read.parquet(args.prompts)
    keep = [c for c in prompts.columns if c != "prompt"]
    classify_prompts(prompts, load_model(spark, args.model), keep).write.parquet(args.output)


def run_analyze(spark: SparkSession, args: argparse.Namespace) -> None:
    """Analyse a table with ``prompt`` and ``prompt_id``, append the records to the log.

    Prompts that are not analysed go to the rejected table with all their columns and the reason.
    """
    table = spark.read.parquet(args.prompts)
    prompts = table.select("prompt_id", "prompt")
    records = analyze_prompts(prompts, load_model(spark, args.model), keep=["prompt_id"], max_chars=args.max_chars)
    append_analyses(identify(records, F.col("prompt_id")), args.log, args.batch)
    rejected(table, max_chars=args.max_chars).write.mode("append").parquet(args.rejected)


def run_stats(spark: SparkSession, args: argparse.Namespace) -> None:
    log = read_log(spark, args.log)
    tables = {
        "headline": history.headline_counts(log),
        "by_type": history.counts_by_type(log),
        "trend": history.daily_trend(log),
    }
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{args.output}/{name}")


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="jobs")
    jobs = root.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("prepare")
    job.add_argument("--root", required=True)
    job.add_argument("--source", action="append", required=True, metavar="NAME=FILE")
    job.add_argument("--side")
    job.add_argument("--output", required=True)
    job.add_argument("--on-conflict", choices=["strict", "report"], default="strict")
    job.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    job.set_defaults(run=run_prepare)

    defaults = TrainSettings()
    job = jobs.add_parser("train")
    job.add_argument("--data", required=True)
    job.add_argument("--model", required=True)
    job.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    job.add_argument("--max-features", type=int, default=defaults.max_features)
    job.add_argument("--max-iterations", type=int, default=defaults.max_iterations)
    job.add_argument("--c-value", type=float, default=defaults.c_value)
    job.add_argument("--tolerance", type=float, default=defaults.tolerance)
    job.add_argument("--weighting", choices=["auto", "balanced", "sqrt_balanced"], default=defaults.weighting)
    job.set_defaults(run=run_train)

    job = jobs.add_parser("classify")
    for name in ("--model", "--prompts", "--output"):
        job.add_argument(name, required=True)
    job.set_defaults(run=run_classify)

    job = jobs.add_parser("analyze")
    for name in ("--model", "--prompts", "--log", "--rejected"):
        job.add_argument(name, required=True)
    job.add_argument("--batch", help="name of the run; a run of the same name replaces it (default: by the analyses' ids)")
    job.add_argument("--max-chars", type=int, help="reject longer prompts; by default none is too long")
    job.set_defaults(run=run_analyze)

    job = jobs.add_parser("stats")
    for name in ("--log", "--output"):
        job.add_argument(name, required=True)
    job.set_defaults(run=run_stats)
    return root


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName(f"wardline-{args.job}").getOrCreate(), args)


if __name__ == "__main__":
    main()

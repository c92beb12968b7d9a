"""Command line: ``ocr`` one file, ``batch`` a folder, ``watch`` a folder for new files, ``info`` on a file or folder.

``--models module:function`` names a function that takes the session and returns keyword
arguments for ``Engine`` (detector, reader, recognizer). Run with ``python -m pagewright``
or hand this module to ``spark-submit``.
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F

from pagewright.config import EXPORT_FORMATS
from pagewright.facade import Engine, default_output
from pagewright.functions.errors import ExportError
from pagewright.session import SETTINGS
from pagewright.sources import sinks
from pagewright.sources.files import scan_documents


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="pagewright")
    commands = parser.add_subparsers(dest="command", required=True)
    ocr = commands.add_parser("ocr", help="read one file")
    ocr.add_argument("input")
    ocr.add_argument("--output", "-o")
    ocr.add_argument("--format", "-f", choices=EXPORT_FORMATS, default="txt")
    ocr.add_argument("--models", required=True)
    batch = commands.add_parser("batch", help="read all files of a folder")
    batch.add_argument("input")
    batch.add_argument("--output-dir", "-o")
    batch.add_argument("--format", "-f", choices=EXPORT_FORMATS, action="append")
    batch.add_argument("--models", required=True)
    batch.add_argument("--overlay", action="store_true", help="also write label rows")
    batch.add_argument("--per-document", action="store_true", help="one output per document (txt, json, csv)")
    watch = commands.add_parser("watch", help="read the files of a folder that are new since the last run")
    watch.add_argument("input")
    watch.add_argument("--output-dir", "-o", required=True, help="tables of files, results and regions by micro-batch")
    watch.add_argument("--state", required=True, help="checkpoint folder of the stream")
    watch.add_argument("--files-per-batch", type=int)
    watch.add_argument("--every", help="keep running and look this often, such as '1 minute'")
    watch.add_argument("--models", required=True)
    info = commands.add_parser("info", help="show file facts; page facts need --models with a reader")
    info.add_argument("input")
    info.add_argument("--models")
    return parser


def _engine(spark: SparkSession, spec: str) -> Engine:
    module, _, function = spec.partition(":")
    return Engine(spark, **getattr(importlib.import_module(module), function)(spark))


def _show_summary(batch) -> None:
    row = batch.results.agg(
        F.count("*").alias("pages"), F.sum("num_regions").alias("regions"),
        F.avg("confidence").alias("confidence")).first()
    print(f"Total pages: {row.pages}")
    print(f"Total regions: {row.regions or 0}")
    print(f"Average confidence: {row.confidence or 0:.2%}")


def run(spark: SparkSession, argv: list[str]) -> int:
    args = _parser().parse_args(argv)
    if args.command == "info":
        engine = _engine(spark, args.models) if args.models else Engine(spark, detector=lambda files: files)
        engine.info(args.input).show(truncate=False)
        return 0
    engine = _engine(spark, args.models)
    if args.command == "ocr":
        try:
            batch = engine.process(args.input)
        except ValueError as error:
            print(f"Error: {error}", file=sys.stderr)
            return 1
        output = engine.export(batch, args.output or default_output(args.input, args.format), args.format)
        print(f"Output: {output}")
        _show_summary(batch)
        return 0
    if args.command == "watch":
        engine.watch(args.input, args.output_dir, args.state, args.files_per_batch, args.every).awaitTermination()
        return 0
    try:
        listed = scan_documents(spark, args.input)
        if listed.select("path").first() is None:
            raise ValueError(f"no supported files in {args.input}")
        batch = engine.process_batch(args.input)
        folder = args.output_dir or f"{args.input.rstrip('/')}/ocr_output"
        for fmt in args.format or ["txt", "json"]:
            write = engine.export_files if args.per_document else engine.export
            write(batch, f"{folder}/{fmt}", fmt)
        if args.overlay:
            sinks.write_overlay(batch.results, batch.regions, f"{folder}/overlay")
    except (AnalysisException, ExportError, ValueError) as error:
        print(f"Error: {error}", file=sys.stderr)
        return 1
    counts = {r.status: r["count"] for r in batch.files.groupBy("status").count().collect()}
    print(f"Processed: {counts.get('ok', 0)} file(s), failed: {counts.get('failed', 0)}")
    print(f"Output folder: {folder}")
    return 0


def main() -> None:
    builder = SparkSession.builder.appName("pagewright")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    sys.exit(run(builder.getOrCreate(), sys.argv[1:]))


if __name__ == "__main__":
    main()

"""Commands: ``extract`` writes the schemas of Python classes as JSON Schema files, ``eval`` scores a provider on fixtures.

``python -m loomfield extract FILE... --out FOLDER [--strict] [--dialect standard|strict]``
``python -m loomfield eval FIXTURES --schema MODULE:NAME --provider MODULE:NAME [--report FOLDER] [--min-precision P] [--min-recall R]``
"""

from __future__ import annotations

import argparse
import importlib
import sys

from loomfield.plans.extract import emit, extract


def _named(where: str):
    module, _, name = where.partition(":")
    return getattr(importlib.import_module(module), name)


def run_extract(given: argparse.Namespace) -> int:
    schemas, warnings = extract(given.files)
    for w in warnings:
        print(w, file=sys.stderr)
    if warnings and given.strict:
        return 1
    for path in emit(schemas, given.out, given.dialect):
        print(path)
    return 0


def run_eval(given: argparse.Namespace) -> int:
    """Prints the report; 1 where a field misses a gate or an item failed."""
    from pyspark.sql import SparkSession

    from loomfield.operators import report

    spark = SparkSession.builder.getOrCreate()
    provider = _named(given.provider)
    items, _, stats = report.run_eval(report.load_fixtures(spark, given.fixtures), _named(given.schema), provider if hasattr(provider, "extract") and not isinstance(provider, type) else provider())
    items, stats = items.cache(), stats.cache()
    print(report.format_report(stats))
    total = report.totals(items, {"input": given.input_price, "output": given.output_price}).first()
    print(f"{total['items']} fixtures, {total['exact']} exact, {total['failed']} failed, cost {total['cost']:.4f}")
    if given.report:
        report.save_report(stats, given.report)
    missed = report.below(stats, given.min_precision, given.min_recall).orderBy("path").collect()
    for r in missed:
        print(f"below its gate: {r['path']}", file=sys.stderr)
    return 1 if missed or total["failed"] else 0


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="loomfield")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("extract", help="schemas of Python classes as JSON Schema files")
    one.add_argument("files", nargs="+")
    one.add_argument("--out", required=True)
    one.add_argument("--strict", action="store_true", help="warnings are failures")
    one.add_argument("--dialect", default="standard", choices=("standard", "strict"))
    one.set_defaults(run=run_extract)
    two = commands.add_parser("eval", help="a provider's answers to fixtures, scored by field")
    two.add_argument("fixtures")
    two.add_argument("--schema", required=True)
    two.add_argument("--provider", required=True)
    two.add_argument("--report")
    two.add_argument("--min-precision", type=float)
    two.add_argument("--min-recall", type=float)
    two.add_argument("--input-price", type=float, default=0.0, help="of a million tokens")
    two.add_argument("--output-price", type=float, default=0.0, help="of a million tokens")
    two.set_defaults(run=run_eval)
    given = parser.parse_args(arguments)
    return given.run(given)


if __name__ == "__main__":
    sys.exit(main())

"""Command line: ``python -m factloom review --authority DIR --workspace DIR [--format human|json]``; exit 0 clean, 1 findings, 2 otherwise."""

from __future__ import annotations

import argparse
import sys


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="factloom")
    command = parser.add_subparsers(dest="command", required=True).add_parser("review")
    command.add_argument("--authority", required=True)
    command.add_argument("--workspace", required=True)
    command.add_argument("--format", choices=("human", "json"), default="human")
    options = parser.parse_args(arguments)
    from factloom.plans import review as plan
    from factloom.sources import authority

    try:
        facts = authority.read(options.authority)
        from pyspark.sql import SparkSession

        result = plan.review_workspace(SparkSession.builder.getOrCreate(), options.workspace, facts)
    except authority.Rejection as e:
        sys.stdout.write((plan.error_json(e) if options.format == "json" else f"rejected {e.code}: {e.message}") + "\n")
        return 2
    sys.stdout.write((plan.to_json(result) if options.format == "json" else plan.to_text(result)) + "\n")
    return {"clean": 0, "findings": 1}.get(result.disposition, 2)


if __name__ == "__main__":
    sys.exit(main())

"""python -m schemaweave.cli PATH: analyse scripts and print a report; exit code 1 for --cycles with cycles."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from schemaweave.functions import storage
from schemaweave.operators import graph, render
from schemaweave.plans.analysis import analyze
from schemaweave.sources.scripts import from_text, read_scripts


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="schemaweave")
    p.add_argument("path", nargs="?", default="-", help="a file or folder of scripts; - or nothing for standard input")
    p.add_argument("-f", "--format", choices=("text", "dot", "mermaid", "json"), default="text")
    p.add_argument("-o", "--output", help="folder for the result instead of the screen")
    p.add_argument("--impact", help="show what this object depends on and what depends on it")
    p.add_argument("--topo", action="store_true", help="show objects in order of dependency")
    p.add_argument("--cycles", action="store_true", help="show cycles")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    with storage.scope():
        try:
            result = analyze(from_text(spark, sys.stdin.read()) if a.path == "-" else read_scripts(spark, a.path, glob="*"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            print(f"{a.path}: no such file", file=sys.stderr)
            return 1
        code, column = 0, None
        if a.impact:
            out = graph.impact_summary(result.impact(result.scripts.select("script_id", F.lit(a.impact).alias("target"))))
        elif a.topo:
            out = result.topological_order().orderBy("script_id", "position")
        elif a.cycles:
            out = result.cycles().orderBy("script_id", "seq")
            code = int(bool(out.take(1)))
        else:
            column = {"text": "report"}.get(a.format, a.format)
            out = {"text": render.to_text, "dot": render.to_dot, "mermaid": render.to_mermaid, "json": render.to_json}[a.format](result)
        if a.output:
            (out.select(column).write.text if column else out.write.json)(a.output)
        else:
            for row in out.toLocalIterator():
                print(row[column] if column else " ".join(map(str, row)))
            if a.cycles and not code:
                print("No circular dependencies detected.")
        return code


if __name__ == "__main__":
    sys.exit(main())

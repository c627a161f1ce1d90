"""spark-submit entry: `extract` writes the Markdown and HTML of PDF files, `info` prints what is installed."""

from __future__ import annotations

import argparse
import json
import sys

from parchflow.options import ParchflowError, parse_formats


def main(argv: list[str] | None = None) -> int:
    """Exit status: 0 done, 1 failure, 2 wrong options, 3 missing or empty input, 4 corrupt input or existing output, 5 encrypted, 6 no reader, 130 interrupted."""
    p = argparse.ArgumentParser(prog="parchflow")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract")
    e.add_argument("input")
    e.add_argument("-o", "--output", default=".")
    e.add_argument("-f", "--format", action="append")
    e.add_argument("--force-ocr", action="store_true")
    e.add_argument("--dpi", type=int, default=300)
    e.add_argument("--password", default="")
    e.add_argument("--no-overwrite", action="store_true")
    i = sub.add_parser("info")
    i.add_argument("--json", action="store_true")
    i.add_argument("--strict", action="store_true")
    argv = sys.argv[1:] if argv is None else argv
    if argv and argv[0] not in ("extract", "info", "-h", "--help"):
        argv = ["extract", *argv]  # a path alone is extracted
    a = p.parse_args(argv)
    try:
        return _info(a) if a.command == "info" else _extract(a)
    except ParchflowError as x:
        print(x, file=sys.stderr)
        return x.code
    except KeyboardInterrupt:
        return 130


def _info(a: argparse.Namespace) -> int:
    from parchflow.sources.engine import info

    x = info()
    print(json.dumps(x, indent=2, ensure_ascii=False) if a.json else "\n".join(f"{k}: {v}" for k, v in x.items()))
    return 0 if not a.strict or all(x["status"].values()) else 6


def _extract(a: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from parchflow.plans.pipeline import Pipeline
    from parchflow.runtime import cut
    from parchflow.sinks import write_documents
    from parchflow.sources import pdf

    pipeline = Pipeline(force_ocr=a.force_ocr, dpi=a.dpi, formats=parse_formats(a.format))
    spark = SparkSession.builder.appName("parchflow").getOrCreate()
    decoded = pdf.decode_by_strategy(pdf.files(spark, a.input), pipeline.strategies, a.force_ocr, password=a.password, dpi=a.dpi)
    bad = decoded.where("error_code is not null").select("source_path", "error_code", "error")
    for r in bad.toLocalIterator():
        print(f"{r.source_path}: {r.error}", file=sys.stderr)
    done = cut(write_documents(pipeline.run(pdf.tables(decoded)), a.output, pipeline.formats, not a.no_overwrite))
    worst = bad.agg({"error_code": "max"}).first()[0]
    return 4 if done.where("error is not null").limit(1).count() else int(worst or 0)


if __name__ == "__main__":
    sys.exit(main())

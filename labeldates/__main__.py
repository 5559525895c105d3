"""Command line: ``python -m labeldates read|evaluate|compare|validate|power ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .config import Policy
from .operators import evaluation, quality
from .sources import images, tables


def _read(spark: SparkSession, a: argparse.Namespace) -> int:
    from .api import submission_of

    rows = tables.read_csv(spark, a.texts)
    tables.write_csv(submission_of(rows, a.key, a.text, a.crop, Policy.from_env()), a.output, one_file=a.one_file)
    tables.answer_rate(tables.read_csv(spark, a.output, tables.SUBMISSION)).show()
    return 0


def _evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    for frame in evaluation.evaluate(tables.read_csv(spark, a.predictions), tables.read_csv(spark, a.labels)).values():
        frame.show(50, truncate=False)
    return 0


def _compare(spark: SparkSession, a: argparse.Namespace) -> int:
    labels = evaluation.done(evaluation.normalized(tables.read_csv(spark, a.labels), evaluation.BLANK_LABEL))
    runs = []
    for path in (a.before, a.after):
        p = evaluation.normalized(tables.read_csv(spark, path))
        runs.append(evaluation.scored(evaluation.restricted(labels, p, always=True), p, ("batch",)))
        evaluation.by_group(runs[-1], a.show_sealed).show()
    counts = evaluation.paired_counts(evaluation.paired(*runs))
    for r in counts.collect():
        if a.show_sealed or r["grp"] != "F":
            print(f"{r['grp']}: up {r['up']}, down {r['down']}, same {r['same']}, change {100 * (r['change'] or 0):+.2f} points, p = {evaluation.sign_test(r['up'], r['down']):.4f}")
    return 0


def _validate(spark: SparkSession, a: argparse.Namespace) -> int:
    labels = tables.read_csv(spark, f"{a.folder}/labels.csv")
    there = images.scan(spark, f"{a.folder}/images", content=False) if a.images else None
    found = quality.check_labels(labels, there)
    if a.cases:
        cases = quality.check_cases(tables.read_csv(spark, f"{a.folder}/parser_cases.csv"))
        found = found.unionByName(cases.selectExpr("case_id as image_id", "'error' as severity", "rule", "'' as detail"))
    found = found.cache()
    found.groupBy("severity", "rule").count().orderBy("severity", "rule").show(50, truncate=False)
    found.where("severity = 'error'").show(50, truncate=False)
    quality.tag_summary(labels).show(truncate=False)
    return int(quality.has_errors(found))


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="labeldates", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("read", help="texts in a CSV to a submission")
    p.add_argument("texts"), p.add_argument("output"), p.add_argument("--key", default="image_id"), p.add_argument("--text", default="text"), p.add_argument("--crop", action="store_true"), p.add_argument("--one-file", action="store_true")
    p = sub.add_parser("evaluate", help="score predictions against labels")
    p.add_argument("predictions"), p.add_argument("labels")
    p = sub.add_parser("compare", help="score two runs by group, paired")
    p.add_argument("before"), p.add_argument("after"), p.add_argument("labels"), p.add_argument("--show-sealed", action="store_true")
    p = sub.add_parser("validate", help="check a label folder; exit code 1 on errors")
    p.add_argument("folder"), p.add_argument("--images", action="store_true"), p.add_argument("--cases", action="store_true")
    p = sub.add_parser("power", help="smallest effect that n pairs show")
    p.add_argument("n", type=int)
    a = top.parse_args(argv)
    if a.command == "power":
        print(f"{evaluation.least_effect(a.n):.2f} points")
        return 0
    spark = SparkSession.builder.appName("labeldates").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return {"read": _read, "evaluate": _evaluate, "compare": _compare, "validate": _validate}[a.command](spark, a)


if __name__ == "__main__":
    sys.exit(main())

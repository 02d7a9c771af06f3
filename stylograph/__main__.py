"""python -m stylograph: curate a corpus, run the pipeline or a part of it, print summaries."""

from __future__ import annotations

import argparse
import functools

from pyspark.sql import SparkSession

from stylograph.operators import annotate, curate, evaluate, features
from stylograph.plans import pipeline
from stylograph.plans.curation import curate_corpus
from stylograph.sources import sinks
from stylograph.sources.tables import read_csv

#: Rows of the summary that are printed.
SHOWN = 1000


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="stylograph", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    c = commands.add_parser("curate", help="texts and metadata to single-author opinions")
    c.add_argument("--texts", required=True)
    c.add_argument("--meta", required=True)
    c.add_argument("--output", required=True)
    r = commands.add_parser("run", help="load, annotate, features, evaluate")
    r.add_argument("--corpus", help="needed for the stage load")
    r.add_argument("--output", required=True)
    r.add_argument("--from-step", choices=pipeline.STAGES, default="load")
    r.add_argument("--features", nargs="+", choices=features.FEATURE_SETS, default=list(features.FEATURE_SETS))
    r.add_argument("--methods", nargs="+", choices=pipeline.METHODS, default=list(pipeline.METHODS))
    r.add_argument("--min-dissents", type=int, default=5)
    r.add_argument("--model-path", help="UDPipe model for the stage annotate; without it the rule annotator is used")
    s = commands.add_parser("summary", help="counts by author")
    s.add_argument("--corpus", required=True)
    s.add_argument("--min-dissents", type=int, default=5)
    s.add_argument("--output", help="folder for the whole table as CSV; without it the first authors are printed")
    return top.parse_args(argv)


def _read(spark: SparkSession, path: str):
    return read_csv(spark, path) if path.endswith(".csv") else spark.read.parquet(path)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    spark = SparkSession.builder.appName("stylograph").getOrCreate()
    if a.command == "curate":
        made = curate_corpus(_read(spark, a.texts), _read(spark, a.meta))
        made.opinions.write.mode("overwrite").parquet(a.output)
        made.report().show()
    elif a.command == "summary":
        made = curate.author_summary(curate.load_dissents(_read(spark, a.corpus), a.min_dissents)).orderBy("n_dissents", "author", ascending=[False, True])
        if a.output:
            made.write.mode("overwrite").csv(a.output, header=True)
        else:
            made.show(SHOWN, False)
            left = made.count() - SHOWN
            if left > 0:
                print(f"{left} more authors are not shown; --output writes all")
    else:
        corpus = _read(spark, a.corpus) if a.from_step == "load" else None
        p = pipeline.run(spark, corpus, a.output, a.from_step, a.min_dissents, tuple(a.features), tuple(a.methods), annotator=functools.partial(annotate.annotate_udpipe, model_path=a.model_path) if a.model_path else annotate.annotate_rules)
        report = evaluate.class_report(p)
        print(sinks.text_report(evaluate.metrics(p), report, evaluate.averages(report)))
        sinks.write_confusion_json(evaluate.confusion(p), f"{a.output}/confusion_matrices.json")


if __name__ == "__main__":
    main()

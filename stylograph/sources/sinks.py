"""Writers of results: feature CSV, CoNLL-U, confusion JSON, text report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_feature_csv(features: DataFrame, names: list[str], path: str) -> None:
    """doc_id, author and one column for each feature, as a folder of CSV parts with a header."""
    wide = features.select("doc_id", "author", *[F.col("features")[i].alias(n) for i, n in enumerate(names)])
    wide.write.mode("overwrite").csv(path, header=True)


def conllu_texts(documents: DataFrame) -> DataFrame:
    """doc_id and conllu of ``annotate.as_documents``: all tokens, a blank line behind each sentence; empty fields are '_'."""

    def line(t, i):
        filled = [F.when(t[c] == "", "_").otherwise(F.coalesce(t[c], F.lit("_"))) for c in ("form", "lemma", "upos", "xpos", "feats")]
        return F.concat_ws("\t", (i + 1).cast("string"), *filled, *[F.lit("_")] * 4)

    sentences = F.transform("sentences", lambda s: F.concat(F.array_join(F.transform(s, line), "\n"), F.lit("\n\n")))
    return documents.select("doc_id", F.array_join(sentences, "").alias("conllu"))


def write_confusion_json(confusion: DataFrame, path: str) -> None:
    """{method: {labels, matrix, accuracy}}; confusion has method, true, pred, n with zeros filled. Bounded by methods x labels^2."""
    out: dict[str, dict] = {}
    for r in confusion.orderBy("method", "true", "pred").collect():
        m = out.setdefault(r["method"], {"labels": [], "cells": {}})
        m["labels"] = sorted({*m["labels"], r["true"], r["pred"]})
        m["cells"][r["true"], r["pred"]] = r["n"]
    done = {}
    for method, m in out.items():
        matrix = [[m["cells"].get((a, b), 0) for b in m["labels"]] for a in m["labels"]]
        count = sum(map(sum, matrix))
        hit = sum(matrix[i][i] for i in range(len(matrix)))
        done[method] = {"labels": m["labels"], "matrix": matrix, "accuracy": hit / count if count else 0.0}
    with open(path, "w", encoding="utf-8") as f:
        json.dump(done, f, ensure_ascii=False, indent=2)


def text_report(metrics: DataFrame, report: DataFrame, averages: DataFrame | None = None) -> str:
    """Accuracy, rank-3 accuracy, the class table of each method and its averages; one row a method and class, so small."""
    lines = []
    classes = report.orderBy("method", "label").collect()
    means = {r["method"]: r for r in averages.collect()} if averages is not None else {}
    for m in metrics.orderBy("method").collect():
        rank3 = "" if m["rank3_accuracy"] is None else f"  rank-3 {m['rank3_accuracy']:.3f}"
        lines += [f"== {m['method']}", f"accuracy {m['accuracy']:.3f}{rank3}"]
        lines += [f"{r['label']:>40} {r['precision']:.2f} {r['recall']:.2f} {r['f1']:.2f} {r['support']}" for r in classes if r["method"] == m["method"]]
        if m["method"] in means:
            a, n = means[m["method"]], sum(r["support"] for r in classes if r["method"] == m["method"])
            lines.append(f"{'accuracy':>40} {'':4} {'':4} {m['accuracy']:.2f} {n}")
            lines += [f"{kind + ' avg':>40} {a[kind + '_precision']:.2f} {a[kind + '_recall']:.2f} {a[kind + '_f1']:.2f} {n}" for kind in ("macro", "weighted")]
    return "\n".join(lines) + "\n"

"""Metrics over predictions (method, doc_id, author, predicted, rank_of_true)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(p: DataFrame) -> DataFrame:
    """method, n, accuracy and rank3_accuracy; the latter is null for methods that rank nothing."""
    hit = (F.col("predicted").eqNullSafe(F.col("author"))).cast("double")
    top = F.avg(F.when(F.col("rank_of_true") <= 3, 1.0).otherwise(0.0))
    return p.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"), F.when(F.count("rank_of_true") > 0, top).alias("rank3_accuracy"))


def confusion(p: DataFrame) -> DataFrame:
    """method, true, pred, n: every pair of labels of a method, zeros filled. Labels are the true and predicted ones together."""
    rows = p.where(F.col("author").isNotNull() & F.col("predicted").isNotNull())
    counts = rows.groupBy("method", F.col("author").alias("true"), F.col("predicted").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select("method", F.explode(F.array("true", "pred")).alias("l")).distinct()
    cells = labels.withColumnRenamed("l", "true").join(labels.withColumnRenamed("l", "pred"), "method")  # the matrix itself
    return cells.join(counts, ["method", "true", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def confusion_wide(p: DataFrame, labels: list[str]) -> DataFrame:
    """One row for each method and true label, one column for each of the given predicted labels."""
    return p.groupBy("method", F.col("author").alias("true")).pivot("predicted", labels).agg(F.count(F.lit(1))).na.fill(0)


def class_report(p: DataFrame) -> DataFrame:
    """method, label, precision, recall, f1, support for each label; 0 where nothing is divided by."""
    rows = p.where(F.col("author").isNotNull() & F.col("predicted").isNotNull())
    hit = (F.col("author") == F.col("predicted")).cast("long")
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    sides = rows.select("method", F.explode(F.array(F.struct(F.col("author").alias("label"), one.alias("t"), zero.alias("p"), hit.alias("h")), F.struct(F.col("predicted").alias("label"), zero.alias("t"), one.alias("p"), zero.alias("h")))).alias("x")).select("method", "x.*")
    c = sides.groupBy("method", "label").agg(F.sum("t").alias("support"), F.sum("p").alias("npred"), F.sum("h").alias("tp"))
    precision = F.coalesce(F.col("tp") / F.nullif("npred", zero), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif("support", zero), F.lit(0.0))
    c = c.withColumn("precision", precision).withColumn("recall", recall)
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return c.select("method", "label", "precision", "recall", f1.alias("f1"), "support")


def averages(report: DataFrame) -> DataFrame:
    """Macro and support-weighted means of the class report."""
    w = F.sum("support")
    aggs = [F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")] + [F.coalesce(F.sum(F.col(c) * F.col("support")) / F.nullif(w, F.lit(0)), F.lit(0.0)).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return report.groupBy("method").agg(*aggs)

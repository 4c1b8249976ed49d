"""Multi-label quality figures, all relational.

``judged`` has one row per article with the label lists ``truth`` and ``pred``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(part: Column, whole: Column) -> Column:
    """0 when undefined."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def _f1(precision: Column, recall: Column) -> Column:
    return _ratio(2 * precision * recall, precision + recall)


def multilabel_metrics(judged: DataFrame, n_classes: int) -> DataFrame:
    """Subset accuracy and Hamming loss in one aggregate.

    The loss divides by all classes of the vocabulary, also those that never
    occur in ``truth``.
    """
    wrong = (F.size(F.array_except("truth", "pred"))
             + F.size(F.array_except("pred", "truth")))
    return judged.agg(
        F.avg((wrong == 0).cast("double")).alias("subset_accuracy"),
        (F.sum(wrong) / (F.count("*") * n_classes)).alias("hamming_loss"))


def _figures(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({
        "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")),
    })
    return rows.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def classification_report(judged: DataFrame, classes) -> DataFrame:
    """Precision, recall, F1 and support per label and four averages.

    Counts for all labels and the sample averages come from one pass: a row
    holds its own hits per class, and one aggregate without a key sums them.
    """
    sums = []
    for i, name in enumerate(classes):
        in_truth = F.array_contains("truth", name)
        in_pred = F.array_contains("pred", name)
        sums += [F.count_if(in_truth & in_pred).alias(f"tp{i}"),
                 F.count_if(~in_truth & in_pred).alias(f"fp{i}"),
                 F.count_if(in_truth & ~in_pred).alias(f"fn{i}")]
    hits = F.size(F.array_intersect("truth", "pred"))
    precision = _ratio(hits, F.size("pred"))
    recall = _ratio(hits, F.size("truth"))
    sums += [F.avg(precision).alias("sample_precision"),
             F.avg(recall).alias("sample_recall"),
             F.avg(_f1(precision, recall)).alias("sample_f1"),
             F.sum(F.size("truth")).alias("sample_support")]
    totals = judged.agg(*sums)

    # from here on: a handful of rows
    per_class = [F.struct(F.lit(name).alias("label"), F.col(f"tp{i}").alias("tp"),
                          F.col(f"fp{i}").alias("fp"), F.col(f"fn{i}").alias("fn"))
                 for i, name in enumerate(classes)]
    counts = totals.select(F.inline(F.array(*per_class)))
    labels = (_figures(counts).withColumn("support", F.col("tp") + F.col("fn"))
              .select("label", "precision", "recall", "f1", "support"))
    micro = _figures(counts.agg(
        F.lit("micro avg").alias("label"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])).withColumn(
            "support", F.col("tp") + F.col("fn")).select(labels.columns)

    def averaged(name: str, weight: Column) -> DataFrame:
        return labels.agg(
            *[_ratio(F.sum(F.col(c) * weight), F.sum(weight)).alias(c)
              for c in ("precision", "recall", "f1")],
            F.sum("support").alias("support")).select(
                F.lit(name).alias("label"), "precision", "recall", "f1", "support")

    samples = totals.select(
        F.lit("samples avg").alias("label"),
        F.col("sample_precision").alias("precision"),
        F.col("sample_recall").alias("recall"),
        F.col("sample_f1").alias("f1"), F.col("sample_support").alias("support"))
    return (labels.unionByName(micro)
            .unionByName(averaged("macro avg", F.lit(1)))
            .unionByName(averaged("weighted avg", F.col("support")))
            .unionByName(samples))

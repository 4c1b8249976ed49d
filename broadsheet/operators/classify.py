"""Multi-label technique classifier: one linear SVM per label."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import unwrap_udt

from broadsheet import constants as C
from broadsheet.operators import features as feats


# Of a pass of the solver.
TASKS_PER_CORE = 3


@dataclass(frozen=True)
class TechniqueModel:
    """Features and, per class, a trained SVM or the constant it would give."""

    features: PipelineModel | None
    classes: list[str]
    machines: dict[str, LinearSVCModel] = field(default_factory=dict)
    constants: dict[str, int] = field(default_factory=dict)


def train_techniques(labelled: DataFrame, *, tokens: str = "tokens",
                     labels: str = "techniques", size: int = C.MAX_FEATURES,
                     max_iter: int = C.SVM_ITERATIONS, tolerance: float = 1e-4,
                     parallelism: int = 4, classes=None) -> TechniqueModel:
    """Fit on the rows given, which should be the training part only.

    Features are fitted and kept on disk once and shared by all labels, of which at most
    ``parallelism`` train at a time, fewer where their copies would not fit. A label that every row, or none, carries
    needs no machine. Without any label the model is empty and predicts empty
    lists. Pass ``classes`` where they are known, which saves a pass. Tokens and
    labels are made once and cached, as labels, vocabulary and features each read them;
    the scan keeps its partitions.
    """
    prepared = labelled.select(tokens, labels).persist(StorageLevel.DISK_ONLY)
    try:
        return train_prepared(prepared, prepared, tokens=tokens, labels=labels, size=size,
                              max_iter=max_iter, tolerance=tolerance, parallelism=parallelism,
                              classes=classes)
    finally:
        prepared.unpersist()


def train_prepared(labelled: DataFrame, cached: DataFrame, *, tokens: str = "tokens",
                   labels: str = "techniques", size: int = C.MAX_FEATURES,
                   max_iter: int = C.SVM_ITERATIONS, tolerance: float = 1e-4,
                   parallelism: int = 4, classes=None,
                   model: PipelineModel | None = None) -> TechniqueModel:
    """``train_techniques`` on rows of ``cached``, which is released once features are made.

    The solver passes over the features alone, many times. It caches a copy of them for each
    label, so as many labels train at a time as have room in half the executors' memory for
    caches; what does not fit would be read from disk in each pass. A pass is short, so it has
    a few tasks a core, however many parts the rows have. ``model`` is that of the features,
    where it is known.
    """
    if classes is None:
        classes = feats.label_names(labelled, labels)
    if not classes:
        return TechniqueModel(None, [])
    model = model or feats.fit_tfidf(labelled, tokens=tokens, size=size)
    if model is None:
        return TechniqueModel(None, [])
    flags = feats.binarize(F.col(labels), classes)
    rows = (model.transform(labelled).select("features", flags.alias("flags"))
            .persist(StorageLevel.DISK_ONLY))
    try:
        values = F.size(unwrap_udt(F.col("features")).getField("values"))
        counts = rows.agg(F.count("*").alias("n"), F.sum(values).alias("values"), *[
            F.sum(F.get("flags", F.lit(i))).alias(f"c{i}")
            for i in range(len(classes))]).first()
        constants = {name: int(counts[f"c{i}"] > 0) for i, name in enumerate(classes)
                     if counts[f"c{i}"] in (0, counts["n"])}
        cached.unpersist()

        def fit(name: str) -> LinearSVCModel:
            flag = F.get("flags", F.lit(classes.index(name)))
            return LinearSVC(
                maxIter=max_iter, tol=tolerance, regParam=1.0 / counts["n"],
                standardization=False,
            ).fit(rows.select("features", flag.cast("double").alias("label")).coalesce(
                TASKS_PER_CORE * labelled.sparkSession.sparkContext.defaultParallelism))

        varied = [name for name in classes if name not in constants]
        # an index and a value for each entry, and what a row has besides
        copy = 12 * (counts["values"] or 0) + 64 * counts["n"]
        fitting = cache_bytes(labelled.sparkSession) // 2 // max(copy, 1)
        with ThreadPoolExecutor(max_workers=max(1, min(parallelism, fitting))) as pool:
            fitted = pool.map(
                inheritable_thread_target(labelled.sparkSession)(fit), varied)
            machines = dict(zip(varied, fitted))
        return TechniqueModel(model, classes, machines, constants)
    finally:
        rows.unpersist()


def cache_bytes(spark: SparkSession) -> int:
    """What the executors can cache in memory, in all."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().valuesIterator()
    total = 0
    while status.hasNext():
        total += status.next()._1()
    return total


def predict_techniques(articles: DataFrame, model: TechniqueModel, *,
                       output: str = "predicted_techniques") -> DataFrame:
    """Adds the predicted labels in class order. A map over the rows."""
    if model.features is None:
        return articles.withColumn(output, F.array().cast("array<string>"))
    columns = articles.columns
    scored = model.features.transform(articles)
    flags = []
    for i, name in enumerate(model.classes):
        if name in model.constants:
            flags.append(F.lit(model.constants[name]))
            continue
        machine = model.machines[name]
        machine = machine.copy({machine.predictionCol: f"_p{i}",
                                machine.rawPredictionCol: f"_r{i}"})
        scored = machine.transform(scored)
        flags.append(F.col(f"_p{i}").cast("int"))
    found = feats.labels_of(F.array(*flags), model.classes)
    return scored.select(*columns, found.alias(output))


def train_propaganda(labelled: DataFrame, *, tokens: str = "tokens",
                     label: str = "label", buckets: int = 1 << 16,
                     max_iter: int = C.SVM_ITERATIONS, tolerance: float = 1e-4,
                     reg: float = 0.01) -> PipelineModel:
    """Logistic regression on hashed term counts, classes weighted alike.

    Hashing needs no vocabulary pass. The class shares are one aggregate. The
    solver runs to its tolerance over rows cached at the width of the scan.
    """
    seen = labelled.agg(F.avg(F.col(label).cast("double")).alias("share"),
                        F.count("*").alias("n")).first()
    share = 0.5 if seen["share"] is None else seen["share"]
    share = min(max(share, 1e-6), 1 - 1e-6)
    hashed = HashingTF(numFeatures=buckets, inputCol=tokens, outputCol="features")
    weight = F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    rows = (hashed.transform(labelled)
            .select("features", F.col(label).cast("double").alias("label"),
                    weight.alias("weight"))
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        fitted = LogisticRegression(maxIter=max_iter, tol=tolerance, regParam=reg,
                                    weightCol="weight").fit(rows)
    finally:
        rows.unpersist()
    return PipelineModel([hashed, fitted])


def score_propaganda(sentences: DataFrame, model: PipelineModel,
                     *keep: str) -> DataFrame:
    """Label and score of every row of ``tokens``."""
    chance = F.get(vector_to_array("probability"), F.lit(1))
    return model.transform(sentences).select(
        *keep,
        F.when(F.col("prediction") == 1, "Propaganda")
        .otherwise("Non-Propaganda").alias("label"),
        chance.alias("score"))

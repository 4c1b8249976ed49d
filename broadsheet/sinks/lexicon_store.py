"""Owners' term lists as a saved table: a log of changes, and what it comes to.

The log has one row per term of a change: ``owner, seq, kind, pos, term``. ``seq`` orders an
owner's changes. ``add`` puts terms behind the list, ``edit`` replaces the list by its terms
(one row with a NULL term for an empty list), ``reset`` by the built-in list (one row).
Changes are only appended, by named runs, so one that is saved twice counts once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet.functions import text as X
from broadsheet.sinks.outputs import owner_bucket
from broadsheet.sinks.runs import write_run
from broadsheet.sources.lexicons import built_in_terms

LOG = "owner string, seq long, kind string, pos long, term string"
LEXICON = "owner string, seq long, pos long, term string, owner_bucket int"
COLUMNS = ["owner", "seq", "kind", "pos", "term"]


def changes_of(rows: DataFrame, kind: str, terms: str = "terms") -> DataFrame:
    """Log rows of one kind from ``owner, seq`` and a list of terms (not read for a reset)."""
    listed = F.col(terms) if kind != "reset" else F.array().cast("array<string>")
    return rows.select(
        F.col("owner").cast("string"), F.col("seq").cast("long"), F.lit(kind).alias("kind"),
        F.posexplode_outer(listed).alias("pos", "term")).select(
            "owner", "seq", "kind", F.coalesce("pos", F.lit(0)).cast("long").alias("pos"), "term")


def fold_changes(log: DataFrame, built_in: list[str]) -> DataFrame:
    """``owner, seq, pos, term``: every owner's list after all changes.

    The last edit or reset counts, and what was added later. Blank terms are dropped; of
    spellings that differ in case only, the first stays, as ``seq, pos`` say. Bases are
    found by a partial aggregate and joined back, and terms are grouped by owner and term,
    so an owner with a third of the log is spread over its terms. An owner whose list is
    empty has no row. ``built_in`` is the short built-in list.
    """
    bases = log.where("kind IN ('edit', 'reset')").groupBy("owner").agg(
        F.max(F.struct("seq", "kind")).alias("base"))
    rows = log.join(bases, "owner", "left").where(
        F.col("base").isNull() | (F.col("seq") > F.col("base.seq"))
        | ((F.col("seq") == F.col("base.seq")) & (F.col("kind") == F.col("base.kind"))))
    listed = F.col("kind") == "reset"
    standard = F.array(*map(F.lit, built_in)) if built_in else F.array().cast("array<string>")
    resets = rows.where(listed).select("owner", "seq").distinct().select(
        "owner", "seq", F.posexplode(standard).alias("pos", "term")).withColumn(
            "pos", F.col("pos").cast("long"))
    terms = rows.where(~listed).select(
        "owner", "seq", "pos", X.strip_text(F.col("term")).alias("term")).unionByName(resets)
    place = F.struct("seq", "pos")
    return (terms.where(F.col("term") != "").groupBy("owner", F.lower("term").alias("key"))
            .agg(F.min(place).alias("first"), F.min_by("term", place).alias("term"))
            .select("owner", "first.seq", "first.pos", "term"))


def save_changes(changes: DataFrame, path: str, run: str | None = None) -> None:
    """Append changes to the log under ``path``; a run saved again replaces itself."""
    write_run(changes.select(*COLUMNS).withColumn("owner_bucket", owner_bucket(F.col("owner"))),
              f"{path}/log", run, "parquet", "owner_bucket")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, f"{path}/log", f"{LOG}, owner_bucket int, run string").drop("run")


def refresh_lexicons(spark: SparkSession, path: str, changed: DataFrame | None = None) -> None:
    """Fold the log and save the lists; with ``changed(owner)`` only their buckets.

    The folders of the buckets in question are replaced, others are not read or written. A
    bucket that has lost its last term keeps one row without an owner, so that it is
    replaced as well.
    """
    log = read_changes(spark, path)
    if changed is not None:
        buckets = [r.b for r in changed.select(
            owner_bucket(F.col("owner")).alias("b")).distinct().collect()]
        log = log.where(F.col("owner_bucket").isin(buckets))
    lists = fold_changes(log.select(*COLUMNS), built_in_terms()).withColumn(
        "owner_bucket", owner_bucket(F.col("owner")))
    empty = log.select("owner_bucket").distinct().select(
        F.lit(None).cast("string").alias("owner"), F.lit(None).cast("long").alias("seq"),
        F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("term"),
        "owner_bucket")
    salt = F.pmod(F.xxhash64("owner", "term"), F.lit(C.OWNER_BUCKETS // 8 or 1))
    (lists.unionByName(empty).repartition("owner_bucket", salt)
     .sortWithinPartitions("owner_bucket", "owner", "seq", "pos")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("owner_bucket").parquet(f"{path}/current"))


def read_lexicons(spark: SparkSession, path: str, owner: str | None = None) -> DataFrame:
    """The saved lists ``owner, seq, pos, term``; of one owner only its bucket is read."""
    rows = _read(spark, f"{path}/current", LEXICON).where("owner IS NOT NULL")
    if owner is not None:
        rows = rows.where((F.col("owner_bucket") == owner_bucket(F.lit(owner)))
                          & (F.col("owner") == owner))
    return rows.drop("owner_bucket")

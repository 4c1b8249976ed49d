"""Where results go. Appends never read or change what other runs have written."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet import constants as C
from broadsheet import schemas
from broadsheet.operators.history import export_file_names, export_rows, valid_feedback
from broadsheet.sinks.export_files import FORMAT, NAME, ExportFiles
from broadsheet.sinks.runs import write_run


def write_annotated(articles: DataFrame, path: str,
                    partition_by: str | None = None) -> None:
    """The annotated corpus as Parquet; lists stay lists."""
    writer = articles.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def owner_bucket(email, buckets: int = C.OWNER_BUCKETS):
    """The folder of an owner: one of a fixed number, however many owners there are."""
    return F.pmod(F.xxhash64(email), F.lit(buckets)).cast("int")


def append_history(records: DataFrame, path: str, salts: int = 4,
                   run: str | None = None) -> None:
    """Add records to the history table, in folders of owners' hash buckets.

    Reading one owner prunes to its bucket (see ``history_of``) and, as files are
    sorted by owner, to few row groups. Rows are spread over bucket and a salt, so
    a batch adds at most ``salts`` files to a folder and one busy owner is no single
    task. Nothing of other runs is rewritten, so concurrent saves cannot lose each
    other's rows, and a batch saved again under the same ``run`` replaces itself.
    """
    by_name = {field.name: field.dataType for field in schemas.ANALYSIS.fields}
    columns = [_conform(F.col(name), records.schema[name].dataType, kind).alias(name)
               for name, kind in by_name.items()]
    salt = F.pmod(F.xxhash64("title", "date", "text"), F.lit(salts))
    rows = (records.select(*columns).withColumn("owner_bucket", owner_bucket(F.col("email")))
            .repartition("owner_bucket", salt).sortWithinPartitions("owner_bucket", "email"))
    write_run(rows, path, run, "parquet", "owner_bucket")


def _conform(column, have: T.DataType, want: T.DataType):
    """Fill the fields a nested list lacks, so all files share one schema."""
    if have == want or not isinstance(want, T.ArrayType):
        return column.cast(want)
    if not isinstance(want.elementType, T.StructType):
        return column.cast(want)
    present = set(have.elementType.names)
    return F.transform(column, lambda item: F.struct(*[
        (item[f.name] if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in want.elementType.fields]))


def append_feedback(entries: DataFrame, path: str, run: str | None = None) -> None:
    """Add feedback rows with some text as JSON lines: email, timestamp, feedback.

    Entries without a timestamp get that of the batch. A batch saved again under the same
    ``run`` replaces itself.
    """
    if "timestamp" not in entries.columns:
        entries = entries.withColumn("timestamp", F.current_timestamp())
    rows = valid_feedback(entries).withColumn(
        "timestamp", F.coalesce("timestamp", F.current_timestamp()))
    write_run(rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.FEEDBACK.fields]),
              path, run, "json")


def write_export(history: DataFrame, path: str) -> None:
    """The CSV export: header, quotes doubled, UTF-8."""
    (export_rows(history).drop("file_name").write.mode("overwrite")
     .option("header", True).option("escape", '"').option("encoding", "UTF-8")
     .csv(path))


def write_export_files(history: DataFrame, path: str, *tie_break: str) -> None:
    """One CSV file for each analysis, named after its title (see ``export_file_names``).

    The folder is one that all executors share. Saving the same records again gives the
    same files; files of other records with other names stay.
    """
    named = export_file_names(history, *tie_break)
    rows = export_rows(named, F.col(NAME).alias("_file")).drop("file_name")
    texts = rows.select(*[F.col(c).cast("string") for c in rows.columns if c != "_file"],
                        F.col("_file").alias(NAME))
    history.sparkSession.dataSource.register(ExportFiles)
    texts.write.format(FORMAT).mode("append").save(path)


def report_html(summary) -> str:
    """The report page, a table of figures, from the one row of ``report_summary``."""
    flagged, other = summary["propaganda_articles"], summary["other_articles"]
    share = f"{100 * flagged / (flagged + other):.1f} %" if flagged + other else "none"
    figures = [("articles", flagged + other), ("with a technique", flagged),
               ("without one", other), ("share with one", share)]
    rows = "".join(f"<tr><td>{name}</td><td>{value}</td></tr>" for name, value in figures)
    topics = "".join(f"<li>{escape(line)}</li>" for line in summary["topics_html"].split("<br>"))
    title = escape(C.REPORT_TITLE)
    return (f"<!doctype html><html lang='en'><title>{title}</title><body><h1>{title}</h1>"
            f"<table>{rows}</table><ul>{topics}</ul></body></html>")


def write_report(spark: SparkSession, summary: DataFrame, path: str) -> None:
    """Write the page as a one-row text table, so any file system will do."""
    page = report_html(summary.first())
    (spark.createDataFrame([(page,)], "value string").coalesce(1)
     .write.mode("overwrite").text(path))

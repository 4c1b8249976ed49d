"""Article corpora: JSON or Parquet in, canonical article columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet import schemas
from broadsheet.functions.text import strip_text
from broadsheet.sources.json_elements import read_json_elements


def read_json_array(spark: SparkSession, path, schema: T.StructType | None = None,
                    lines: bool = False) -> DataFrame:
    """A corpus file. One JSON array per file, or ``lines``.

    With a ``schema`` a file is read by as many tasks as it has splits, whatever its
    form. To find out the schema, a file holding one array is read by one task.
    """
    if schema is not None and not lines:
        return read_json_elements(spark, path, schema)
    reader = spark.read.option("multiLine", not lines).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def _quoted(path: tuple[str, ...]) -> str:
    return ".".join(f"`{name}`" for name in path)


def _leaves(schema: T.StructType, prefix: tuple[str, ...] = ()):
    for field in schema.fields:
        path = (*prefix, field.name)
        if isinstance(field.dataType, T.StructType):
            yield from _leaves(field.dataType, path)
        else:
            yield path


def flatten(rows: DataFrame) -> DataFrame:
    """Struct leaves become columns with dotted names; lists stay lists."""
    return rows.select(*[F.col(_quoted(path)).alias(".".join(path))
                         for path in _leaves(rows.schema)])


def reconcile_content(rows: DataFrame) -> DataFrame:
    """``Title`` stands in for a missing ``content`` column; one must exist."""
    if "content" in rows.columns:
        return rows
    if "Title" in rows.columns:
        return rows.withColumnRenamed("Title", "content")
    raise ValueError("a corpus needs a 'content' or a 'Title' column")


def with_missing_columns(rows: DataFrame,
                         schema: T.StructType = schemas.ARTICLES) -> DataFrame:
    """Add the columns of ``schema`` that are absent, as NULL."""
    return rows.withColumns({
        field.name: F.lit(None).cast(field.dataType)
        for field in schema.fields if field.name not in rows.columns})


def read_corpus(spark: SparkSession, path, schema: T.StructType | None = None,
                lines: bool = False) -> DataFrame:
    """Read, flatten and reconcile in one step."""
    return reconcile_content(flatten(read_json_array(spark, path, schema, lines)))


def pasted_articles(rows: DataFrame, text: str) -> DataFrame:
    """Any table with a text column as articles; the text is stripped."""
    return rows.withColumn("content", strip_text(F.col(text))).drop(
        *([text] if text != "content" else []))

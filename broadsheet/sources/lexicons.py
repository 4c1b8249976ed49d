"""Term lists: the built-in ones and per-owner ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet import constants as C
from broadsheet import schemas
from broadsheet.operators.unnest import unnest

VERSIONS = {"default": C.DEFAULT_BIAS_TERMS, "extended": C.EXTENDED_BIAS_TERMS}


def built_in_terms(version: str = "default") -> list[str]:
    """Lower-cased, without repeats, in list order."""
    return list(dict.fromkeys(term.lower() for term in VERSIONS[version]))


def built_in_lexicon(spark: SparkSession, version: str = "default") -> DataFrame:
    rows = [(version, pos, term) for pos, term in enumerate(built_in_terms(version))]
    return spark.createDataFrame(rows, "version string, pos int, term string")


def explode_terms(rows: DataFrame, owner: str, terms: str) -> DataFrame:
    """``(owner, pos, term)`` from one list per owner."""
    return unnest(rows, terms, F.col(owner).alias("owner"), pos="pos", value="term")


def read_user_lexicons(spark: SparkSession, path) -> DataFrame:
    """Per-user lists from an account file.

    The schema names only the user and the list, so password hashes in the
    file are never read into a column.
    """
    users = (spark.read.schema(schemas.USER_LEXICON_FILE)
             .option("multiLine", True).json(path))
    return explode_terms(users, "username", "bias_terms")

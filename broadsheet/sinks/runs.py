"""Appends that may be repeated: every batch has a name, and writing it again replaces it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_name(run: str | None) -> str:
    """A name safe as a folder; a new one where the caller gives none."""
    return re.sub(r"[^A-Za-z0-9_.-]", "_", run) if run else uuid.uuid4().hex


def write_run(rows: DataFrame, path: str, run: str | None, kind: str, *keys: str) -> None:
    """Adds ``rows`` in folders of ``keys`` and the run; nothing of other runs is touched.

    Only folders of this run are replaced, when the whole job has succeeded, so a job that
    is tried again, after a lost driver too, leaves its rows once. A batch must be the same
    each time: a folder that only the first try had would stay.
    """
    (rows.withColumn("run", F.lit(run_name(run))).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*keys, "run")
     .format(kind).save(path))

"""Session settings the operators expect."""

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "broadsheet", master: str | None = None,
                  **overrides: str) -> SparkSession:
    """Get a session with the settings above; ``overrides`` win.

    No checkpoint folder is set here: on a cluster it comes from
    ``spark.checkpoint.dir``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def short_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Batches of fewer rows and bytes for this session, as texts and sets may be long.

    An Arrow batch is held several times over, by the JVM and by Python, and the Parquet
    reader holds a batch of every column; smaller settings of the user's stay.
    """
    for name, default, most in (("execution.arrow.maxRecordsPerBatch", "10000", rows),
                                ("execution.arrow.maxBytesPerBatch", "2147483647", size),
                                ("parquet.columnarReaderBatchSize", "4096", rows)):
        name = f"spark.sql.{name}"
        if not 0 < int(spark.conf.get(name, default).rstrip("b")) <= most:
            spark.conf.set(name, str(most))

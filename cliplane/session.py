"""The session that the engine expects: UTC clock and adaptive execution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "cliplane", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in {**base, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where the session names none, a temporary one is made if the master is local; on
    a cluster that is an error, since executors wouldn't see it.
    """
    import tempfile

    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or tempfile.mkdtemp(prefix="cliplane-")).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and Spark knows the size of what follows."""
    import uuid

    path = f"{shared_dir(df.sparkSession)}/cliplane/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

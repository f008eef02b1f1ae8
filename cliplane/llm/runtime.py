"""Shared folder, package shipping and lineage cuts for the operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a folder of our own is made if the master is local
    (tests on one machine); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="cliplane-"))
    return _own_dir[0]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts lineage (a lost executor costs no recomputation) and gives the
    optimizer the true size of what follows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cliplane/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles that nothing refers to any more.

    It does so when the driver's collectors have seen that, which may take long on a driver with little to
    do; after a table has been written, what led to it needs no disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BUCKET_BYTES = 64 << 20
MOST_BUCKETS = 100_000  # that Spark allows
UNKNOWN = 1 << 60


def buckets_for(df: DataFrame) -> int:
    """A multiple of the shuffle partitions, so many that a bucket of ``df``'s input is of about BUCKET_BYTES."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    # Rows that are no files have no size that Spark knows; it says the largest there is.
    size = sum(x for x in sizes if x < UNKNOWN)
    return min(-(-size // (BUCKET_BYTES * partitions)) * partitions or partitions, max(MOST_BUCKETS // partitions, 1) * partitions)


def bucketed(df: DataFrame, keys: list[str], name: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, dealt out and sorted by ``keys``, and read it back.

    Joins by these keys then read it where it lies, without another exchange. With as many buckets as
    shuffle partitions, or a multiple, what comes out of a shuffle by ``keys`` gives one file for
    each. The catalog entry that Spark needs to write buckets goes at once; the rows that are read
    know their files.
    """
    spark = df.sparkSession
    table = f"cliplane_{name}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(spark)}/cliplane/{table}")
    writer.bucketBy(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortBy(*keys).saveAsTable(table)
    rows = spark.table(table).select("*")
    rows._jdf.queryExecution().optimizedPlan()
    spark.sql(f"DROP TABLE {table}")
    return rows


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="cliplane-")) / "cliplane_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for p in sorted([root / "__init__.py", *(root / "llm").rglob("*.py")]):
            out.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

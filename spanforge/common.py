"""Session helpers shared by every operator: table scan, lineage cut, bounded broadcast, code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table of a data directory (columns and filters are pruned by the reader)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: spark.checkpoint.dir, or one of our own where it is unset (tests, local mode)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        path = tempfile.mkdtemp(prefix="spanforge-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
        path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return path


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage with a written table in the shared folder; survives the loss of any executor.  The shuffle files of the write go with its end."""
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    was = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """The frame written once, with a broadcast hint if a count proves at most max_rows rows; larger ones are left to a shuffle."""
    df = materialise(df, "small")
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors of a cluster (no-op in local mode)."""
    app = spark.sparkContext.applicationId
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local" or app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="spanforge-zip-"), "spanforge_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(Path("spanforge") / p.relative_to(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def partitions(df: DataFrame, floor: int = 0) -> int:
    """Shuffle parallelism of the session, at least floor."""
    return max(floor, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

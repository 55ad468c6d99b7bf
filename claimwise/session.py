"""Session builder and cluster-aware helpers.

Correctness of every plan in this package does not depend on these settings
(no session-time-zone-dependent expression is used); they tune execution.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

# Shuffle partition count and file split size for a cluster run.  At ~100 TB
# of claims input, 128 MB splits give ~800k scan tasks; shuffle partitions are
# left to AQE coalescing starting from a high ceiling.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "claimwise", extra: dict | None = None) -> SparkSession:
    """Local/test session builder.  On a cluster, pass master=None and let
    spark-submit provide it."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(CLUSTER_CONF)
    conf.update({
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    })
    if shuffle_partitions:          # else Spark's own default (200), which AQE coalesces
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``; one of our own only in local mode with none set
    (tests).  On a cluster an unset folder is an error: executors would each
    write to their own disk."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local") or "local-cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="claimwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never a machine-local
    temp folder) for written intermediate tables and streaming checkpoints."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/claimwise/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, rows_a_file: int = 0, codec: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: later steps share
    its rows, and a lost executor recomputes from there.  ``rows_a_file``: at most so many;
    ``codec``: the session's without."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def conf_set(spark: SparkSession, **values) -> Iterator[None]:
    """Session settings ``spark.sql.<key with __ for .>`` for the jobs inside, then as they were."""
    keys = {f"spark.sql.{k.replace('__', '.')}": str(v) for k, v in values.items()}
    was = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def wide_rows(spark: SparkSession):
    """For jobs over very wide expressions (the feature stages): as one generated method they go beyond
    what HotSpot compiles (8,000 bytes) and run interpreted; below this limit Spark splits them up."""
    return conf_set(spark, codegen__hugeMethodLimit=8000)

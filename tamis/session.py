"""Spark session helpers.

The library never creates a session behind the caller's back; these helpers
exist for tests, the benchmark and command-line use.  On a cluster the
checkpoint directory comes from ``spark.checkpoint.dir`` (a shared folder the
cluster names); a private folder is only chosen when that setting is unset,
as in local tests.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tamis", memory: str = "16g") -> SparkSession:
    """A local session configured like the tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    in a local session (tests) a private folder is created and registered.  On a
    cluster a private folder would exist on one machine only, so that is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tamis-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: its lineage ends there.

    Against ``checkpoint`` the rows are computed once (a checkpoint of a frame computes its last stage
    for the action and again for the files), a reader takes only the columns it
    needs, and the size of the files is known when a join is planned.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cluster_settings(input_tb: float = 100.0, executors: int = 1000, cores_per_executor: int = 4) -> dict[str, str]:
    """Runtime settings for a large cluster (applied with ``apply_settings``).

    * shuffle partitions start high (about 256 MB of shuffle data per task for
      the largest shuffle, at least three per core, capped at 100,000 so the
      map-output bookkeeping stays small) and AQE coalesces the small ones;
    * scans read 256 MB splits;
    * AQE splits skewed join partitions (a key holding a third of the rows is
      cut into advisory-size pieces) and turns joins with a small measured
      side into broadcast joins at run time; the static broadcast threshold
      stays modest, so nothing large is ever broadcast on an estimate.
    """
    cores = executors * cores_per_executor
    shuffle_bytes = input_tb * (1 << 40) * 0.3          # projected columns of the widest shuffle
    partitions = min(max(cores * 3, int(shuffle_bytes // (256 << 20))), 100_000)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
    }


def apply_settings(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """Apply runtime SQL settings to an existing session."""
    for k, v in settings.items():
        spark.conf.set(k, v)
    return spark

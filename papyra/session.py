"""Session construction and the few session-level settings the engine relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every plan in this package assumes.  Timestamps are naive UTC; AQE
# re-plans joins and coalesces small shuffles; Arrow carries batches to the
# vector kernels.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    # a per-task partial top-k before the shuffle, whatever the limit
    "spark.sql.optimizer.windowGroupLimitThreshold": str(2**31 - 1),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "papyra", extra: dict | None = None) -> SparkSession:
    """A session for tests, the bench and local runs.

    On a cluster, callers pass their own session; operators only read
    settings from it and never assume local mode.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in {**ENGINE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_engine_conf(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``papyra`` importable in Python workers: zip the package once per
    SparkContext and add it with ``addPyFile`` (the driver serves it to every
    executor).  Kernels run inside tasks and reference package functions."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    import zipfile
    from pathlib import Path
    pkg = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="papyra-pkg-")) / "papyra.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in pkg.rglob("*.py"):
            z.write(f, f.relative_to(pkg.parent).as_posix())
    sc.addPyFile(str(out))
    _SHIPPED.add(key)


def apply_engine_conf(spark: SparkSession) -> None:
    """What a query needs of a session that it did not build: naive UTC times
    and the package on the Python workers.  All other settings stay the caller's."""
    ship_package(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local master may go without: then a temporary folder is made."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="papyra-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: Spark then knows its size and
    broadcasts it where it is small."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

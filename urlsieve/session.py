"""Spark session and shared-folder helpers.

Jobs never pick a machine-local folder on a cluster: every path they write
(lineage cuts, stream checkpoints, job outputs) lives under the folder the
cluster names in ``spark.checkpoint.dir``.  Only a local-mode session without
that setting (tests, the bench) gets a fresh folder under ``/tmp``.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "urlsieve", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench.  A cluster job gets its session from
    spark-submit and only needs :data:`DEFAULT_CONF` there."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and job outputs.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint
    dir).  When it is unset, a local session gets a fresh ``/tmp`` folder; a
    cluster session fails loudly, as a node-local folder would lose data when
    an executor goes away.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if d:
            sc.setCheckpointDir(d)
            d = sc.getCheckpointDir() or d
    if not d:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/S3/...) for this job")
        d = tempfile.mkdtemp(prefix="urlsieve-ckpt-", dir="/tmp")
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the shared folder (one per run, never reused)."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, survives
    executor loss, read column by column, and of a size Spark knows."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[int] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``urlsieve`` importable in Python workers (for mapInPandas
    stages): zip the package into the shared folder and ``addPyFile`` it,
    once per SparkContext.  Skipped when the workers already import it
    (e.g. the package is installed on the cluster image)."""
    import zipfile

    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED:
        return
    base = shared_dir(spark)
    if not base.startswith(("file:", "/")):
        # cluster: the package travels with spark-submit --py-files (or the image)
        _SHIPPED.add(key)
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    zpath = re.sub("^file:(//)?(?=/)", "", fresh_path(spark, "urlsieve-pkg")) + ".zip"
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)

"""Materialisation: a result is written once, under a digest of its stage and parameters or for this run only, and read afterwards."""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def stage_key(stage: str, params: dict, parent: str | None = None, version: int = 1) -> str:
    """Digest of stage, version, every parameter (in canonical JSON) and the parent's key."""
    body = json.dumps({"stage": stage, "version": version, "params": params, "parent": parent}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(body.encode()).hexdigest()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def resolve(spark: SparkSession, root: str, key: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table of key under root, computed and committed if it isn't there whole; a failed run leaves nothing that counts."""
    path = f"{root}/{key[:2]}/{key}"
    fs, done = _fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        compute().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only where that is unset and all runs in one JVM."""
    master = spark.sparkContext.master
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tactus_"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later steps that use it several times don't compute it again, and lost executors cost only what follows. Removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)

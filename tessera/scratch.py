"""Folders for tables that a job writes for itself, in the store that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a session whose executors are on this machine may go without."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _path(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def application_dir(spark: SparkSession) -> str:
    """This application's own folder there. It is deleted when the driver's JVM ends: what is in it can't be read later."""
    context = spark.sparkContext
    folder = f"{shared_dir(spark)}/tessera-{context.applicationId}"
    if getattr(context, "_tessera_folder", None) != folder:
        fs, at = _path(spark, folder)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        context._tessera_folder = folder
    return folder


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{application_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    for p in paths:
        fs, at = _path(spark, p)
        fs.delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, at = _path(spark, source)
    if not fs.rename(at, _path(spark, target)[1]):
        raise OSError(f"{source} could not be moved to {target}")


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)

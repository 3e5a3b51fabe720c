"""Session settings and the shared folder for data that must outlive a task."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply the settings the operators are planned for."""
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A machine-local folder is made only for a local master with nothing set.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current.rsplit("/", 1)[0]
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder shared by all executors.")
    folder = tempfile.mkdtemp(prefix="tribunal-")
    context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, stem: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Materialise to the shared folder and cut the lineage.

    Used where a value must not change when a lost task is run again, such as
    range boundaries that come from a sample.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers import this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    stem = os.path.join(tempfile.mkdtemp(prefix="tribunal-code-"), "tribunal")
    context.addPyFile(shutil.make_archive(stem, "zip", root, "tribunal"))
    _shipped.add(context.applicationId)

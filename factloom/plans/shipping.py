"""Sending the package to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Send the package to the workers once a session, so that they need no path of this machine; the driver serves the archive."""
    context = spark.sparkContext
    if getattr(context, "_factloom_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="factloom-"), "factloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    context._factloom_shipped = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    It is the one the cluster names in ``spark.checkpoint.dir``.  A local session without one takes a temporary folder; any other session without
    one is an error, as executors would each write to a folder of their own machine.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if folder is None and context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factloom-"))
    return context.getCheckpointDir()


def checkpointed(frame: DataFrame) -> DataFrame:
    """Write rows that several branches read to the shared checkpoint folder, and cut their lineage."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def written(frame: DataFrame) -> DataFrame:
    """The same as a Parquet table in that folder: branches that read a few columns or kinds of rows of a wide table read only those."""
    path = f"{checkpoint_folder(frame.sparkSession)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)

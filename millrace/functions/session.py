"""Session plumbing: shipping this package to executors, the shared folder, files of any store."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    target = os.path.join(tempfile.mkdtemp(), f"{name}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, files in os.walk(root):
            for file in files:
                if file.endswith(".py"):
                    path = os.path.join(folder, file)
                    archive.write(path, os.path.join(name, os.path.relpath(path, root)))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir or, in local mode alone, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "millrace-scratch")
    return folder.rstrip("/")


def files_of(spark: SparkSession, folder: str) -> tuple:
    """The file system of a folder, and what makes its paths."""
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    path = jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path  # noqa: SLF001

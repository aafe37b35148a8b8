"""Folders for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: The scratch folder of each application.
_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where that is unset: a local one if the master is local, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's scratch folder, which the file system deletes when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        folder = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        where = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        where.mkdirs(target)
        where.deleteOnExit(target)
        _FOLDERS[app] = folder
    return f"{_FOLDERS[app]}/{tag}-{uuid.uuid4().hex}"

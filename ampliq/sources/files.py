"""Files that tasks open by themselves, and the folder that all machines share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, s3, gs ...) and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files below a folder whose names have the ending, in order; hidden ones and markers are left out."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(at, recursive=True)) if x.is_file and x.path.endswith(ending)]
    return sorted((x.path, x.size) for x in found if info.is_file or not x.base_name.startswith((".", "_")))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only where that is unset and all is one process (tests), a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: files must go to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ampliq-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/ampliq/files-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: for what several branches of a plan use, and for ending its lineage."""
    path = f"{shared_folder(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Where intermediate tables are cut off from their lineage.

A cluster names a shared folder in ``spark.checkpoint.dir``; that setting is
taken as it is.  Only where it is unset on one machine (tests, a laptop) a local
folder is used; elsewhere a missing setting is an error, since executors would
write to disks that others can't read.
"""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"

#: Per thread, the paths that ``settled`` watches.
_WATCH = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can read and write."""
    conf = spark.sparkContext.getConf()
    given = conf.get(_KEY) or spark.conf.get(_KEY, None)
    if given:
        return given
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"{_KEY} must name a folder that all executors share (master {master})")
    return "file://" + os.path.join(tempfile.gettempdir(), "docmill-shared")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path of its own under the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    for paths in getattr(_WATCH, "lists", ()):
        paths.append(path)
    return path


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a Parquet table under the shared folder, and read from
    there without lineage.

    The files outlive executors, so nothing before the cut has to be computed
    again when one is lost; they are smaller than a checkpoint's, and only the
    columns in use are read.  They stay until they are discarded or the folder is
    cleaned."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._docmill_path = path
    return table


def settled(make: Callable[[], DataFrame], what: str) -> DataFrame:
    """What ``make`` gives, saved; then the tables are deleted that it saved on
    the way, since the result doesn't read them any more."""
    paths: list[str] = []
    _WATCH.lists = [*getattr(_WATCH, "lists", ()), paths]
    try:
        table = saved(make(), what)
    finally:
        _WATCH.lists = _WATCH.lists[:-1]
    for path in paths:
        if path != table._docmill_path:
            remove(table.sparkSession, path)
    return table


def discard(*tables: DataFrame) -> None:
    """Delete the files of saved tables that nothing will read any more."""
    for table in tables:
        remove(table.sparkSession, table._docmill_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``fresh_path`` named, wherever it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

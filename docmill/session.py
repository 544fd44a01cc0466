"""Sessions: settings for one machine, and this package on the executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session on this machine; a cluster brings its own."""
    settings = {
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("docmill")
    return builder.config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package's source to the Python workers of all executors, once
    for each Spark context.  Spark's own file server hands it out, so it works
    wherever the driver was started and whatever is installed on the workers."""
    context = spark.sparkContext
    if getattr(context, "_docmill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="docmill-")) / "docmill.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._docmill_shipped = True


def shared_path(spark: SparkSession, what: str) -> str:
    """A path of its own in the folder that the driver and all executors share,
    which a cluster names in ``spark.checkpoint.dir``; without it a local session
    gets one of this machine, any other an error."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = f"file://{tempfile.gettempdir()}/docmill-shared"
    return f"{given.rstrip('/')}/{what}-{uuid.uuid4().hex}"

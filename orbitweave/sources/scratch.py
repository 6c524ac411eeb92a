"""The folder that the driver and all executors share, for intermediate tables and files that are written and read again."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a folder of this process where it is unset and the master is local.

    A cluster's executors could not share the latter, so there an unset folder is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="orbitweave-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nobody has used."""
    return f"{shared_dir(spark)}/orbitweave/{label}-{uuid.uuid4().hex}"

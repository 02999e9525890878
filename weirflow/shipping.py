"""What executors need: this package, wherever the driver found it, and a shared folder."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: A local session's own folder, by application.
_own_folders: dict[str, str] = {}
#: Bytes of a batch that Spark hands to Python, where the session names no limit of its own: rows
#: can be long texts, and both the JVM and the worker hold a whole batch.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a session on this machine alone gets a temporary folder; on a
    cluster there is no folder to fall back on.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: intermediate tables are written there")
        own = spark.sparkContext.applicationId
        if own not in _own_folders:
            _own_folders[own] = tempfile.mkdtemp(prefix="weirflow-")
            atexit.register(shutil.rmtree, _own_folders[own], ignore_errors=True)
        root = _own_folders[own]
    return root.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Add the package to the context's Python files, once per application, and bound the
    session's batches."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(here)
    folder = tempfile.mkdtemp(prefix="ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # Spark serves the file from there
    path = os.path.join(folder, f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, here)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)

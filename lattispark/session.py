"""Session helpers: a tuned local session and shipping of this package to executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import weakref
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: "weakref.WeakSet" = weakref.WeakSet()


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A single-node session for tests and benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lattispark")
    settings = {
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.sql.python.filterPushdown.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark context.

    Functions that run in Python workers are pickled by reference, so the workers
    must be able to import the package.
    """
    context = spark.sparkContext
    if context in _shipped:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        staged = Path(folder, "tree", root.name)
        shutil.copytree(root, staged, ignore=shutil.ignore_patterns("__pycache__"))
        archive = shutil.make_archive(os.path.join(folder, root.name), "zip", staged.parent)
        kept = Path(tempfile.mkdtemp(prefix="lattispark-"), f"{root.name}.zip")
        shutil.copy(archive, kept)
    context.addPyFile(str(kept))
    _shipped.add(context)

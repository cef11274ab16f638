"""Sessions, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def build(app: str = "hearthframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tested under: UTC, ANSI and adaptive execution on."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", "spark.cleaner.referenceTracking.cleanCheckpoints": "true"}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package, once a context.

    The zip goes through ``addPyFile``, so executors fetch it from the driver and a new
    executor, after a loss, fetches it again.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "hearthframe_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master, as in tests, may do without the setting; it gets one folder a context."""
    context = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if told:
        return told
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(context.applicationId, tempfile.mkdtemp(prefix="checkpoints_", dir=os.environ.get("TMPDIR")))


def checkpoint_ready(spark: SparkSession) -> None:
    """Makes ``checkpoint()`` usable."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the file system that its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

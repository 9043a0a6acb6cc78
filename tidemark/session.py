"""Session set-up and the folder that all executors share."""

from __future__ import annotations

import atexit
import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_MARK = "spark.tidemark.shipped"


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in one process.

    A cluster names a folder that every executor sees, and it is an error if it
    doesn't.  Tests on one machine leave the setting empty and get a folder of
    their own.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.tidemark.shared", None)
        if not named:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
            named = "file://" + tempfile.mkdtemp(prefix="tidemark-")
            spark.conf.set("spark.tidemark.shared", named)
            _to_delete(spark, named)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


_made: dict[str, tuple] = {}


def _to_delete(spark: SparkSession, path: str) -> None:
    _made[path] = filesystem(spark, path)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path for a table in the shared folder; deleted when the driver ends, if ``discard`` hasn't done so before."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _to_delete(spark, path)
    return path


def discard(*paths: str) -> None:
    """Delete scratch paths that nothing reads any more."""
    for p in paths:
        if (known := _made.pop(p, None)) is not None:
            try:
                known[0].delete(known[1], True)
            except Exception:  # noqa: BLE001 - the JVM may be gone
                pass


@atexit.register
def _discard_all() -> None:
    discard(*list(_made))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each session, through the shared folder."""
    if spark.conf.get(_MARK, None) == spark.sparkContext.applicationId:
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    target = scratch(spark, "tidemark") + ".zip"
    fs, path = filesystem(spark, target)
    out = fs.create(path)
    out.write(bytearray(packed.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(target)
    spark.conf.set(_MARK, spark.sparkContext.applicationId)

"""Sessions: sending this package's code to the executors, and the settings that the engine expects."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
#: Folders by application, where the session names none: tests and single machines.
_OWN: dict[str, str] = {}
#: Paths written below the shared folder, by application.
_WRITTEN: dict[str, list[str]] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package's modules, once per application, so that they need no installation of it."""
    context = spark.sparkContext
    mark = "veridact_shipped"
    if not getattr(context, mark, False):
        target = os.path.join(tempfile.mkdtemp(prefix="veridact-"), "veridact.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(_ROOT.rglob("*.py")):
                z.write(p, p.relative_to(_ROOT.parent))
        context.addPyFile(target)
        setattr(context, mark, True)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the session's ``spark.checkpoint.dir`` names it.

    Where it names none, a local master gets a temporary folder of this application; any other is refused, since executors would write
    to disks of their own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        path = _OWN[name] if name in _OWN else _OWN.setdefault(name, tempfile.mkdtemp(prefix="veridact-"))
    return path.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder, remembered for :func:`discard`."""
    path = f"{shared_dir(spark)}/veridact-{tag}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage."""
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Delete what this application wrote to the shared folder; how many paths. Results that still read them are lost."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    return len(paths)

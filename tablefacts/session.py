"""Session settings and the shared folder of a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Looking up the calling line for every column expression triples the time it takes
    # to put a large plan together.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


#: Folders handed out in each open scope of ``temporary_folders``, the innermost last.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("folders", default=())


def configure(builder: SparkSession.Builder, cores: int | None = None) -> SparkSession.Builder:
    """Apply the settings the operators are written for.

    Given the cores of the cluster, shuffles start with three partitions per core, which
    adaptive execution then merges to a useful size; groupings of billions of keys need
    that many, and small ones end up with few."""
    settings = dict(SETTINGS)
    if cores:
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(3 * cores)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one named in ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder;
    on a cluster a machine-local folder would not be seen by the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all machines share")
        root = tempfile.mkdtemp(prefix="tablefacts-")
    folder = f"{root.rstrip('/')}/tablefacts-{uuid.uuid4().hex}"
    if _scopes.get():
        _scopes.get()[-1].append(folder)
    return folder


@contextmanager
def temporary_folders(spark: SparkSession) -> Iterator[None]:
    """A scope at whose end the folders handed out in it go, parsed text grids above all.
    Frames that read them can't be used any more; land what is to stay in a folder of its own."""
    folders: list[str] = []
    token = _scopes.set((*_scopes.get(), folders))
    try:
        yield
    finally:
        _scopes.reset(token)
        for folder in folders:
            place = spark._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

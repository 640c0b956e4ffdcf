"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8, name: str = "strandwork", checkpoints: str | None = None) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STRANDWORK_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return (builder.config("spark.checkpoint.dir", checkpoints) if checkpoints else builder).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, unless their Python finds it by itself.

    It does where the package's folder is in PYTHONPATH or is the working folder.
    """
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and Path(p).resolve() == root.parent for p in known) or "strandwork-package.zip" in context._python_includes:
        return
    place = os.path.realpath(tempfile.mkdtemp())
    atexit.register(shutil.rmtree, place, ignore_errors=True)
    path = f"{place}/strandwork-package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``.

    Where the session sets none, it is the context's checkpoint folder, and for a local master (tests) else one under the
    warehouse; a cluster without one is an error, as executors do not share a machine's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    own = context._jsc.sc().getCheckpointDir()
    if not found and own.isEmpty() and not re.match(r"local(\[|$)", context.master):
        raise ValueError("spark.checkpoint.dir is not set: driver and executors need a folder that they share")
    if not found:
        found = own.get() if own.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if own.isEmpty():
        context.setCheckpointDir(found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared folder, so that a lost executor costs no recomputation of what is upstream."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt over all cores, a few tasks each, by its columns ``by`` if there are any: for rows that are little to
    read and much work. Spark makes tasks by bytes, and would leave a small file to one."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def broadcast_if_small(df: DataFrame, most_bytes: int = 1 << 25) -> DataFrame:
    """``df`` settled, and marked for broadcast if its rows have no more than ``most_bytes``.

    Spark cannot tell the size of what is settled before it plans, and would shuffle the other side first. The size is
    counted: 16 bytes for each row and column, and what strings and binaries hold. A larger ``df`` is left to the
    shuffle join that Spark plans, with its splitting of skewed partitions.
    """
    kept = settled(df)
    held = [F.octet_length(F.col(c)) for c, kind in kept.dtypes if kind in ("string", "binary")]
    size = F.sum(sum(held, F.lit(16 * len(kept.columns))).cast("long"))
    return F.broadcast(kept) if (kept.agg(size).first()[0] or 0) <= most_bytes else kept


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, to be joined by a shuffle whatever Spark takes its size for: that comes from the compressed bytes of files, of
    which a million names have few, and what is broadcast passes through the driver."""
    return df.hint("merge")

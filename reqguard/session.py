"""Session settings the jobs are written for."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Sensible everywhere; none of them changes a result.
RECOMMENDED_CONF: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Batches to Python workers are bounded by bytes, so long bodies cannot pile up.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    # A member that is repeated in a JSON object: the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Recording a Python call site for every column expression dominates the building of plans.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "reqguard") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session (once per application)."""
    context = spark.sparkContext
    if getattr(context, "_reqguard_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="reqguard-package-")) / "reqguard"
    archive = shutil.make_archive(str(target), "zip", root.parent, root.name)
    context.addPyFile(archive)
    context._reqguard_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """Where intermediate tables go: the cluster's ``spark.checkpoint.dir``.

    A temporary folder stands in only for local sessions that name none.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        folder = tempfile.mkdtemp(prefix="reqguard-shared-")
        context.setCheckpointDir(folder)
    return folder


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Batches to Python workers of about ``size`` bytes for what is run meanwhile; no result depends on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there.

    Lineage ends at the files, so a lost executor never recomputes what led to them, and each
    reader takes only the columns it needs.  The folder's owner decides how long they are kept.
    ``options`` are those of the Parquet writer.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/reqguard-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

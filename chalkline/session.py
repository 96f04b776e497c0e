"""Session set-up and the shared scratch area."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Runtime settings the jobs count on. Each is set only where the session leaves it unset.
RUNTIME_DEFAULTS = {
    # Arrow batches are cut by bytes as well as rows, so long texts never build a huge batch.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Settings of a build that keeps much on disk, for as long as it runs, and only where the session leaves them unset.
DISK_DEFAULTS = {
    "spark.sql.parquet.compression.codec": "zstd",
    # The shuffles of a job go when the job ends. They would stay until the driver happens to collect its garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def build_session(master: str = "local[*]", app_name: str = "chalkline", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(master).appName(app_name)
    for key, value in {**RUNTIME_DEFAULTS, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Fill in the runtime settings that the given session does not name itself."""
    _set_unnamed(spark, RUNTIME_DEFAULTS)
    _ship_package(spark)
    return spark


def _set_unnamed(spark: SparkSession, defaults: dict[str, str]) -> list[str]:
    """The keys that the session did not name, and that are set now."""
    named = {key for key, _ in spark.sparkContext.getConf().getAll()} | set(spark.conf.getAll)
    unnamed = [key for key in defaults if key not in named]
    for key in unnamed:
        spark.conf.set(key, defaults[key])
    return unnamed


@contextmanager
def sparing_disk(spark: SparkSession) -> Iterator[None]:
    """Tables written inside take less disk, and shuffles stay no longer than the job they belong to."""
    unnamed = _set_unnamed(spark, DISK_DEFAULTS)
    try:
        yield
    finally:
        for key in unnamed:
            spark.conf.unset(key)


def _ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    context = spark.sparkContext
    package = Path(__file__).resolve().parent
    if any(Path(name).name == f"{package.name}.zip" for name in context.listFiles):
        return
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='chalkline-')}/{package.name}", "zip", package.parent, package.name
    )
    context.addPyFile(archive)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own; on a cluster a machine-local
    folder would be lost with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        configured = context.getCheckpointDir()
    if configured is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="chalkline-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for one written table below the checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/chalkline/{name}-{uuid.uuid4().hex}"

"""Session settings and the shared staging area."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Settings the plans are designed for. All are standard Spark options.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A lookup join whose probe side is skewed is split even if that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "ledgerloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the recommended settings; keyword arguments use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = RECOMMENDED_CONF | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` of the session.

    Only a local session may run without it, and gets a fresh folder under the system's temporary
    directory. A cluster session without it is refused, since executors would not share the folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(root)
    return root


_STAGED: list[str] = []
_WITHIN: ContextVar[list[str] | None] = ContextVar("staged_within", default=None)


def release_staged(spark: SparkSession) -> int:
    """Removes the staged tables this process has written and not yet removed; frames that read them
    become unusable. Returns how many there were."""
    paths, _STAGED[:] = list(_STAGED), []
    return sum(remove_path(spark, path) for path in paths)


def stage(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder and read it back: later passes all see the same rows,
    also when executors are lost in between."""
    path = f"{staging_root(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _STAGED.append(path)
    if (within := _WITHIN.get()) is not None:
        within.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged_result(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> DataFrame:
    """``stage`` for the frame that ``build`` returns; what ``build`` itself has staged on the way is removed."""
    within: list[str] = []
    token = _WITHIN.set(within)
    try:
        frame = build()
    finally:
        _WITHIN.reset(token)
    result, _ = stage(frame, label)
    for path in within:
        if path in _STAGED:
            remove_path(spark, path)
            _STAGED.remove(path)
    return result


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared area, for files that a job writes by itself; ``release_staged`` removes it too."""
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    _STAGED.append(path)
    return path


def tasks_for(rows: int, each: int, least: int = 1) -> int:
    """How many tasks (or buckets) hold ``rows`` rows when none holds more than about ``each``: the memory of one task then stays
    the same however large the table is."""
    return max(least, -(-rows // each))


def remove_path(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    filesystem = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(filesystem.delete(target, True))


@contextlib.contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``stage`` for results that are reduced inside the block; the files go away afterwards."""
    table, path = stage(df, label)
    try:
        yield table
    finally:
        remove_path(df.sparkSession, path)
        _STAGED.remove(path)

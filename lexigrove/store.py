"""Intermediate tables in the folder that the whole cluster shares.

A table written there survives lost executors and cuts the lineage, which a cached or locally
checkpointed frame does not.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows that a task sorts or groups, about, where ``spread`` deals them.
PART_ROWS = 200_000
#: The same for rows of a few numbers.
PAIR_ROWS = 1_000_000

_OWN: dict[str, str] = {}
_OPEN = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only a local session without one gets a temporary folder (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="lexigrove-")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used; deleted with the innermost open ``scratch``."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if getattr(_OPEN, "paths", None):
        _OPEN.paths[-1].append(path)
    return path


def materialise(df: DataFrame, label: str, records: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return a frame over the files.

    ``records``: most rows of a batch that goes to Python tasks, where rows are long; it is the session's
    setting while the table is written.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if records:
            spark.conf.set(key, str(records))
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if records:
            spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by its keys in so many partitions that ``rows`` rows are about ``PART_ROWS`` in each; as it is if the session's number will do.

    The session's number is fixed, so that what a task sorts would grow with the input.
    """
    parts = -(-rows // PART_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def wide_parts(spark: SparkSession, rows: int) -> int:
    """Partitions of about ``PAIR_ROWS`` short rows each, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // PAIR_ROWS))


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, so what is returned must be written by ``kept``."""
    if not hasattr(_OPEN, "paths"):
        _OPEN.paths = []
    _OPEN.paths.append([])
    try:
        yield
    finally:
        for path in _OPEN.paths.pop():
            drop_path(spark, path)


def kept(df: DataFrame, label: str, records: int | None = None) -> DataFrame:
    """``materialise`` for the result of a ``scratch``: the table belongs to the scratch around it, if any."""
    own = _OPEN.paths.pop()
    try:
        return materialise(df, label, records)
    finally:
        _OPEN.paths.append(own)


def tidy(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, without the tables that it wrote on its way; what it returns is written then, and lazy else."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark):
            found = query(spark, sf_dir)
            return kept(found, query.__name__) if _OPEN.paths[-1] else found

    return run


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table once nothing lazy reads it any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

"""Session helpers: the shared folder, where lineage is cut, and what is deleted when a run ends."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Small tables are written by at least LEAST_FILES tasks, and by one for each ROWS_A_FILE rows.
LEAST_FILES, ROWS_A_FILE = 8, 100_000
_runs: list[list[str]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir. A local session without one (tests) gets a new local folder; elsewhere executors wouldn't see that, so it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted with the run that it is made in."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _runs:
        _runs[-1].append(path)
    return path


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it from there: a later loss of executors recomputes nothing above it, and no plan or constraint grows over the rounds of a loop.
    If it is known that df has at most `rows` rows, all of them small, few tasks write few files, however many partitions a shuffle has."""
    path = new_folder(df.sparkSession, "cut")
    few = df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // ROWS_A_FILE)))
    few.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def run(spark: SparkSession) -> Iterator[None]:
    """Delete the folders that are made within, at the end. What is left to read must be written to a folder made outside."""
    _runs.append([])
    try:
        yield
    finally:
        for path in _runs.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    of = spark._jvm.org.apache.hadoop.fs.Path(path)
    of.getFileSystem(spark._jsc.hadoopConfiguration()).delete(of, True)

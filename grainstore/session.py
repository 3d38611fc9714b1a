"""Session construction, table access and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("grainstore")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; a single Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Only where that is unset and the master is local (tests) a folder of our own is made, set, and removed at the end;
    on a cluster each executor would write to its own disk, so there the setting must be given.
    """
    sc = spark.sparkContext
    at = sc.getCheckpointDir()
    if not at:
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="grainstore-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            at = "file://" + own
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    at = os.path.join(shared_dir(spark), f"{what}-{uuid.uuid4().hex}")
    if _spaces:
        _spaces[-1].append(at)
    return at


_spaces: list[list[str]] = []


@contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """All paths made inside are deleted at the end; results must be written or counted before that."""
    _spaces.append([])
    try:
        yield
    finally:
        for at in _spaces.pop():
            remove(spark, at)


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder; it survives the loss of executors."""
    at = scratch(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path made by ``scratch``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

"""Tables written between the steps of an iterative operator.

They stand in the folder that the cluster names in ``spark.checkpoint.dir``, which the driver and all
executors share, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_roots: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session. Where none is set, a temporary one, but in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        folder = tempfile.TemporaryDirectory(prefix="cubeweave-", ignore_cleanup_errors=True)
        atexit.register(folder.cleanup)
        _own[app] = f"file://{folder.name}"
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is deleted when the driver's Python ends."""
    root = f"{shared_dir(spark)}/cubeweave-{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        atexit.register(_forget, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, root: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have gone, and its tables are only scratch
        drop_path(spark, root)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table from materialize()."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)

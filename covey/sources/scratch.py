"""Tables and files that outlive an executor, in the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset and the master is local, as in tests, a local one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Whether Spark deletes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts lineage, survives lost executors.

    What was shuffled for it is deleted with that; otherwise it stays until the
    driver's memory is collected, which a long job may never come to.
    """
    spark = df.sparkSession
    path = scratch(spark)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[table] = path
    return table


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that :func:`stored` gave and that nothing reads any more, as those of earlier rounds; others stay."""
    for table in tables:
        path = _FOLDERS.pop(table, None) if table is not None else None
        if path is not None:
            sc = table.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)

"""Tables written between the levels of iterative operators, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Temporary folders of local sessions without the setting, by application, and the tables written so far.
_LOCAL: dict[str, str] = {}
_WRITTEN: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without it gets a temporary folder, on a cluster its absence is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="lumentrace-")
    return _LOCAL[app]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again, which cuts the lineage for good."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.add(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._lt_path = path
    return table


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _WRITTEN.discard(path)


def clear(spark: SparkSession) -> None:
    """Remove the tables written so far, once no result that reads them is needed; the end of the driver does so too."""
    for path in list(_WRITTEN):
        remove(spark, path)


@atexit.register
def _clear_at_end() -> None:
    if SparkContext._active_spark_context is not None and (spark := SparkSession.getActiveSession()) is not None:
        clear(spark)

"""The package on the executors, and tables in the folder that they share with the driver."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application: they need not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).parent
    folder = tempfile.mkdtemp(prefix="ordinate-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "ordinate_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted(here.rglob("*.py")):
            z.write(file, file.relative_to(here.parent))
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ordinate-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts the lineage, outlives executors, and its size is known to the planner."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def removed(*tables: DataFrame) -> None:
    """Delete tables that stored() gave, once all that reads them is written."""
    for table in tables:
        delete(table.sparkSession, table._stored_at)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


#: Bytes of input of a task where an explicit number of partitions is asked for; Spark does not adapt such numbers.
TASK_BYTES = 64 << 20
UNKNOWN = 1 << 60


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that a table comes from, as far as they are known.

    The sizes of the leaves of the plan are added up: what Spark estimates for joins above them is far too much.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return sum(n for n in sizes if n < UNKNOWN)


def task_count(df: DataFrame) -> int:
    """Partitions of some TASK_BYTES for the files that a table comes from; at least spark.sql.shuffle.partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df) // TASK_BYTES)

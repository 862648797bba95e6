"""Places that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from ..session import ship


def base_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one is set here only where it is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="axisframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def home(spark: SparkSession) -> str:
    """Where this application's intermediate tables are."""
    return f"{base_dir(spark)}/axisframe/{spark.sparkContext.applicationId}"


def cleared(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results that were not written elsewhere can't be read after it."""
    removed(spark, home(spark))


#: Spark's setting that a query's shuffle files are removed as it ends; else they stay until the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """``df`` written as Parquet to the shared folder and read again: no later stage depends on its lineage, nor on its shuffles."""
    spark = df.sparkSession
    path = f"{home(spark)}/{tag}-{uuid.uuid4().hex}"
    held = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if held is None else spark.conf.set(_CLEAN, held)
    given_back(spark)
    return spark.read.schema(df.schema).parquet(path), path


def given_back(spark: SparkSession) -> str | None:
    """The driver's JVM gives memory that it has freed back to the system; what it says of that, or None where it can't.

    A chain of plans takes and frees native memory in hundreds of threads, those of the JVM's compilers likely most, and
    glibc keeps what they free: 100 to 400 MB beside the heap. Asked for through the JVM's management beans.
    """
    jvm = spark._jvm
    try:
        ask = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        call = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)  # no arguments, no signature
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        return ask.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JError:  # an older JVM, or another C library
        return None


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``written`` that no later step reads."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def prepared(spark: SparkSession) -> SparkSession:
    """The package is on the executors; every public function whose work runs there sees to that."""
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, for the registered queries; they also take smaller Arrow batches, a setting of the session."""
    spark = prepared(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")  # documents are long rows
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

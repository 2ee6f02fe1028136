"""Reading the input tables and staging intermediate ones."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The staging folder of each session's application, by application id.
_STAGED: dict[str, str] = {}


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The parquet table `name` of the directory `base`."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, as in tests, a temporary one, but only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = getattr(shared_dir, "local", None)
    if not base:
        base = shared_dir.local = "file://" + tempfile.mkdtemp(prefix="ledgraph-")
    return base


def staging(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables; it is deleted when the driver ends, or by `clean`."""
    app = spark.sparkContext.applicationId
    if app not in _STAGED:
        _STAGED[app] = f"{shared_dir(spark)}/ledgraph/{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(clean, spark)
    return _STAGED[app]


def clean(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. DataFrames that read them can't be used any more."""
    try:
        path = _STAGED.pop(spark.sparkContext.applicationId, None)
        if path:
            fs, p = filesystem(spark, path)
            fs.delete(p, True)
    except Exception:  # the JVM may have ended before
        pass


def filesystem(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path itself."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def listing(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of the shared file system in order; none where it doesn't exist."""
    fs, p = filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{staging(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def micros(c: str):
    """Microseconds since 1970 of a zone-free timestamp column, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")

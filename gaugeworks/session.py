"""Sessions, the folder that all executors share, and what is written there meanwhile."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Folders made by scratch(), by application; drop_written() deletes them.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    A fresh one only in local mode, as in tests; a cluster must name one, as a folder of the driver's own machine
    would be lost to its executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        base = spark.sparkContext.getCheckpointDir()
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> bool:
    """Delete a folder on whatever storage it is; whether there was one."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drop_written(spark: SparkSession) -> int:
    """Delete all that scratch() and written() made for this application; call it when results are stored.

    DataFrames that were returned before can't be read any more.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        delete(spark, path)
    return len(paths)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at `path`; an empty one where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty(spark, schema)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, which costs no job."""
    columns = StructType.fromDDL(schema).fields
    return spark.range(1).where("false").select(*[F.lit(None).cast(c.dataType).alias(c.name) for c in columns])


def small_table(spark: SparkSession, rows: list[dict[str, object]], schema: str) -> DataFrame:
    """A few rows of the driver's as a table. They go as an Arrow table, so no Python worker takes part; instants are aware."""
    if not rows:
        return empty(spark, schema)
    columns = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=to_arrow_schema(columns)), columns)


def listing(spark: SparkSession, path: str) -> tuple[tuple[str, int, int], ...]:
    """Name, size and time of change of each file in a folder, and in the folders in it: what changes if a table there does."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a folder's files."""
    return sum(size for _, size, _ in listing(spark, path))


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", conf: dict[str, str] | None = None) -> SparkSession:
    """For tests and the benchmark. On a cluster the session comes from spark-submit; only the time zone matters."""
    root = str(Path(__file__).resolve().parent.parent)
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])  # for the Python workers
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gaugeworks")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config(map=conf or {})
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark

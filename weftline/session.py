"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make reliable checkpoints possible.

    The folder named by ``spark.checkpoint.dir`` is used where it is set. A folder of our own
    is chosen only in local mode (tests, notebooks); on a cluster an unset folder is an error,
    because a machine-local folder would not be readable from the other executors.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-checkpoints-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


_FOLDERS: dict[str, str] = {}


def _folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    if sc.applicationId not in _FOLDERS:
        _FOLDERS[sc.applicationId] = f"{sc._jsc.sc().getCheckpointDir().get().rstrip('/')}/weftline-tables-{uuid.uuid4().hex}"
    return _FOLDERS[sc.applicationId]


def scratch_path(spark: SparkSession) -> str:
    """A new path for files in the folder of this application's intermediate tables."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def _writable(df: DataFrame) -> bool:
    """Whether Parquet can hold the columns: it has no column of nothing but nulls, and no two of one name."""
    names = [c.lower() for c in df.columns]
    types = df.schema.simpleString()
    return bool(names) and len(set(names)) == len(names) and "void" not in types and "interval" not in types


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table to the shared checkpoint folder and go on from that table.

    Used where a result is read more than once, or where a loop would otherwise grow its
    lineage; the table survives the loss of any executor, later steps read only the columns they need, and Spark
    knows its size when it chooses joins. ``drop`` removes it once nothing reads it any more.
    Columns that Parquet cannot hold are checkpointed as rows instead.
    """
    spark = df.sparkSession
    if not _writable(df):
        ensure_checkpoint_dir(spark)
        return df.checkpoint(eager=True)
    path = scratch_path(spark)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._weftline_table = path
    return out


def drop(*tables: DataFrame) -> None:
    """Removes tables that ``cut`` wrote. Whatever was planned on them must have been run or written before."""
    for table in tables:
        path = getattr(table, "_weftline_table", None) if isinstance(table, DataFrame) else None
        if path:
            sc = table.sparkSession.sparkContext
            place = sc._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


@atexit.register
def _clear() -> None:
    """At the end of the driver, the tables on a file system of this machine are removed."""
    for folder in _FOLDERS.values():
        if folder.startswith(("file:", "/")):
            shutil.rmtree("/" + folder.removeprefix("file:").lstrip("/"), ignore_errors=True)


#: Rows are spread over partitions of about this size, where their size can be estimated.
PARTITION_BYTES = 32 << 20


def parallelism(df: DataFrame) -> int:
    """Number of partitions for an explicit range partitioning: by the estimated size of the rows, at
    least two for each core and never more than the session's shuffle width."""
    spark = df.sparkSession
    width = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    estimated = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PARTITION_BYTES + 1
    return max(1, min(width, max(estimated, 2 * spark.sparkContext.defaultParallelism)))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One test table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application.

    Needed by operators that run Python functions; harmless where the package is installed
    on the executors already.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="weftline-")) / "weftline_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)

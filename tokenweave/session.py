"""Session helpers: the shared folder, lineage cuts and checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows a side may have to be broadcast; beyond it joins are left to the planner.
BROADCAST_ROWS = 200_000
_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local master may lack the setting; it then gets a folder of its own. On a cluster
    without the setting this raises, because a machine-local folder would lose data with its host.
    """
    named = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tokenweave-")
        spark.conf.set(_KEY, named)
    return named.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tokenweave/{spark.sparkContext.applicationId}"


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it knows it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def release(spark: SparkSession) -> None:
    """Deletes the tables this application wrote to the shared folder. What was made from them can't be read any more."""
    fs, where = file_system(spark, _own_dir(spark))
    fs.delete(where, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives every Python worker this package, once per application, wherever the driver was started from."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    home = Path(__file__).resolve().parent
    packed = Path(tempfile.mkdtemp(prefix="tokenweave-")) / "tokenweave.zip"  # only the driver reads it, to serve it
    with zipfile.ZipFile(packed, "w") as z:
        for path in sorted(home.rglob("*.py")):
            z.write(path, path.relative_to(home.parent))
    context.addPyFile(str(packed))


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the application's own part of the shared folder, which goes with the driver, or by release()."""
    own = _own_dir(spark)
    fs, where = file_system(spark, own)
    if fs.mkdirs(where):
        fs.deleteOnExit(where)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows, else df as it is. Counts at most + 1 rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def tasks_for(df: DataFrame, rows: int) -> int:
    """Tasks that a shuffle of so many rows of df calls for: as the session says, or more, so that one gets no more than the
    advised size of a partition. A text counts as 20 bytes, other values as 8, half of it once compressed."""
    spark = df.sparkSession
    width = sum(20 if t == "string" else 8 for _, t in df.dtypes)
    advised = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows * width // (2 * advised)))


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a side table that must fit one process; raises beyond `most` instead of growing without notice."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows; raise the bound or split the table")
    return rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

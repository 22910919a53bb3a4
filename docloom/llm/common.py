"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id wherever ids are ordered: null ids come after every other id.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder, and a cluster a folder in its warehouse.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if getattr(sc, "_docloom_scratch", None) is None:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        sc._docloom_scratch = tempfile.mkdtemp(prefix="docloom-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return sc._docloom_scratch


def _session_folder(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/docloom/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this session's part of the shared folder."""
    return f"{_session_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and any executor can read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def forget(*dfs: DataFrame) -> None:
    """Delete tables that ``stored`` gave and that nothing reads any more."""
    for df in dfs:
        _delete(df.sparkSession, df._stored_at)


def sweep(spark: SparkSession) -> None:
    """Delete all that this session stored: to be called once the results are written elsewhere."""
    _delete(spark, _session_folder(spark))


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes that ``df`` reads; no job runs for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once: an expression used inside another function's lambda is evaluated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    """Only A-Z change; ``lower`` would also change other letters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The ``n`` rows of ``df`` with the smallest hashes of ``keys``, or all.

    A cut on the hash first leaves some 4 n rows in all, however many tasks there are, so the sort that follows stays small.
    """
    span = 1 << 40
    part = min(span, 4 * n * span // max(df.count(), 1) + 1)
    return df.filter(F.pmod(F.xxhash64(*keys), F.lit(span)) < part).orderBy(F.pmod(F.xxhash64(*keys), F.lit(span)), *keys).limit(n)

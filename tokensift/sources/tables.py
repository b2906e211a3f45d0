"""Tables of a data folder, and intermediate tables that outlive a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_folders: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``, reduced to ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none (tests, local mode) a folder of this machine is set, and removed at the end.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tokensift-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, what: str) -> str:
    """A new path for ``what``, in a folder of this application below the shared one that goes when Python ends."""
    folder = f"{shared_dir(spark)}/tokensift-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except Exception:  # the JVM is gone: whoever keeps the shared folder clears it
        pass


def materialized(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; its lineage ends there.

    For a result that several later jobs read: a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = work_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def laid_out(df: DataFrame, id_column: str, row_group_size: int, path: str) -> DataFrame:
    """``df`` written to ``path`` by ascending id, with pages of one row group each, and read back.

    A scan with ranges of ids reads only the files and pages that have them.
    """
    ordered = df.repartitionByRange(id_column).sortWithinPartitions(id_column)
    ordered.write.mode("overwrite").option("parquet.page.row.count.limit", min(row_group_size, 20_000)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

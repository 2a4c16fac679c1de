"""What the training-data operators share: scratch tables, ids, row mapping."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word operators: space and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_scratch: list[tuple[weakref.ref, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it. Only a single-process session without that
    setting gets a temporary folder of its own; a cluster without it is an error,
    since a machine-local folder there would lose rows with an executor.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="gridloom-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A name in the shared folder that is not taken; what is written there is removed like scratch tables."""
    path = f"{scratch_dir(spark)}/gridloom-{label}-{uuid.uuid4().hex}"
    _scratch.append((weakref.ref(spark), path))
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks only. The table
    is removed when the Python process ends or by :func:`drop_scratch`.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    free_shuffles(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of plans that nothing holds any more."""
    gc.collect()
    spark._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Remove scratch tables that no later step reads, as their files count against the disk."""
    for df in tables:
        paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        for entry in [e for e in _scratch if any(p.endswith(e[1].rsplit("/", 1)[1]) for p in paths)]:
            remove(*entry)
            _scratch.remove(entry)


def remove(ref: weakref.ref, path: str) -> None:
    spark = ref()
    if spark is None or spark.sparkContext._jsc is None:
        return  # the session has ended; nothing can be removed any more
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_scratch() -> None:
    """Remove this process's scratch tables."""
    for entry in _scratch:
        try:
            remove(*entry)
        except Exception:  # at the end of the process the gateway may be gone
            break
    _scratch.clear()


atexit.register(drop_scratch)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, columns: list[str | Column], function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``function`` over Arrow batches of just these columns."""
    return df.select(*columns).mapInArrow(function, schema)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

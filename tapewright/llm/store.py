"""Shared-folder staging: lineage is cut with tables that every executor can read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, or else the context's checkpoint folder. Where neither is set, a
    temporary one in local mode, where all tasks run on one machine (tests); an error on a cluster."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tapewright-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


#: Folders that ``stage`` has written and nothing has removed yet, in order.
_written: list[str] = []


def stage(df: DataFrame, name: str = "stage", folder: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder (or to ``folder``) and read it back: later uses neither recompute it
    nor depend on any executor's disk."""
    spark = df.sparkSession
    path = folder or f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    if not folder:
        _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged() -> int:
    """A mark for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Removes what was staged between two marks: to be called when the results that read it have been written."""
    jvm = spark.sparkContext._jvm
    for name in _written[since:until]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _written[since:until]


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for internal use that ``df`` does not have (its own may clash)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        c = f"__{w}"
        while c.lower() in taken:
            c = f"_{c}"
        taken.add(c.lower())
        out.append(c)
    return out

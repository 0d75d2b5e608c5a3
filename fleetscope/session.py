"""Session helpers shared by every operator: the shared checkpoint folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the session has it.

    Only in local mode, where it is unset, a new temporary folder is made and set; on a cluster that is an error, since
    executors would not see the driver's folder.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fleetscope-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` once all that was made from them is cut or written itself."""
    for table in tables:
        jvm, path = table.sparkSession._jvm, table.written_to
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def fresh_name(*tables: DataFrame) -> str:
    """A column name that none of ``tables`` has."""
    taken = {c.lower() for t in tables for c in t.columns}
    return next(name for k in range(len(taken) + 1) if (name := f"own_{k}") not in taken)

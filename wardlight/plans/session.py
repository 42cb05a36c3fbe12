"""The shared folder of a session and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written as Parquet to the folder in spark.checkpoint.dir and read again; where that is unset, a temporary folder in local mode, an error on a cluster. The table is removed when the driver ends."""
    spark = df.sparkSession
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="wardlight-")
        spark.conf.set("spark.checkpoint.dir", named)
    path = f"{named.rstrip('/')}/wardlight-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the session has ended; its folder is the cluster's to clean
            return


atexit.register(_remove_written)

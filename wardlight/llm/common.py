"""Helpers shared by the training-data operators: lineage cuts, checked broadcasts, joins on hot keys, gapless ranks, exact binned quantiles."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Bytes of a side that may be broadcast, by its counted rows and the width of its columns; beyond it a shuffled join is planned. A query has some ten such sides.
BROADCAST_BYTES = 16 << 20
#: A join splits keys with more than this share of the rows off, which are then fewer than its inverse.
HOT_SHARE, HOT_ROWS = 0.001, 256
#: A word of a text: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

Place = tuple[SparkSession, str]
#: Tables that live until the driver ends, and the scopes that this thread (or task of an event loop) is in.
_LASTING: list[Place] = []
_SCOPES: ContextVar[tuple[list[Place], ...]] = ContextVar("scopes", default=(_LASTING,))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session; where unset, a temporary one in local mode, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="wardlight-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, outer: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: cuts lineage, survives lost executors.

    The table is removed at the end of the innermost scratch() it is written in (outer: of the one around that), or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/wardlight-{uuid.uuid4().hex}"
    scopes = _SCOPES.get()
    scopes[max(0, len(scopes) - 2) if outer else -1].append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(tables: list[Place]) -> None:
    while tables:
        spark, path = tables.pop()
        try:
            jvm, jsc = spark._jvm, spark._jsc
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  the session has ended; its folder is the cluster's to clean
            return


@contextmanager
def scratch():
    """Tables that materialize() writes inside are removed at the end; what is to outlive it is written with outer=True."""
    own: list[Place] = []
    before = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(before)
        _remove(own)


atexit.register(lambda: _remove(_LASTING))


@contextmanager
def batch_rows(spark: SparkSession, rows: int = 300):
    """Arrow batches of at most so many rows in the jobs that run inside; the session's own setting holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches (Spark bounds their bytes) in parts of so many rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def width(df: DataFrame) -> int:
    """Bytes that a broadcast row of df takes, about."""
    return 24 + sum(40 if isinstance(f.dataType, (StringType, BinaryType)) else 8 for f in df.schema.fields)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows take BROADCAST_BYTES at most; else unchanged, for a shuffled join."""
    return F.broadcast(df) if rows * width(df) <= BROADCAST_BYTES else df


def hot_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", counts: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """left joined ("inner" or "left") with right, which has one row a key, without a task that gets all rows of a frequent key of left, or all of its null keys.

    Keys with more than HOT_SHARE of left's rows are fewer than 1 / HOT_SHARE: their rows of right are broadcast, the other keys are shuffled. counts: (key, _n) with left's rows of each key, and total, their
    number, if they are known. Both sides should be materialized.
    """
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts
    total = left.count() if total is None else total
    hot = [r[0] for r in counts.where(F.col(key).isNotNull() & (F.col("_n") > max(HOT_ROWS, HOT_SHARE * total))).select(key).collect()]  # fewer than 1 / HOT_SHARE
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False)) if hot else F.lit(False)
    out = left.where(F.col(key).isNotNull() & ~is_hot).join(right, key, how)
    if hot:
        out = out.unionByName(left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how))
    if how == "left":
        out = out.unionByName(left.where(F.col(key).isNull()), allowMissingColumns=True)
    return out


def gapless_rank(df: DataFrame, key: str, order: list[str], out: str, bucket_rows: int = 1024) -> DataFrame:
    """df with a rank from 0 without gaps within each key, and no task that holds a whole key.

    Rows of a key are dealt by a hash of the order columns into buckets of about bucket_rows; a rank is the
    rows of the key's earlier buckets plus the place within the bucket. The earlier buckets are summed in two steps, by groups of about the root of their number. df should be materialized: it is read three times.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n_keys = counts.count()
    dealt = df.join(small(counts, n_keys), key).withColumn("_buckets", F.ceil(F.col("_n") / bucket_rows)).withColumn("_bucket", F.pmod(F.xxhash64(*order), F.col("_buckets"))).drop("_n")
    sizes = dealt.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_m"), F.first("_buckets").alias("_buckets"))
    sizes = sizes.withColumn("_group", F.floor(F.col("_bucket") / F.ceil(F.sqrt("_buckets"))))
    earlier = (Window.unboundedPreceding, -1)
    groups = sizes.groupBy(key, "_group").agg(F.sum("_m").alias("_g"))
    groups = groups.select(key, "_group", F.coalesce(F.sum("_g").over(Window.partitionBy(key).orderBy("_group").rowsBetween(*earlier)), F.lit(0)).alias("_g0"))
    inside = F.coalesce(F.sum("_m").over(Window.partitionBy(key, "_group").orderBy("_bucket").rowsBetween(*earlier)), F.lit(0))
    offsets = sizes.withColumn("_m0", inside).join(groups, [key, "_group"]).select(key, "_bucket", (F.col("_g0") + F.col("_m0")).alias("_offset"))
    place = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order))
    return (
        dealt.drop("_buckets").withColumn("_place", place)
        .join(offsets, [key, "_bucket"])
        .withColumn(out, (F.col("_offset") + F.col("_place") - 1).cast("long"))
        .drop("_bucket", "_place", "_offset")
    )


def binned_quantiles(df: DataFrame, by: str, value: str, qs: dict[str, float], step: float = 1e-4) -> DataFrame:
    """(by, a column for each quantile, texts) over the non-null values in bins of `step`: the lowest bin up to which the share of rows is reached.

    The same whatever the partitions. Bins are counted first: a group is as large as the range of its values over step, not as its rows.
    """
    bins = df.where(F.col(value).isNotNull()).groupBy(by, F.round(F.col(value) / step).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    whole = bins.withColumn("_upto", upto).withColumn("_of", F.sum("_n").over(Window.partitionBy(by)))
    found = [(F.min(F.when(F.col("_upto") >= F.ceil(q * F.col("_of") - 1e-9), F.col("_bin"))) * step).alias(name) for name, q in qs.items()]
    return whole.groupBy(by).agg(*found, F.sum("_n").alias("texts"))


def utf8_size(text: str | Column = "text") -> Column:
    """UTF-8 bytes of a text; null counts none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")

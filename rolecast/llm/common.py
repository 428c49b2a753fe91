"""Text conventions and cluster helpers that the training-data operators share."""

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows in an Arrow batch handed to Python: a batch of very long texts stays small.
BATCH_ROWS = 500


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    r"""The runs of ``[^\x20\x09-\x0D]+`` in order; null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def word_bytes(text: str | None) -> list[bytes]:
    """The same words as UTF-8 bytes: ``bytes.split()`` cuts at exactly these six characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def prepare(spark: SparkSession) -> None:
    """Session settings that bound the memory of Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Unset, it is a temporary one on a single machine and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = f"file://{os.path.join(tempfile.gettempdir(), 'rolecast-checkpoints')}"
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(frame: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(frame.sparkSession)
    return frame.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(frame: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a compressed table in the shared folder: for wide rows, which a checkpoint would store as they are."""
    path = scratch(frame.sparkSession, name)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path in the shared folder, whatever file system it is on."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: A key that holds more than one share of a side's rows is dealt over as many places as it fills shares.
SHARES = 1024


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has at most one row for each value of `on`, with the hot keys of left spread by its column `by`.

    Hot are the at most SHARES keys with over 1 / SHARES of left's rows each. Right's rows for
    them are copied, at most 2 * SHARES times in all, and left's rows are dealt over the
    copies, so that no task gets more than a share of one key. counts (on, count) may be given
    where they are known. Null keys match nothing; how: inner, left or left_semi.
    """
    spark = left.sparkSession
    counts = (left.groupBy(on).count() if counts is None else counts).where(F.col(on).isNotNull())
    total = counts.agg(F.sum("count")).first()[0] or 0
    most = counts.where(F.col("count") * SHARES > total).select(on, F.ceil(F.col("count") * SHARES / F.lit(max(1, total))).cast("int").alias("__ways")).where("__ways > 1").collect()
    if not most:
        return left.join(right, on, how)
    hot = F.broadcast(spark.createDataFrame(most, T.StructType([counts.schema[on], T.StructField("__ways", T.IntegerType())])))
    dealt = left.join(hot, on, "left").withColumn("__place", F.coalesce(F.pmod(F.xxhash64(by), F.col("__ways")), F.lit(0)).cast("int")).drop("__ways")
    copied = right.join(hot, on, "left").withColumn("__place", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__ways"), F.lit(1)) - 1))).drop("__ways")
    return dealt.join(copied, [on, "__place"], how).drop("__place")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

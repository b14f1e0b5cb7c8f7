"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Set here only where the session has none (as in tests)."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if have:
        return have
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    import tempfile

    return "file://" + tempfile.gettempdir() + "/veilspan-checkpoints"


def materialize(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{uuid.uuid4().hex}"
    with batch_bytes(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batch_bytes(spark: SparkSession, size: str = "3m"):
    """Within it, Arrow batches of so many bytes (or one row) go to Python and back; afterwards the session is as before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/veilspan-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application materialized: results, too, that lie there. For the end of a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """Delete tables that materialize() wrote and that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str | Column = "text") -> Column:
    """Null texts count as empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.cast("string"), F.lit(""))


def fold(doc_id: str | Column, parts: int) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(parts))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def share_of(total: int, wanted: int, *key) -> Column:
    """A condition that holds for about wanted of total rows, by a hash of key alone: any share, however small, is met in doubles."""
    u = F.xxhash64(*key).cast("double") / float(2**64) + 0.5
    return u < min(1.0, wanted / max(1, total))

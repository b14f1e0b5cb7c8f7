"""How rows lie: enough tasks for row-wise Python, and plans cut where a loop would repeat them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


TASK_ROWS = 25_000  # of a scan of narrow rows that is dealt out anew
SPLIT_ROWS = 500_000  # a split of more rows than this holds narrow ones


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, if it is a plain scan of fewer splits; otherwise as it is.

    A small file is one split, and what follows would run on one core. A scan of many splits is not shuffled, unless its rows are so
    narrow that a split holds very many. Rows are counted by the files' footers: tasks grow in number, not in length, with the input.
    """
    spark = df.sparkSession
    nodes = set() if df.isStreaming else set(_nodes(df._jdf.queryExecution().optimizedPlan()))
    if df.isStreaming or not _PLAIN.issuperset(nodes):
        return df
    cores, splits = spark.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    rows = df.count() if nodes <= _COUNTED and nodes & _FILES else 0
    if splits < cores or rows > splits * SPLIT_ROWS:
        return df.repartition(max(cores, -(-rows // TASK_ROWS)))
    return df


def each(df: DataFrame, array: str | Column, *keep: str | Column, name: str = "_x") -> DataFrame:
    """A row of the kept columns for each element of an array that is not null.

    For a plain explode Spark first asks whether the array is empty, and moves that question to the scan: there all that makes the array,
    Python too, would run once more, on as few cores as the file has splits.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def merged(df: DataFrame) -> DataFrame:
    """df as a side of a join whose rows grow with the input: merged at every size. Narrow rows are so small, by bytes, that Spark would
    build a table of millions of them on the driver and broadcast it."""
    return df.hint("shuffle_merge")


MOST_BROADCAST = 100_000  # rows


def looked_up(df: DataFrame) -> DataFrame:
    """df as a side of a join that may have few rows or many: its rows are counted. Few are broadcast, so that no key is one task; many
    are merged."""
    return F.broadcast(df) if df.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else merged(df)


TASK_BYTES = 2 << 20  # of packed narrow rows, as the plan estimates them, that one task takes


def tasks_for(*inputs: DataFrame) -> int:
    """How many tasks take the inputs together: as many as the session sets, or more where the plans expect more bytes."""
    size = sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in inputs)
    least = max(1, int(inputs[0].sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, min(MOST_TASKS, -(-size // TASK_BYTES)))


MOST_TASKS = 4096  # an estimate without statistics says next to nothing
_FILES = {"LogicalRelation", "DataSourceV2ScanRelation"}
_COUNTED = _FILES | {"Project"}
_PLAIN = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "DataSourceV2ScanRelation", "SubqueryAlias"}


def _nodes(plan) -> Iterator[str]:
    """Class names of a logical plan's nodes."""
    yield plan.getClass().getSimpleName()
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def settle(df: DataFrame) -> DataFrame:
    """df computed once and written to the checkpoint folder: a loop's next round reads it and its lineage ends. A local session without
    such a folder keeps it in its cache; on a cluster the folder must be named."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if folder:
        path = f"{folder}/veilspan-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return df.cache()

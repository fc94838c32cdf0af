"""Cutting lineage, and joins whose hot keys stay where they are."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys with more rows than both LEAST_HOT and the MAX_HOTth part of all rows are hot: at most MAX_HOT keys.
LEAST_HOT, MAX_HOT = 1_000, 20_000


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session or its context names. Only a local master, as in tests, may go without:
    it gets a temporary folder; on a cluster each machine would have its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings ``values``, put back at the end."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


#: The shuffles of a frame made under this are deleted when it has been computed.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Shuffles keep their number of partitions, so that frames dealt by the same key meet without another shuffle.
AS_DEALT = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
#: Plans are carried out as first made: only so is a checkpoint known to be dealt and sorted as it is.
AS_PLANNED = AS_DEALT | {"spark.sql.adaptive.enabled": "false"}


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder; nothing else of the work stays on disk."""
    shared_folder(df.sparkSession)
    with settings(df.sparkSession, TIDY):
        return df.select("*").checkpoint(eager=True)


def dropped(df: DataFrame) -> None:
    """Deletes the checkpoint of ``df``, which ``checkpointed`` returned and nothing reads any more."""
    file = df._jdf.logicalPlan().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows that are worth a part of their own, and rows that no part has much more than.
LEAST_A_PART, MOST_A_PART = 20_000, 400_000


def parts_for(rows: DataFrame) -> int:
    """Into how many parts to deal ``rows`` (materialised) for many steps: two for each core, less where rows are few."""
    n = rows.count()
    return max(1, n // MOST_A_PART, min(2 * rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_A_PART))


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` kept, dealt by ``key`` as shuffles under AS_DEALT are, and in its order; ``unpersist`` when done."""
    spark = df.sparkSession
    with settings(spark, AS_DEALT):
        out = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key).persist()
        out.count()  # only what has been computed is known to be dealt
    return out


def hot_of(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(key) of the hot keys among ``counts`` (key once, and its number of rows; materialised), which are MAX_HOT at most
    whatever the size: each has a MAX_HOTth of all rows."""
    bound = max(LEAST_HOT, (counts.agg(F.sum(n)).first()[0] or 0) // MAX_HOT)
    return counts.where((F.col(n) > bound) & F.col(key).isNotNull()).select(key)


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The hot keys of ``rows``."""
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return hot_of(checkpointed(counts.where(F.col("_n") > LEAST_HOT)), key, "_n")


def join_skewed(rows: DataFrame, side: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``side``, which has each ``key`` once: rows of ``hot`` keys (materialised) meet a broadcast of
    theirs, the others are shuffled. ``rows`` are read twice if any key is hot."""
    if hot.isEmpty():
        return rows.join(side, key)
    few = F.broadcast(side.join(F.broadcast(hot), key, "left_semi"))
    cold = rows.join(F.broadcast(hot), key, "left_anti")
    return rows.join(F.broadcast(hot), key, "left_semi").join(few, key).unionByName(cold.join(side, key))

"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: White space between words: space and the control characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: So many rows of a few numbers are one task's work.
TASK_ROWS = 20_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (materialised, of ``rows`` narrow rows) in no more partitions than TASK_ROWS asks for or the session works
    on at once: a few rows in many partitions would cost a task for each whenever they are read. Not to be put on top of
    a shuffle, whose partitions' hash tables one task would hold together."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def packed(df: DataFrame) -> DataFrame:
    """``df`` checkpointed and gathered by its number of rows."""
    found = checkpointed(df)
    return gathered(found, found.count())


def written(df: DataFrame) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, of which later steps read only the columns they need."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, lengthened until none of the columns ``taken`` is called so."""
    known = {t.lower() for t in taken}
    while name.lower() in known:
        name += "_"
    return name


def quoted(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, dots and all."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def appended(df: DataFrame, kept: int, fields: list[StructField], make: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """The first ``kept`` columns of ``df`` with those that ``make`` adds to each Arrow batch, whatever the names."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    out = StructType([*plain.schema.fields[:kept], *(StructField(f"n{i}", f.dataType) for i, f in enumerate(fields))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *make(batch)], names=out.names)

    return plain.mapInArrow(run, out).toDF(*df.columns[:kept], *(f.name for f in fields))


#: Keys with more rows than both LEAST_HOT and the MAX_HOTth part of all rows are hot: at most MAX_HOT keys.
LEAST_HOT, MAX_HOT = 500, 50_000


def join_counted(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` (``total``, materialised) joined with ``groups``, which has each key once and its number of rows in
    ``n``. Hot keys are few by their definition, so theirs are broadcast and their rows stay where they are; the others
    are shuffled, and none of them can fill a task."""
    bound = max(LEAST_HOT, total // MAX_HOT)
    hot = F.broadcast(groups.where(F.col("n") > bound).drop("n"))
    rest = groups.where(F.col("n") <= bound).drop("n")
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(rest, keys))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often the body (or a lambda in it) names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, in order; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

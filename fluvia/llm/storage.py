"""Written tables in the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch while a table is written: rows here are whole texts and sets of their shingles,
#: of which Spark's own limits (ten thousand rows, 64 MB) would lie in memory several times over.
BATCH_BYTES, BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"

#: Rows of a file of narrow rows.
FILE_ROWS = 250_000

#: Ids (longs) that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

#: Groups of rows that may be broadcast, as the largest ones of all.
LARGE_GROUPS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a private one on this machine, for local runs only."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="fluvia-")
        atexit.register(shutil.rmtree, there, True)
        spark.sparkContext.setCheckpointDir(there)
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, batch_bytes: int = BATCH_BYTES, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read again (with its schema, so empty tables work).

    rows says how many there are at most, of a few numbers each: then the last step's tasks, and so the files, are no
    more than these rows and the cluster's cores need.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, rows // FILE_ROWS))
    path = new_path(spark, name)
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(batch_bytes))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that no frame still to be run depends on, and let Spark clean their shuffles."""
    for df in tables:
        spark = df.sparkSession
        delete(spark, df.written_path)
    if tables:
        tables[0].sparkSession._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key isn't in the one column of ids (written; nulls in it count for nothing).

    Only a list of at most BROADCAST_IDS ids is broadcast, after counting it.
    """
    gone = ids.select(F.col(ids.columns[0]).alias("__gone")).filter("__gone is not null").distinct()
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone.hint("merge"), F.col(key) == F.col("__gone"), "left_anti")


def joined_to_groups(rows: DataFrame, groups: DataFrame, on: dict[str, str], members: str) -> DataFrame:
    """The inner join of rows (written) with one row a group, by columns on (of rows: of groups); members counts a group's rows.

    Groups of more than rows / LARGE_GROUPS rows are at most LARGE_GROUPS; these are broadcast, so the rows of a large
    group never meet in a task. The others are joined by a shuffle.
    """
    limit = -(-rows.count() // LARGE_GROUPS)
    same = reduce(lambda a, b: a & b, (F.col(r) == F.col(g) for r, g in on.items()))
    large = F.broadcast(groups.filter(F.col(members) > limit))
    rest = rows.join(large, same, "left_anti").join(groups.filter(F.col(members) <= limit).hint("merge"), same)
    return rows.join(large, same).unionByName(rest)


def among(docs: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows of docs whose key is in the one column of ids (written, distinct), which is broadcast only if it's few."""
    wanted = ids.select(F.col(ids.columns[0]).alias("__wanted"))
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(wanted) if small else wanted.hint("merge"), F.col(key) == F.col("__wanted"), "left_semi")

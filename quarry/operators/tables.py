"""Tables that cut lineage, latest rows by key, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting by which a write that has ended leaves no shuffle files.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local session that names none gets one of this machine; a cluster's must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def run_dir(spark: SparkSession) -> str:
    """Where this application's tables lie; see forget()."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for the tables written inside goes once they are there; else it lies on disk as long as the driver remembers the step."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes a table in the shared folder and reads it again, so that lost executors cost no more than one step."""
    return gathered([df], name)


def gathered(parts: Iterable[DataFrame], name: str) -> DataFrame:
    """One table of several of the same columns, written one after another as cut() writes one; each part's shuffles go before the next is made."""
    path = None
    for df in parts:
        path = path or f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
        with freed(df.sparkSession):
            df.write.mode("append").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Removes all tables that cut() has written for this application; results that were not saved can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`: an upsert's result, as one aggregation without a sort of the rows."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def newest(rows: DataFrame, keep: int, order: list[Column], scope: list[str] | None = None) -> DataFrame:
    """The first `keep` rows by `order`, of all or of each scope (bounded state: caches, traces, hot rows)."""
    if not scope:
        return rows.orderBy(*order).limit(keep)
    rank = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return rows.withColumn("_k", rank).where(F.col("_k") <= keep).drop("_k")


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """rows with `name`, their number from 1 within a group of `by` by `order`, whatever a group's size.

    Rows are sorted by ranges, so that a large group is many tasks' work; each task's rows of a group are counted, and a row's number is
    its place among them and what earlier tasks have of the group. Rows of equal order get numbers of their own, in no set order.
    """
    dealt = cut(rows.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy(*by, "_p").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # of tasks, not of rows
    sums = counts.withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0))).select(*[F.col(c).alias("_" + c) for c in by], F.col("_p").alias("_q"), "_b")
    same = F.col("_p") == F.col("_q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col("_" + c))
    place = F.row_number().over(Window.partitionBy("_p", *by).orderBy(*order))
    return dealt.withColumn("_r", place).join(F.broadcast(sums) if not by else sums, same).select(*rows.columns, (F.col("_r") + F.col("_b")).alias(name))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every end of an edge (a, b), root being the least node that links reach.

    Edges are turned to stars by turns (large-star and small-star), each round a table of its own, until
    nothing changes. Rows of a round are at most the edges; no task gathers a node's neighbours.
    """
    links = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: larger neighbours link to the least
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = cut(large, "large")
        # small star: smaller neighbours and the node itself link to the least
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        links = cut(small, "small")
        # done when each node has one link, to a node that has none
        own = links.groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"))
        if own.where("n > 1").select("a").union(own.join(own.select(F.col("a").alias("b")), "b", "left_semi").select("a")).isEmpty():
            break
    else:
        raise RuntimeError(f"components: links still changed after {rounds} rounds")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)

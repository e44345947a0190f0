"""Written tables that cut lineage, in the folder that driver and executors share, and the
connected components that are computed through them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine, where the session names no shared folder.
LOCAL_SCRATCH = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Without it a cluster's executors would each write
    to a disk of their own, so that is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or LOCAL_SCRATCH).rstrip("/")


class Scratch:
    """Tables that outlast any executor. ``drop`` removes those that nothing reads any more,
    the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/sleuthframe/{label}-{uuid.uuid4().hex[:12]}"
        path, files = self._at(self.root)
        files.deleteOnExit(path)

    def _at(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._at(self.path(name))
            files.delete(path, True)


def components(edges: DataFrame, scratch: Scratch, label: str = "components", rounds: int = 40) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), root being the least node.
    Nodes without an edge have no row.

    A round is a large-star and a small-star step: what hangs on a node moves to the least
    node beside it, then all that a node hangs on moves to the least of these. Minima are
    written before they are joined back, so both sides of a join are plain scans and the
    planner can broadcast a small one or split a hub's edges over tasks. A lost executor
    repeats a part of one round at most."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = scratch.save(pairs.distinct(), f"{label}-0")
    before = None
    for k in range(1, rounds + 1):
        least = scratch.save(pairs.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")), f"{label}-least")
        large = pairs.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        large = scratch.save(large.distinct(), f"{label}-large")
        low = scratch.save(large.groupBy("a").agg(F.min("b").alias("m")), f"{label}-low")
        ends = F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")
        small = large.join(low, "a").select(ends).select("e.a", F.col("e.m").alias("b")).where("a <> b")
        pairs = scratch.save(small.distinct(), f"{label}-{k}")
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        scratch.drop(f"{label}-{k - 1}", f"{label}-least", f"{label}-large", f"{label}-low")
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))

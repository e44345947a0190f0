"""Streams: deduplicated ingest, the burner window, and findings as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import detect
from ..operators.edges import both_ends


def dedup_texts(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """(source_type, record_id, text, ts): each content once within the delay."""
    return stream.withColumn("run_key", S.run_key("source_type", "record_id", "text")).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["run_key"])


def burner_windows(edges: DataFrame, hours: int = 72, slide: str = "6 hours", peers: int = 5, delay: str = "6 hours") -> DataFrame:
    """Sliding windows in which a node calls many parties; the count of parties is approximate.

    Windows start at multiples of the slide. Parties met within ``hours`` less a slide always
    share a window; those met over a longer stretch, up to ``hours``, do so only if a start
    happens to fit, where the batch operator's exact trailing window finds them all."""
    ends = both_ends(edges.where("is_call")).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    g = ends.groupBy("case_id", "node", F.window("at", f"{hours} hours", slide)).agg(F.approx_count_distinct("peer").alias("call_degree"))
    return g.where(F.col("call_degree") >= peers)


def store_findings(edges: DataFrame, path: str, checkpoint: str, cfg: detect.Detection = detect.Detection()):
    """Scans each micro-batch with the earlier edges and appends what is new. ``path`` holds
    edges/ and findings/; a batch that runs twice adds nothing twice."""

    def batch(part: DataFrame, number: int) -> None:
        spark = part.sparkSession
        part.write.mode("overwrite").parquet(f"{path}/edges/batch={number}")
        every = spark.read.parquet(f"{path}/edges")
        found = detect.scan(every.drop("batch"), cfg)
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/findings")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        stored = spark.read.parquet(f"{path}/findings").where(F.col("batch") < number) if there else found.limit(0)
        detect.new_findings(found, stored).write.mode("overwrite").parquet(f"{path}/findings/batch={number}")

    return edges.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""The hash-chained ledger: building, verifying, anchoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import GENESIS
from ..functions import scalars as S

FIELDS = "id long, timestamp string, actor_id string, action string, case_id string"


def build_chain(entries: DataFrame, head: str = GENESIS) -> DataFrame:
    """Entries in id order with previous_hash and current_hash. Each hash needs the one
    before, so the fold is sequential by its nature; it carries a hash per entry, in order,
    through one sorted stream."""
    from collections.abc import Iterator

    import pandas as pd

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        last = head
        for part in parts:
            before, after = [], []
            for r in part.itertuples(index=False):
                before.append(last)
                last = hashlib.sha256("|".join([r.timestamp or "", r.actor_id or "", r.action or "", r.case_id or "", last]).encode()).hexdigest()
                after.append(last)
            yield part.assign(previous_hash=before, current_hash=after)

    own = entries.selectExpr("cast(id as bigint) id", "timestamp", "actor_id", "action", "case_id")
    return own.coalesce(1).sortWithinPartitions("id").mapInPandas(fold, f"{FIELDS}, previous_hash string, current_hash string")


def append(ledger: DataFrame, entries: DataFrame) -> DataFrame:
    last = head_of(ledger).first()
    return ledger.unionByName(build_chain(entries, last.current_hash if last and last.current_hash else GENESIS))


def verify_chain(ledger: DataFrame) -> DataFrame:
    """Per entry: whether it links to the entry before and its hash is right. Entries meet in
    blocks of ids; the one global window is over the blocks, a row for each 4096 ids."""
    checked = ledger.withColumn("hash_ok", S.chain_hash("timestamp", "actor_id", "action", "case_id", "previous_hash") == F.col("current_hash"))
    # Each block of ids looks back within itself; its first entry takes the block before's last.
    blocks = checked.withColumn("block", F.floor(F.col("id") / 4096))
    inside = W.partitionBy("block").orderBy("id")
    ends = blocks.groupBy("block").agg(F.max_by("current_hash", "id").alias("tail"))
    carried = ends.select("block", F.lag("tail").over(W.orderBy("block")).alias("carried"))
    out = blocks.withColumn("before", F.lag("current_hash").over(inside)).join(carried, "block")
    return out.withColumn("link_ok", F.col("previous_hash") == F.coalesce("before", "carried", F.lit(GENESIS))).select("id", "case_id", "hash_ok", "link_ok")


def is_intact(ledger: DataFrame) -> DataFrame:
    return verify_chain(ledger).agg(F.coalesce(F.bool_and(F.col("hash_ok") & F.col("link_ok")), F.lit(True)).alias("verified"), F.count("*").alias("entries"))


def head_of(ledger: DataFrame) -> DataFrame:
    """Count, last id and last hash: the record that an anchor keeps."""
    return ledger.agg(F.count("*").alias("entries"), F.max("id").alias("last_id"), F.max_by("current_hash", "id").alias("current_hash"))


def write_anchor(ledger: DataFrame, path: str) -> None:
    head_of(ledger).write.mode("overwrite").json(path)


def verify_anchor(ledger: DataFrame, anchor: DataFrame) -> DataFrame:
    """The ledger against an anchor (entries, last_id, current_hash; no row: not anchored)."""
    now = head_of(ledger).select(F.col("entries").alias("now"), F.col("last_id").alias("now_id"), F.lit(1).alias("k"))
    then = anchor.select(F.col("entries").cast("long").alias("then"), F.col("last_id").cast("long").alias("anchor_id"), F.col("current_hash").alias("anchor_hash"), F.lit(1).alias("k"))
    at = ledger.select(F.col("id").alias("anchor_id"), F.col("current_hash").alias("found_hash"))
    joined = now.join(then, "k", "left").join(at, "anchor_id", "left")
    status = (
        F.when(F.col("then").isNull(), "NOT_ANCHORED").when(F.col("now") == 0, "LEDGER_EMPTY")
        .when((F.col("found_hash") == F.col("anchor_hash")) & (F.col("now") == F.col("then")), "MATCH")
        .when((F.col("found_hash") == F.col("anchor_hash")) & (F.col("now") > F.col("then")), "APPENDED_SINCE_ANCHOR").otherwise("TAMPER_OR_ROLLBACK")
    )
    return joined.select(status.alias("status"), F.greatest(F.lit(0).cast("long"), F.col("now") - F.coalesce("then", F.lit(0))).alias("behind_by"))


def case_ledger(ledger: DataFrame, case_id: str) -> DataFrame:
    return ledger.where(F.col("case_id") == case_id).orderBy("id")

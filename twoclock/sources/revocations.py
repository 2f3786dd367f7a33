"""What was withdrawn, laid out beside the log by the pair of the withdrawn claim.

A claim names the id it revokes, and any claim may revoke any other; so a read of one
pair, which needs a few rows of the log, would have to look through the revocations of
all pairs. The index has one row a withdrawn id with the subject and slot of its claim
and the first moment it was withdrawn. It is partitioned by slot and sorted by subject,
as the log is: filters on the pair reach its scan.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .log import append_claims, read_claims


def revocations_of(claims, targets=None) -> DataFrame:
    """(slot, subject, id, revoked_at) for every id that `claims` revoke; slot and subject
    are those of the claim with that id in `targets` (`claims` itself, unless given), NULL
    where there is none.

    A claim mostly withdraws one of its own slot, so the claims of the slots that withdraw
    anything are looked through first, and the others only for ids not found there."""
    names = claims.where(F.col("revokes").isNotNull()).select("slot").distinct()
    slots = [r["slot"] for r in names.collect() if r["slot"] is not None]
    withdrawn = (claims.where(F.col("revokes").isNotNull())
                 .groupBy(F.col("revokes").alias("id"))
                 .agg(F.min("recorded_at").alias("revoked_at")))
    owners = (claims if targets is None else targets).select("id", "subject", "slot")
    among = F.coalesce(F.col("slot").isin(slots), F.lit(False))
    columns = ["slot", "subject", "id", "revoked_at", "_met"]
    owners = owners.withColumn("_met", F.lit(True))
    first = kept(withdrawn.join(owners.where(among), "id", "left").select(*columns))
    found = first.where("_met").drop("_met")
    unmet = first.where("_met is null").select("id", "revoked_at")
    if unmet.isEmpty():
        return found
    rest = unmet.join(owners.where(~among), "id", "left").select(*columns).drop("_met")
    return found.unionByName(rest)


def _append(rows, path):
    (rows.hint("rebalance", "slot").sortWithinPartitions("slot", "subject")
     .write.mode("append").partitionBy("slot").parquet(path))


def write_revocations(claims, path) -> DataFrame:
    """The index of a whole log."""
    _append(revocations_of(claims), path)
    return read_revocations(claims.sparkSession, path)


def read_revocations(spark, path) -> DataFrame:
    """An index written here. An id may have several rows; the earliest counts, and rows
    whose claim is not in the log yet have no slot."""
    return spark.read.parquet(path).withColumn("slot", F.col("slot").cast("string"))


def append_indexed(batch, log_path, index_path) -> None:
    """Adds a batch of claims to a log and what it revokes to the log's index. What an
    earlier batch revoked before its claim came gets its pair now. The index is written
    first: a run that stops between the two can be repeated, since claims already written
    are left out and a repeated index row changes nothing."""
    spark = batch.sparkSession
    log, batch = read_claims(spark, log_path), kept(batch)
    columns = ["id", "subject", "slot"]
    fresh = revocations_of(batch, log.select(*columns).unionByName(batch.select(*columns))
                           .distinct())
    waiting = read_revocations(spark, index_path).where("slot is null").select("id", "revoked_at")
    placed = waiting.join(batch.select(*columns), "id")
    _append(kept(fresh.unionByName(placed.select(*fresh.columns))), index_path)
    append_claims(batch, log_path, known_ids=log)

"""Keeping the current state of a log current as claims are appended.

Rebuilding reads the whole log; here a micro-batch touches only the pairs it speaks
of and the pairs owning an id it revokes. The state is a table of buckets of pairs,
of which a batch rewrites those it touches.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import standing, standing_of


def bucketed(df, buckets):
    """Adds the bucket a pair's state is kept in."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("subject", "slot"), F.lit(buckets))
                         .cast("int"))


def touched_pairs(batch, claims) -> DataFrame:
    """Pairs whose winner may change: those spoken of, and those of revoked claims."""
    owners = claims.join(batch.where(F.col("revokes").isNotNull())
                         .select(F.col("revokes").alias("id")).distinct(), "id", "left_semi")
    return (batch.select("subject", "slot")
            .unionByName(owners.select("subject", "slot")).distinct())


def refresh_state(batch, claims, path, valid_at, as_of, buckets) -> None:
    """Recomputes the buckets a batch touches and overwrites only them."""
    spark = claims.sparkSession
    touched = bucketed(touched_pairs(batch, claims), buckets).select("bucket").distinct()
    whole = bucketed(claims, buckets).join(touched, "bucket", "left_semi")
    pairs = whole.select("subject", "slot").distinct()
    won = bucketed(standing_of(claims, pairs, valid_at, as_of), buckets)
    # A bucket left with nothing standing must still replace what it held before.
    won = touched.join(won, "bucket", "left").select(*won.columns)
    (won.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket").parquet(path))


def maintain(stream, read_claims, state_path, checkpoint, valid_at, as_of, buckets=64,
             **trigger):
    """Runs `refresh_state` for every micro-batch of a stream of appended claims.

    `read_claims()` gives the log as it is when the batch runs; replaying a batch
    recomputes the same buckets, so a retry changes nothing.
    """
    def step(batch, _):
        refresh_state(batch, read_claims(), state_path, valid_at, as_of, buckets)

    return (stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def current_state(spark, path) -> DataFrame:
    return spark.read.parquet(path).where("subject IS NOT NULL").drop("bucket")


def rebuild(claims, path, valid_at, as_of, buckets=64):
    """The whole state at once, the starting point for `maintain`."""
    (bucketed(standing(claims, valid_at, as_of), buckets)
     .write.mode("overwrite").partitionBy("bucket").parquet(path))

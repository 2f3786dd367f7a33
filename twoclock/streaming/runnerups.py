"""The standing state of a stream of claims, kept with its runner-ups.

A revocation may bring back a claim that had lost. So the state keeps, beside the winner
of each pair, every other claim that is still a candidate, with its place; then a batch
needs the state and itself, never the log. Three tables lie under one path:

* `held`, by bucket of pairs: the candidates with their `place` in the pair, 1 standing;
* `owners`, by bucket of ids: which bucket of pairs a claim lies in, to find what a later
  batch revokes;
* `withdrawn`, by bucket of ids: what was revoked, for claims that arrive after that.

A batch reads the `owners` and `withdrawn` of the id buckets it names, and reads and
rewrites the `held` of the pair buckets it touches. Each step may run again with the same
result: ids already there are not added twice.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.clocks import instant_column
from ..operators.resolve import RANK, states_something, visible
from ..session import kept

_HELD = ["id", "seq", "subject", "slot", "value", "valid_from", "recorded_at", "revokes"]
_IDS = "id string, pair_bucket int, id_bucket int"


class RunnerUps:
    """State at one clock pair under `path`. The numbers of buckets are fixed by the first
    use: `buckets` of pairs and of ids, to be chosen so that one bucket suits one task.
    `clock_type` is the type of the log's clocks."""

    def __init__(self, spark, path, valid_at, as_of, buckets, clock_type="timestamp_ntz"):
        self.clock_type = clock_type
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.valid_at, self.as_of = valid_at, as_of

    # -- reading -----------------------------------------------------------------

    def held(self) -> DataFrame:
        """Every candidate with its place in its pair."""
        t = self.clock_type
        return self._read("held", "id string, seq bigint, subject string, slot string, "
                          f"value string, valid_from {t}, recorded_at {t}, revokes string, "
                          "place int, pair_bucket int").where("id is not null")

    def standing(self) -> DataFrame:
        """The winner of every pair: no shuffle, the place is written down."""
        return self.held().where("place = 1").select(*_HELD)

    def _read(self, name, shape):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.read.schema(shape).parquet(f"{self.path}/{name}")
        return self.spark.createDataFrame([], shape)

    # -- a batch -----------------------------------------------------------------

    def take(self, batch: DataFrame) -> None:
        """Brings the state up to date with a batch of claims."""
        batch = kept(batch.select(*_HELD))
        as_of = instant_column(self.as_of, batch.schema["recorded_at"].dataType)
        revoked = (batch.where(F.col("revokes").isNotNull() & (F.col("recorded_at") <= as_of))
                   .select(F.col("revokes").alias("id")).distinct())
        revoked = kept(self._by_id(revoked).withColumn("pair_bucket", F.lit(None).cast("int")))
        fresh = kept(self._by_id(self._by_pair(
            batch.where(visible(batch, self.valid_at, self.as_of) & states_something(batch)))))
        self._append("withdrawn", revoked)
        self._append("owners", fresh)

        # Either may name the other first: what is revoked here may lie in the state, and
        # what arrives here may have been revoked before.
        found = self._of_ids("owners", revoked).select("pair_bucket").distinct()
        gone = self._of_ids("withdrawn", fresh.select("id", "id_bucket")).select("id") \
            .unionByName(revoked.select("id")).distinct()
        numbers = sorted({r[0] for r in found.unionByName(
            fresh.select("pair_bucket").distinct()).collect()})
        if not numbers:
            return
        before = self.held().where(F.col("pair_bucket").isin(numbers)).drop("place")
        rows = (before.unionByName(fresh.drop("id_bucket").join(
                    before.select("id"), "id", "left_anti").select(*before.columns))
                .join(gone, "id", "left_anti"))
        place = F.row_number().over(W.partitionBy("subject", "slot").orderBy(
            *[F.col(c).desc() for c in RANK]))
        rows = rows.withColumn("place", place)
        # A bucket that is left empty must replace what it held.
        empty = self.spark.createDataFrame([(n,) for n in numbers], "pair_bucket int")
        (kept(rows.unionByName(empty, allowMissingColumns=True)).hint("rebalance", "pair_bucket")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("pair_bucket").parquet(f"{self.path}/held"))

    def _by_pair(self, df):
        return df.withColumn("pair_bucket", F.pmod(
            F.xxhash64("subject", "slot"), F.lit(self.buckets)).cast("int"))

    def _by_id(self, df):
        return df.withColumn("id_bucket", F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int"))

    def _of_ids(self, name, ids):
        """Rows of an id table for some ids; only their buckets are opened."""
        numbers = [r[0] for r in ids.select("id_bucket").distinct().collect()]
        return (self._read(name, _IDS).where(F.col("id_bucket").isin(numbers))
                .join(ids.select("id"), "id", "left_semi"))

    def _append(self, name, rows):
        (rows.select("id", "pair_bucket", "id_bucket").hint("rebalance", "id_bucket")
         .write.mode("append").partitionBy("id_bucket").parquet(f"{self.path}/{name}"))


def follow(stream, state: RunnerUps, checkpoint, **trigger):
    """Takes every micro-batch of a stream of appended claims into the state."""
    return (stream.writeStream.foreachBatch(lambda batch, _: state.take(batch))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())

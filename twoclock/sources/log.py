"""Reading and writing the log and the tables derived from it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ASSERTION, CLAIM, ENTITY, INTENT

_SHAPES = {"claim": CLAIM, "assertion": ASSERTION, "intent": INTENT, "entity": ENTITY}


def read_log(spark, path, shape="claim", format="parquet", **options) -> DataFrame:
    """A log table with its declared schema, so no file is opened to infer one."""
    return spark.read.format(format).options(**options).schema(_SHAPES[shape]).load(path)


def read_jdbc(spark, url, table, *, partition_column, lower, upper, partitions,
              **options) -> DataFrame:
    """A log table out of a database, read in parallel ranges of one column."""
    return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower,
                           upperBound=upper, numPartitions=partitions,
                           properties={k: str(v) for k, v in options.items()})


def append_claims(claims, path, known_ids=None):
    """Adds claims to a log laid out by slot; the only writer there is, and it only
    appends. The rebalance keeps files near the advisory size however the rows fall
    on slots: a large slot is split over many tasks, small ones share one. Rows whose
    id is in `known_ids` are already written and are left out."""
    if known_ids is not None:
        claims = claims.join(known_ids.select("id"), "id", "left_anti")
    (claims.hint("rebalance", "slot").sortWithinPartitions("slot", "subject")
     .write.mode("append").partitionBy("slot").parquet(path))


def read_claims(spark, path) -> DataFrame:
    """A log written by `append_claims`."""
    return spark.read.parquet(path).withColumn("slot", F.col("slot").cast("string"))


def refresh_table(df, name) -> DataFrame:
    """Replaces a derived table whole and reads it back."""
    df.write.mode("overwrite").format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)


def write_snapshot(stated, path) -> DataFrame:
    """The state at one clock pair as a table by slot: lineage is cut, and every
    table derived from it reads only its own slots."""
    (stated.select("subject", "slot", "value").hint("rebalance", "slot")
     .write.mode("overwrite").partitionBy("slot").parquet(path))
    return read_snapshot(stated.sparkSession, path)


def read_snapshot(spark, path) -> DataFrame:
    """A state written by `write_snapshot`."""
    return spark.read.parquet(path).withColumn("slot", F.col("slot").cast("string"))


def refresh_all(stated, specs, path=None, prefix="") -> dict:
    """Every derivable table from one state: grouped ones first, then entity lists.
    `stated` is a frame (subject, slot, value), of which a snapshot is written under `path`,
    or a view at two clocks, of which nothing is written: each table reads its own slots."""
    from ..operators.project import StatedView, project
    from ..plans.spec import GroupedSpec

    view = stated if hasattr(stated, "of_class") else StatedView(write_snapshot(stated, path))
    ordered = sorted(specs, key=lambda s: not isinstance(s, GroupedSpec))
    return {s.table: refresh_table(project(view, s), prefix + s.table) for s in ordered}


def load_versions(versions) -> DataFrame:
    """The version dimension (ordinal, version, valid_from, sealed_at, supersedes), of any
    length. Rows lacking a version, `valid_from` or `sealed_at` are refused."""
    held = versions.select("ordinal", "version", "valid_from", "sealed_at", "supersedes")
    needed = ("version", "valid_from", "sealed_at")
    lacking = held.where(" or ".join(f"{key} is null" for key in needed))
    for row in lacking.orderBy("ordinal").limit(1).collect():
        key = next(k for k in needed if row[k] is None)
        raise ValueError(f"version {row['version'] or row['ordinal']} has no {key}")
    return held

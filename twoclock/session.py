"""Session defaults and the shared folder that survives executor loss."""

import hashlib
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(app="twoclock", master=None, **conf):
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """The folder for checkpoints and cut lineage, as the cluster names it.

    Only a local session, whose executors all see one disk, may fall back to a
    folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; name a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def kept(df):
    """`df` computed once and read back from a table in the shared folder: lineage is
    cut, and a lost executor costs no recomputation of what is above."""
    spark = df.sparkSession
    path = scratch_path(spark, "kept")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark, *parts):
    """A fresh path under the shared folder."""
    label = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12]
    return f"{shared_dir(spark).rstrip('/')}/twoclock/{label}-{uuid.uuid4().hex[:8]}"

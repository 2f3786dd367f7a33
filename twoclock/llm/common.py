"""Helpers shared by the operators of this subpackage."""

import ctypes
import os
import sys
import types
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from twoclock.session import kept

# Columns the operators add on the way carry this prefix, so that columns of the given
# tables may have any other name.
OWN = "__llm_"


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def drop_written(df):
    """Deletes the files behind a frame that `kept` wrote and nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def bucket_of(column, modulus):
    """crc32 of the id written as text, modulo `modulus`: the folds of the labels. A row
    without an id is in no fold (NULL)."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(modulus))


def crc_fold(value, modulus):
    """The same fold in Python."""
    return zlib.crc32(str(value).encode()) % modulus


def per_worker(key, make):
    """`make()`, once in the life of a Python worker: what costs time to load or learns
    as it goes is there for the worker's later tasks too. It must not change results."""
    home = sys.modules.setdefault("_twoclock_worker", types.ModuleType("_twoclock_worker"))
    held = home.__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]


def tidy(run):
    """A function of batches that gives memory no longer used back to the machine when its
    task ends. A Python worker serves many tasks and would keep what its largest one took."""
    def through(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
    return through


def _spanning_stars(batches):
    """The edges of one partition as (larger id, smallest id it reaches here)."""
    parent = {}

    def find(x):
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            if a < b:
                parent[b] = a
            elif b < a:
                parent[a] = b
    rows = [(x, r) for x in list(parent) if (r := find(x)) != x]
    yield pd.DataFrame(rows, columns=["a", "b"]).astype("int64")


def components(edges):
    """(node, component) for every node of `edges`, a frame of two long columns `a`, `b`;
    the component is the smallest node reachable. Duplicate edges and loops are allowed,
    empty edges give an empty frame.

    Partitions first shrink their edges to stars; then large-star and small-star rounds
    run until nothing changes. Both keep the number of edges at most linear. A hub is
    reduced by a map-side minimum, and each round is a table in the shared folder.
    """
    schema = "a long, b long"
    state = kept(edges.select("a", "b").where("a <> b").hint("rebalance")
                 .mapInPandas(_spanning_stars, schema))
    mark = None
    while True:
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"),
                                                           F.col("m").alias("b"))
                 .unionByName(low.where("m < a").select("a", F.col("m").alias("b"))))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))))
        after = kept(small.distinct())
        seen = after.agg(F.count(F.lit(1)).alias("n"),
                         F.expr("bit_xor(xxhash64(a, b))").alias("x")).head()
        drop_written(state)
        state = after
        if mark == (seen["n"], seen["x"]):
            break
        mark = (seen["n"], seen["x"])
        if not seen["n"]:
            break
    return (state.groupBy("a").agg(F.min("b").alias("c"))
            .unionByName(state.select(F.col("b").alias("a"), F.col("b").alias("c")).distinct())
            .groupBy("a").agg(F.min("c").alias("c"))
            .select(F.col("a").alias("node"), F.col("c").alias("component")))

"""Choosing the version in force at two clocks, whatever the number of versions.

Of the versions sealed by `as_of` and valid from `valid_at` or before, the one sealed
last is wanted. Versions are numbered as they were sealed and form a search tree of
`FANOUT` entries a node; each entry holds the earliest seal and the earliest `valid_from`
below it. A row goes down the tree by its `as_of`, which splits the versions sealed by
then into the nodes passed on the left; the last of those that holds an early enough
`valid_from` contains the answer, and the row goes down from there by `valid_at`.

Every step is an equi-join on a node number, so nothing is compared with every version.
For v versions there are 2 log(v) - 1 steps, base FANOUT. Spark broadcasts a level that is
small and shuffles one that is not; adaptive execution splits a node that a large part of
all rows goes through, such as the last one sealed.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clocks import instant_column
from ..session import kept
from .ranking import position

FANOUT = 64


class VersionTree:
    """The tree of a frame of versions (ordinal, version, valid_from, sealed_at), written
    once: `levels[0]` has nodes of versions, each further level nodes of nodes."""

    def __init__(self, versions: DataFrame, fanout=FANOUT):
        self.fanout = fanout
        self.version_type = versions.schema["version"].dataType.simpleString()
        place = position(
            versions.select("version", "ordinal", *[instant_column(F.col(c)).alias(c)
                                                    for c in ("sealed_at", "valid_from")]),
            [], ["sealed_at", "ordinal", "version"], "place", start=0)
        below = kept(place.select("place", F.col("sealed_at").alias("seal"),
                                  F.col("valid_from").alias("valid"), "version"))
        self.levels = []
        while True:
            node = F.floor(F.col("place") / fanout).alias("node")
            entry = F.struct(F.pmod("place", F.lit(fanout)).cast("int").alias("at"),
                             "seal", "valid", *(["version"] if not self.levels else []))
            level = kept(below.groupBy(node).agg(F.sort_array(F.collect_list(entry))
                                                 .alias("entries"), F.count(F.lit(1)).alias("n")))
            self.levels.append(level)
            if level.agg(F.max("node")).head()[0] in (None, 0):
                break
            below = level.select(F.col("node").alias("place"),
                                 F.array_min("entries.seal").alias("seal"),
                                 F.array_min("entries.valid").alias("valid"))

    def newest(self):
        """The version sealed last, as a column."""
        last = self.levels[0].orderBy(F.col("node").desc()).limit(1)
        return last.select(F.element_at("entries.version", -1)).scalar()

    def choose(self, rows, valid_at, as_of, name="version"):
        """Adds the version in force at the two clock columns, NULL where there is none
        or a clock is NULL. Rows of the same clocks have the same version, so each pair of
        clocks goes down the tree once, and rows meet the pairs in one join."""
        va, ao = instant_column(F.col(valid_at)), instant_column(F.col(as_of))
        clocks = rows.select(va.alias("_va"), ao.alias("_ao")).where(
            "_va IS NOT NULL AND _ao IS NOT NULL").distinct()
        found = self._down(clocks).select("_va", "_ao", F.col("_found").alias("_version"))
        side = found.withColumnsRenamed({"_va": "_va2", "_ao": "_ao2"})
        return (rows.join(side, (va == F.col("_va2")) & (ao == F.col("_ao2")), "left")
                .withColumn(name, F.col("_version")).drop("_va2", "_ao2", "_version"))

    def _down(self, rows):
        """Adds `_found`, the version for the clocks `_va` and `_ao` of each row."""
        rows = rows.withColumns({"_node": F.lit(0).cast("long"),
                                 "_from": F.lit(None).cast("long"),
                                 "_level": F.lit(None).cast("int")})
        top = len(self.levels) - 1
        for level in range(top, -1, -1):
            rows = self._entered(rows, level, "_node")
            sealed = F.size(F.filter("_entries", lambda e: e["seal"] <= F.col("_ao"))) - 1
            rows = rows.withColumn("_at", sealed)
            # Left of the path, or on it at the bottom: all sealed in time.
            early = F.array_max(F.transform(F.filter("_entries", lambda e: (
                (e["at"] <= F.col("_at") - (1 if level else 0)) & (e["valid"] <= F.col("_va")))),
                lambda e: e["at"]))
            child = F.col("_node") * self.fanout
            rows = rows.withColumn("_early", early)
            # A lower level is later in the order of seals, so it comes last and wins.
            rows = rows.withColumns({
                "_from": F.coalesce(child + F.col("_early"), "_from"),
                "_level": F.when(F.col("_early").isNotNull(), level).otherwise(F.col("_level")),
                "_node": F.when(F.col("_at") >= 0, child + F.col("_at"))})
            if level == 0:
                rows = rows.withColumn("_found", F.get("_entries.version", F.col("_early")))
            rows = rows.drop("_entries", "_at", "_early")
        for level in range(top - 1, -1, -1):
            # Only rows whose answer lies under a node to the left go down again.
            rows = rows.withColumn("_down", F.when(F.col("_level") > level, F.col("_from")))
            rows = self._entered(rows, level, "_down")
            early = F.array_max(F.transform(F.filter(
                "_entries", lambda e: e["valid"] <= F.col("_va")), lambda e: e["at"]))
            rows = rows.withColumn("_early", early)
            if level == 0:
                rows = rows.withColumn(
                    "_found", F.coalesce("_found", F.get("_entries.version", F.col("_early"))))
            rows = (rows.withColumn("_from", F.coalesce(
                F.col("_down") * self.fanout + F.col("_early"), "_from"))
                .drop("_entries", "_early", "_down"))
        return rows

    def _entered(self, rows, level, node):
        """Rows with the entries of the node named in a column, NULL where it is NULL. The
        top level is one node, the same for all rows. Rows without a node are spread over numbers that no node has, so they fill no single task."""
        if level == len(self.levels) - 1:
            return rows.withColumn("_entries", self.levels[level].select("entries").scalar())
        side = self.levels[level].select(F.col("node").alias("_side"),
                                         F.col("entries").alias("_entries"))
        nowhere = -1 - F.pmod(F.xxhash64("_va", "_ao"), F.lit(1 << 20))
        return (rows.withColumn("_key", F.coalesce(node, nowhere))
                .join(side, F.col("_key") == F.col("_side"), "left").drop("_side", "_key"))


def version_as_of(rows, versions, valid_at, as_of, or_newest=False) -> DataFrame:
    """Adds `version`: of those sealed by `as_of` and in force at `valid_at`, the one sealed
    last; equal seals go by `ordinal`, then by `version`. Where there is none, NULL, or
    with `or_newest` the one sealed last of all.

    `versions` is a frame (ordinal, version, valid_from, sealed_at) of any length, as
    `load_versions` returns it, a tree made of one before, or a list of such rows.
    """
    if isinstance(versions, list):
        versions = _framed(rows.sparkSession, versions)
    tree = versions if isinstance(versions, VersionTree) else VersionTree(versions)
    found = tree.choose(rows, valid_at, as_of)
    if or_newest:
        found = found.withColumn("version", F.coalesce("version", tree.newest()))
    return found


def _framed(spark, versions):
    """A list of version rows as a frame; their place in the list is the ordinal."""
    empty = spark.createDataFrame(
        [], "ordinal int, version string, valid_from timestamp_ntz, sealed_at timestamp_ntz")
    parts = [spark.range(1).select(
        F.lit(n).alias("ordinal"), F.lit(v["version"]).alias("version"),
        instant_column(v["valid_from"]).alias("valid_from"),
        instant_column(v["sealed_at"]).alias("sealed_at")) for n, v in enumerate(versions)]
    return reduce(lambda a, b: a.unionByName(b), parts, empty)

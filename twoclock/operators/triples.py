"""Domains and ranges read off restriction triples, and the closure of a class tree.

A triples frame has `s, p, o`; blank nodes start with `_:`.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept

TYPE, SUBCLASS = "rdf:type", "rdfs:subClassOf"
DOMAIN, RANGE = "rdfs:domain", "rdfs:range"
CLASS, RESTRICTION, OBJECT_PROPERTY = "owl:Class", "owl:Restriction", "owl:ObjectProperty"
ON, ALL_FROM = "owl:onProperty", "owl:allValuesFrom"
# What counts as a property.
PROPERTY_TYPES = ["owl:ObjectProperty", "owl:DatatypeProperty", "owl:AnnotationProperty",
                  "rdf:Property"]


def _pairs(triples, predicate, s, o):
    return triples.where(F.col("p") == predicate).select(
        F.col("s").alias(s), F.col("o").alias(o))


def _named(column):
    return ~F.col(column).startswith("_:")


def properties(triples):
    return (triples.where((F.col("p") == TYPE) & F.col("o").isin(PROPERTY_TYPES))
            .select(F.col("s").alias("property")).distinct())


def restrictions(triples):
    """(node, property) of every restriction node; its first property if it has more."""
    nodes = triples.where((F.col("p") == TYPE) & (F.col("o") == RESTRICTION)).select(
        F.col("s").alias("node"))
    return (_pairs(triples, ON, "node", "property").join(nodes, "node", "left_semi")
            .groupBy("node").agg(F.min("property").alias("property")))


def _class_list(df, group, member):
    """Sorted distinct members of a group. Duplicates go first, on the map side, so
    what is gathered is one entry per class however often it was said."""
    return (df.select(group, member).distinct().groupBy(group)
            .agg(F.array_sort(F.collect_set(member)).alias("members")))


def inferred(triples) -> DataFrame:
    """(property, side, outcome, members): for each property the classes that restrict
    it as its domain, and its range where it states none. The outcome is `single`,
    `union`, `none`, or for a range `kept`, `added`, `none`."""
    found = restrictions(triples)
    subclass = _pairs(triples, SUBCLASS, "class", "node").where(_named("class"))
    domains = _class_list(subclass.join(found, "node"), "property", "class")
    targets = _pairs(triples, ALL_FROM, "node", "target").where(_named("target"))
    used = triples.where(F.col("p") == SUBCLASS).select(F.col("o").alias("node")).distinct()
    ranges = _class_list(targets.join(found, "node").join(used, "node", "left_semi"),
                         "property", "target")
    stated = (triples.where(F.col("p") == RANGE)
              .select(F.col("s").alias("property"), F.lit(True).alias("_stated")).distinct())
    props = properties(triples)
    domain_side = props.join(domains, "property", "left").select(
        "property", F.lit("domain").alias("side"),
        F.when(F.col("members").isNull(), "none").when(F.size("members") == 1, "single")
        .otherwise("union").alias("outcome"), "members")
    range_side = (props.join(stated, "property", "left").join(ranges, "property", "left")
                  .select("property", F.lit("range").alias("side"),
                          F.when(F.col("_stated"), "kept")
                          .when(F.col("members").isNull(), "none")
                          .otherwise("added").alias("outcome"),
                          F.when(F.col("_stated").isNull(), F.col("members"))
                          .alias("members")))
    return domain_side.unionByName(range_side)


def outcome_counts(inferred_) -> DataFrame:
    return inferred_.groupBy("side", "outcome").agg(F.count(F.lit(1)).alias("properties"))


def drawable_edges(triples) -> DataFrame:
    """Object properties with a domain and a range that is a class."""
    objects = triples.where((F.col("p") == TYPE) & (F.col("o") == OBJECT_PROPERTY)).select(
        F.col("s").alias("property")).distinct()
    classes = triples.where((F.col("p") == TYPE) & (F.col("o") == CLASS)).select(
        F.col("s").alias("end"))
    ends = _pairs(triples, RANGE, "property", "end").join(classes, "end", "left_semi")
    return (objects.join(_pairs(triples, DOMAIN, "property", "d").select("property"),
                         "property", "left_semi")
            .join(ends.select("property"), "property", "left_semi"))


def with_inferred(triples, inferred_) -> DataFrame:
    """The triples and what was inferred, as triples; a union is one node named after
    its members."""
    said = inferred_.where(F.col("members").isNotNull()).select(
        F.col("property").alias("s"),
        F.when(F.col("side") == "domain", DOMAIN).otherwise(RANGE).alias("p"),
        F.when(F.size("members") == 1, F.col("members")[0])
        .otherwise(F.concat(F.lit("_:union("), F.array_join("members", ","), F.lit(")")))
        .alias("o"))
    return triples.unionByName(said)


def closure(edges) -> DataFrame:
    """(ancestor, descendant), each class with itself, of parent edges (parent, child).

    Paths found in a round are joined with all known ones at both ends, so lengths double
    and a tree of depth d takes about log2(d) rounds; rounds go on until one finds nothing.
    Only new paths are joined and written: plans stay short, and a lost executor costs
    one round. Jobs run while the frame is built.
    """
    edges = edges.where("parent IS NOT NULL").select("parent", "child").distinct()
    paths = kept(edges.select(F.col("parent").alias("ancestor"),
                                      F.col("child").alias("descendant")))
    found = paths
    while found.head(1):
        known = paths.select(F.col("ancestor").alias("_mid"), "descendant")
        after = (found.select("ancestor", F.col("descendant").alias("_mid")).join(known, "_mid")
                 .select("ancestor", "descendant"))
        before = (paths.select("ancestor", F.col("descendant").alias("_mid"))
                  .join(found.select(F.col("ancestor").alias("_mid"), "descendant"), "_mid")
                  .select("ancestor", "descendant"))
        found = kept(after.unionByName(before).distinct()
                     .join(paths, ["ancestor", "descendant"], "left_anti"))
        paths = paths.unionByName(found)
    selves = (edges.select(F.explode(F.array("parent", "child")).alias("ancestor")).distinct()
              .withColumn("descendant", F.col("ancestor")))
    return paths.unionByName(selves).distinct()


def ancestors_of(edges, nodes) -> DataFrame:
    """(ancestor, descendant), each node with itself, for the asked `nodes` (column `node`)
    alone, of parent edges (parent, child) that may run in circles.

    Jumps of 1, 2, 4 … steps are made by joining jumps of half the length; they end when
    none is left or they are longer than any path without a repeat. Every distance is a
    sum of different jumps, so going through them once, longest first, finds all
    ancestors of the asked nodes in as many joins as the depth has binary digits. In a tree
    there are no more jumps of a length than nodes; the pairs of nodes nobody asked for
    are never made.
    """
    steps = kept(edges.where("parent IS NOT NULL AND child IS NOT NULL AND parent <> child")
                 .select(F.col("child").alias("low"), F.col("parent").alias("high")).distinct())
    count = steps.select(F.explode(F.array("low", "high"))).distinct().count()
    jumps, length = [steps], 1
    while 2 * length < count:
        half = jumps[-1]
        longer = kept(half.join(half.select(F.col("low").alias("_mid"), F.col("high").alias("_top")),
                                F.col("high") == F.col("_mid"))
                      .select("low", F.col("_top").alias("high")).distinct())
        if longer.isEmpty():
            break
        jumps.append(longer)
        length *= 2
    found = nodes.where("node IS NOT NULL").select(
        F.col("node").alias("ancestor"), F.col("node").alias("descendant")).distinct()
    for jump in reversed(jumps):
        further = (found.join(jump, F.col("ancestor") == F.col("low"))
                   .select(F.col("high").alias("ancestor"), "descendant"))
        found = kept(found.unionByName(further).distinct())
    return found

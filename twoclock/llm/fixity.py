"""WARC records and the Merkle audit of their replicas."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from twoclock.session import kept

from .common import drop_written

#: Children of a node; an archive file is a node of the third level, 4,096 records.
FANOUT = 16
PER_ARCHIVE = FANOUT ** 3


def warc_record(page_id, url, html):
    """The bytes of a response record; null fields are empty."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (page_id, url, html)]
    size = F.octet_length(text[2])
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), text[1],
        F.lit("\r\nWARC-Record-ID: <urn:page:"), text[0],
        F.lit(">\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"), text[2],
        F.lit("\r\n\r\n"))


def archived(pages, page_id="page_id", url="url", html="html", also=None):
    """(position, archive, page_id, length, digest and, for each name of `also`, another
    digest) of every page in the order of page_id (rows without one first), then digest.

    `also` maps names to columns that stand for `html` in a replica of the same layout.
    Only ids, lengths and digests are shuffled. Rows are dealt by ranges, so a repeated
    page_id is spread by its digests; positions are those within a range plus the sizes
    of the ranges before it.
    """
    def digest(body):
        return F.unhex(F.sha2(warc_record(F.col(page_id), F.col(url), body).cast("binary"), 256))

    others = dict(also or {})
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        F.octet_length(warc_record(F.col(page_id), F.col(url), F.col(html))).cast("long")
        .alias("length"), digest(F.col(html)).alias("digest"),
        *[digest(body).alias(name) for name, body in others.items()])
    rows = kept(rows.withColumn("tie", F.monotonically_increasing_id()))
    order = ["page_id", "digest", "tie"]
    ranged = kept(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before, total = {}, 0
    for r in (ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()):
        before[r["part"]] = total
        total += r["n"]
    base = F.element_at(F.array(*[F.lit(before.get(p, 0)).cast("long") for p in
                                  range(max(before, default=0) + 1)]), F.col("part") + 1)
    at = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1 + base
    placed = ranged.withColumn("position", at.cast("long"))
    return placed.select("position", F.floor(F.col("position") / PER_ARCHIVE).cast("long")
                         .alias("archive"), "page_id", "length", "digest", *others)


def with_offsets(records):
    """Adds the offset of each record in its archive, a file of bounded size."""
    rows = W.partitionBy("archive").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(rows), F.lit(0)))


def tree(records):
    """Levels of a Merkle tree over records (position, offset, length, digest): frames
    (node, hash, first, last), leaves first, up to one root. A leaf hashes a record's
    digest with its offset range; a node hashes its children in order and the range of
    positions under it. Each level is a table in the shared folder. No records, one empty
    level."""
    def hashed(*parts):
        return F.unhex(F.sha2(F.concat(*parts), 256))

    def number(column):
        return F.unhex(F.lpad(F.hex(column), 16, "0"))

    level = kept(records.select(
        F.col("position").alias("node"),
        hashed("digest", number(F.col("offset")), number(F.col("offset") + F.col("length")))
        .alias("hash"), F.col("position").alias("first"), F.col("position").alias("last")))
    levels = [level]
    top = level.agg(F.max("node").alias("top")).head()["top"]
    while top:
        under = level.groupBy(F.floor(F.col("node") / FANOUT).cast("long").alias("node")).agg(
            F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("under"),
            F.min("first").alias("first"), F.max("last").alias("last"))
        joined = F.aggregate("under", F.lit(b""), lambda s, c: F.concat(s, c["hash"]))
        level = kept(under.select(
            "node", hashed(joined, number(F.col("first")), number(F.col("last"))).alias("hash"),
            "first", "last"))
        levels.append(level)
        top //= FANOUT
    return levels


def mismatches(left, right):
    """Positions of the leaves in which two trees differ, from the roots down: only
    children of differing nodes are read into a comparison. A tree may be shorter; then
    it is compared from its own height, where the taller has further nodes."""
    height = min(len(left), len(right))
    wrong = None
    for a, b in zip(reversed(left[:height]), reversed(right[:height]), strict=True):
        a, b = (x.select("node", "hash", F.floor(F.col("node") / FANOUT).cast("long")
                         .alias("above")) for x in (a, b))
        if wrong is not None:
            up = wrong.select(F.col("node").alias("above"))
            a, b = a.join(up, "above", "left_semi"), b.join(up, "above", "left_semi")
        both = (a.select("node", "hash").withColumnRenamed("hash", "was")
                .join(b.select("node", "hash"), "node", "full")
                .where(~F.col("was").eqNullSafe(F.col("hash"))).select("node"))
        before, wrong = wrong, kept(both)
        if before is not None:
            drop_written(before)
    return wrong.select(F.col("node").alias("position"))


def audit(original, replica):
    """(position, archive, page_id, offset, length, fault) of every record in which the
    replica differs from the original, both (position, archive, page_id, offset, length,
    digest): `missing` or `extra` in the replica, `altered` if the digest differs, else
    `moved`. Equal replicas give no rows; either may be empty."""
    wrong = mismatches(tree(original), tree(replica))
    was = original.join(wrong, "position", "left_semi")
    now = replica.join(wrong, "position", "left_semi").select(
        "position", *[F.col(c).alias("now_" + c) for c in
                      ("archive", "page_id", "offset", "length", "digest")])
    fault = (F.when(F.col("now_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra")
             .when(F.col("digest") != F.col("now_digest"), "altered").otherwise("moved"))
    return was.join(now, "position", "full").select(
        "position", *[F.coalesce(c, "now_" + c).alias(c)
                      for c in ("archive", "page_id", "offset", "length")], fault.alias("fault"))

"""Near-duplicates by the similarity of their word shingles, beside those of SimHash.

A text is cut into shingles once. What is kept of it is a prefix of its set of shingle
hashes, by which similar texts meet, and a sketch of the set: a bitmap of about two bits a
shingle in which each shingle turns one bit over. Two sketches differ in no more bits than
the sets in shingles, so a pair whose sketches differ too much is done with; the texts of
the few other pairs are fetched and compared exactly. No set and no other text is moved.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from twoclock.session import kept

from .common import OWN, components, drop_written, tidy
from .simhash import fingerprint_of, links

#: Rounding in products of `least` must lose no pair.
_SLACK = 1e-9


def shingles_of(text, words=5):
    """Sorted hashes of the different shingles of UTF-8 bytes (None: no text), cut as
    those of `fingerprint_of`."""
    held = (text or b"").lower().split()
    if len(held) < words:
        cut = [b" ".join(held)] if held else []
    else:
        cut = map(b" ".join, zip(*(held[k:] for k in range(words))))
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(s) for s in cut),
                                 np.uint64).view(np.int64))


def _lists(arrays):
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _shingled(texts, words):
    """(node, shingles) of a frame of node and text as bytes."""
    def run(batches):
        for batch in batches:
            sets = [shingles_of(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)],
                                             ["node", "shingles"])
    return texts.mapInArrow(tidy(run), "node long, shingles array<long>")


def sketch_of(shingles):
    """The bitmap of a set of hashes: a power of two of bits, two or more a hash."""
    bits = max(256, 1 << (2 * len(shingles) - 1).bit_length()) if len(shingles) else 256
    turned = np.bincount(shingles & (bits - 1), minlength=bits) & 1
    return np.packbits(turned.astype(np.uint8), bitorder="little").tobytes()


def sketches_differ(x, y):
    """In how many bits two sketches differ, the larger folded to the size of the other:
    a lower bound of in how many hashes the sets differ."""
    x, y = sorted((np.frombuffer(s, np.uint8) for s in (x, y)), key=len)
    while len(y) > len(x):
        y = y[:len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _common(texts, words, sample=4000, most=50_000):
    """(hashes, counts) of shingles common in a bounded sample. They only set the order
    in which shingles are looked at: any order finds every pair."""
    part = max(1, texts.count() // sample)
    counts = (_shingled(texts.where(F.pmod("node", F.lit(part)) == 0), words)
              .select(F.explode("shingles").alias("h")).groupBy("h")
              .agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
              .orderBy(F.desc("n"), "h").limit(most).collect())
    counts.sort()
    return (np.array([r["h"] for r in counts], np.int64),
            np.array([r["n"] for r in counts], np.int64))


def _marked(texts, threshold_words, words, least):
    """(id, node, fingerprint, size, prefix, sketch) of each row: of the shingles in order,
    rare ones first, one more than may be missing from the other text."""
    common, counts = _common(texts.select("node", "text"), words)

    def run(batches):
        for batch in batches:
            prints, sizes, prefixes, sketches = [], [], [], []
            for text in batch.column(2):
                text = text.as_py()
                held = shingles_of(text, words)
                prints.append(fingerprint_of(text, threshold_words))
                sizes.append(len(held))
                sketches.append(sketch_of(held))
                if len(common):
                    at = np.minimum(np.searchsorted(common, held), len(common) - 1)
                    often = np.where(common[at] == held, counts[at], 0)
                    held = held[np.argsort(often, kind="stable")]
                prefixes.append(held[:len(held) - math.ceil(least * len(held) - _SLACK) + 1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.int64()),
                 pa.array(sizes, pa.int32()), _lists(prefixes), pa.array(sketches, pa.binary())],
                ["id", "node", "fingerprint", "size", "prefix", "sketch"])
    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "node", "text").mapInArrow(
        tidy(run), f"id {kind}, node long, fingerprint long, size int, prefix array<long>, "
             "sketch binary")


def _may_reach(least, size, at, other_size, other_at):
    """Whether two texts whose first common shingle is at these places can be alike."""
    n, m = F.col(size), F.col(other_size)
    after = F.least(n - F.col(at), m - F.col(other_at))
    return ((F.least(n, m) >= least * F.greatest(n, m) - _SLACK)
            & (after >= least / (1 + least) * (n + m) - _SLACK))


def _of_nodes(frame, pairs):
    """One row of `frame` for each node of `pairs`."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return frame.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def _met(pairs, frame, column):
    side = frame.select("node", column)
    return (pairs.join(side.withColumnsRenamed({"node": "a", column: "x"}), "a")
            .join(side.withColumnsRenamed({"node": "b", column: "y"}), "b"))


def _filtered(both, test):
    """The pairs (a, b) of rows (b, a, x, y) whose x and y pass a test."""
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(c)) for c in "abxy")
            good = pa.array([test(p.as_py(), q.as_py()) for p, q in zip(x, y, strict=True)],
                            pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], ["a", "b"])
    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long")


def _alike(pairs, rows, texts, words, least):
    """The pairs (a, b) of nodes whose shingle sets have Jaccard `least` or more."""
    def may(x, y):
        return sketches_differ(x[0], y[0]) <= (1 - least) / (1 + least) * (x[1] + y[1]) + _SLACK

    def are(x, y):
        one, two = shingles_of(x, words), shingles_of(y, words)
        common = len(np.intersect1d(one, two, assume_unique=True))
        return common >= least * (len(one) + len(two) - common) - _SLACK

    pairs = kept(pairs)
    marks = rows.select("node", F.struct("sketch", "size").alias("mark"))
    held = kept(_of_nodes(marks, pairs))
    may_be = kept(_filtered(_met(pairs, held, "mark"), lambda x, y: may(
        *((m["sketch"], m["size"]) for m in (x, y)))))
    drop_written(held)
    drop_written(pairs)
    held = kept(_of_nodes(texts.select("node", "text"), may_be))
    found = kept(_filtered(_met(may_be, held, "text"), are))
    drop_written(held)
    drop_written(may_be)
    return found


def groups(docs, doc_id="doc_id", text="text", threshold=4, shingle=4, words=5, least=0.8):
    """(id, node, first, first_node) of the rows of `docs` with a doc_id: a node is a text
    (its 64-bit hash), and of all rows in its group `first` and `first_node` are the least.
    Texts link if their fingerprints differ in at most `threshold` bits or their sets of
    `words`-word shingles have Jaccard `least` or more; groups are closed over links.

    Two such sets share one of the first shingles of each, in any fixed order. Texts that
    share one are compared exactly if places, sizes and sketches allow it. A shingle held
    by many near copies is first met by one text of it, in rounds, and texts already in one
    group are not paired; then all that still differ in group are.

    NULL, empty and blank texts have fingerprint 0 and are one group with all texts of a
    fingerprint near it; as sets they link with nothing. Repeated rows are in one group, as
    are equal texts; a very long text is one row like any other. Rows without a doc_id are
    left out. An empty table gives an empty result. Other columns are not looked at.
    """
    texts = docs.where(F.col(doc_id).isNotNull()).select(
        F.col(doc_id).alias("id"), F.xxhash64(text).alias("node"),
        F.col(text).cast("binary").alias("text"))
    rows = kept(_marked(texts, shingle, words, least))
    nodes = kept(rows.groupBy("node").agg(F.min("id").alias("id"),
                                          F.min("fingerprint").alias("fingerprint")))
    prints = kept(nodes.groupBy("fingerprint").agg(F.min("node").alias("node")))
    one, two = (prints.select(F.col("fingerprint").alias(c), F.col("node").alias("n" + c))
                for c in ("a", "b"))
    edges = (links(prints.select("fingerprint"), threshold).join(one, "a").join(two, "b")
             .select(F.col("na").alias("a"), F.col("nb").alias("b"))
             .unionByName(nodes.select("fingerprint", F.col("node").alias("a")).join(
                 prints.select("fingerprint", F.col("node").alias("b")), "fingerprint")
                 .select("a", "b")))
    reach = kept(components(edges))

    # A text that many rows repeat gives its shingles once.
    repeated = kept(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
                    .where("n > 1").select("node", "one"))
    tokens = (rows.join(repeated, "node", "left").where("one is null or one = id")
              .select("node", "size", F.posexplode("prefix").alias("at", "token")))
    several = kept(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("token"))
    spots = kept(tokens.join(several, "token", "left_semi").distinct())
    drop_written(several)
    drop_written(repeated)

    def standing():
        """The spots of tokens held in more than one group."""
        held = spots.join(reach, "node", "left").select(
            "token", "node", "size", "at", F.coalesce("component", "node").alias("group"))
        mixed = (held.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
                 .where("lo < hi").select("token"))
        return kept(held.join(mixed, "token", "left_semi"))

    def joined(found):
        grown = kept(components(reach.select(F.col("node").alias("a"), F.col("component").alias("b"))
                                .unionByName(found)))
        drop_written(reach)
        return grown

    names = ("node", "size", "at", "group")
    turn, full = 0, False
    while True:
        held = standing()
        if not full:
            other = held.groupBy("token").agg(F.min(F.struct(
                F.xxhash64("node", F.lit(turn)).alias("draw"), *names)).alias("o"))
            other = other.select("token", *[F.col(f"o.{c}").alias("o_" + c) for c in names])
        else:
            other = held.select("token", *[F.col(c).alias("o_" + c) for c in names])
        near = ((held["token"] == other["token"]) & (F.col("group") != F.col("o_group"))
                & _may_reach(least, "size", "at", "o_size", "o_at"))
        if full:
            near = near & (F.col("node") < F.col("o_node"))
        found = _alike(held.join(other, near).select(
            F.least("node", "o_node").alias("a"), F.greatest("node", "o_node").alias("b"))
            .distinct(), rows, texts, words, least)
        none = found.isEmpty()
        drop_written(held)
        if not none:
            reach = joined(found)
        drop_written(found)
        if full:
            break
        turn += 1
        full = none or turn == 3

    grouped = nodes.join(reach, "node", "left").select(
        "node", "id", F.coalesce("component", "node").alias("group"))
    firsts = grouped.groupBy("group").agg(F.min(F.struct("id", "node")).alias("f"))
    whole = kept(grouped.join(firsts, "group").select(
        "node", F.col("f.id").alias("first"), F.col("f.node").alias("first_node")))
    for done in (spots, reach, prints, nodes):
        drop_written(done)
    return rows.select("id", "node").join(whole, "node")


def one_of_each_group(docs, doc_id="doc_id", text="text", threshold=4, shingle=4, words=5,
                      least=0.8):
    """The rows of `docs` that stay: of each of `groups` the row with the smallest doc_id,
    once if it is repeated; of different texts under that doc_id one. Rows without a
    doc_id all stay, and all columns do. Of NULL, empty and blank texts, which are one
    group, one row stays; an empty table stays empty."""
    found = groups(docs, doc_id, text, threshold, shingle, words, least)
    gone = kept(found.where("id <> first or node <> first_node").distinct()
                .select(F.col("id").alias(OWN + "id"), F.col("node").alias(OWN + "gone")))
    twice = kept(found.groupBy("id", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                 .select(F.col("id").alias(OWN + "id"), F.col("node").alias(OWN + "gone")))
    named = docs.where(F.col(doc_id).isNotNull()).withColumn(OWN + "node", F.xxhash64(text))

    def on(keys):
        return (named[doc_id] == keys[OWN + "id"]) & (named[OWN + "node"] == keys[OWN + "gone"])

    stay = named.join(gone, on(gone), "left_anti")
    # Only rows known to repeat are grouped; the texts of the others stay where they are.
    once = stay.join(twice, on(twice), "left_anti")
    again = stay.join(twice, on(twice), "left_semi").dropDuplicates([doc_id, OWN + "node"])
    return (once.unionByName(again).drop(OWN + "node")
            .unionByName(docs.where(F.col(doc_id).isNull())))

"""SimHash near-duplicates found by pigeonring filtering."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from twoclock.session import kept

from .common import OWN, components

BITS = 64


def fingerprint_of(text, shingle=4, seed=42):
    """SimHash of UTF-8 bytes (None: no text): words are runs of non-space after A-Z are
    lower-cased; each shingle, repeats included, votes with the bits of its XXH64. A bit
    is 1 if set in over half the hashes. Fewer words than `shingle` are one shingle,
    none give 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), np.uint64)
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):  # a very long text is counted in pieces
        part = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * total > len(hashes), bitorder="little")
    return int(ones.view("<i8")[0])


def fingerprints(docs, doc_id="doc_id", text="text", shingle=4):
    """(doc_id, fingerprint as a signed long), one row for each row of `docs`."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def hashed(batches):
        for batch in batches:
            prints = [fingerprint_of(t, shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fingerprint"])

    return (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
            .mapInArrow(hashed, f"doc_id {kind}, fingerprint long"))


def _segments(threshold):
    """(first bit, width) of threshold + 1 segments around the ring of 64 bits."""
    parts = threshold + 1
    edges = [round(k * BITS / parts) for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _bits(column, first, width):
    return F.shiftrightunsigned(column, first).bitwiseAND(F.lit((1 << width) - 1))


def _keys(column, threshold):
    """Join keys of a fingerprint. In a chain of two segments that keeps its budget the
    first has no difference and the second at most one, so one half of the second has
    none either: a key is a start, the first segment, and one half of the second."""
    ring, keys = _segments(threshold), []
    for start, (first, width) in enumerate(ring):
        at, wide = ring[(start + 1) % len(ring)]
        for half, (a, w) in enumerate([(at, wide // 2), (at + wide // 2, wide - wide // 2)]):
            tag = F.lit(start * 2 + half).cast("long")
            keys.append(F.shiftleft(F.shiftleft(tag, width).bitwiseOR(
                _bits(column, first, width)), w).bitwiseOR(_bits(column, a, w)))
    return F.array(*keys)


def _chain_kept(a, b, start, threshold):
    """Whether the chain from `start` keeps every proportional budget: l segments in a
    row differ in at most l * threshold / segments bits."""
    ring = _segments(threshold)
    changed, sums, ok = a.bitwiseXOR(b), F.lit(0), F.lit(True)
    for length in range(1, len(ring) + 1):
        first, width = ring[(start + length - 1) % len(ring)]
        sums = sums + F.bit_count(_bits(changed, first, width))
        ok = ok & (sums <= length * threshold // len(ring))
    return ok


def links(prints, threshold=4):
    """Pairs (a, b), a < b, of different fingerprints of `prints` (one long column
    `fingerprint`, distinct) that differ in at most `threshold` (1 to 7) bits.

    By the pigeonring principle, if the segments of a ring differ in at most `threshold`
    bits together, some start has every chain from it within its proportional budget. So
    candidates meet on a chain of two segments, are dropped unless the whole chain from
    that start keeps its budgets, and only then is the full distance taken. No cap is
    set on the partners of a key; a skewed key is split by the skew join.
    """
    if not 1 <= threshold <= 7:
        raise ValueError("threshold must be from 1 to 7")
    keyed = prints.select("fingerprint", F.explode(_keys(F.col("fingerprint"), threshold))
                          .alias("key"), )
    keyed = keyed.select("fingerprint", "key")
    left = keyed.select(F.col("fingerprint").alias("a"), "key")
    right = keyed.select(F.col("fingerprint").alias("b"), F.col("key").alias("key_b"))
    a, b = F.col("a"), F.col("b")
    ring = _segments(threshold)
    chain = F.lit(False)
    for start, (first, width) in enumerate(ring):
        chain = chain | _chain_kept(a, b, start, threshold)
    near = ((F.col("key") == F.col("key_b")) & (a < b) & chain
            & (F.bit_count(a.bitwiseXOR(b)) <= threshold))
    return left.join(right, near).select("a", "b").distinct()


def near_duplicates(docs, doc_id="doc_id", text="text", threshold=4, shingle=4):
    """(doc_id, fingerprint long, component_id) for each row of `docs`; component_id is
    the smallest doc_id reachable over links of at most `threshold` differing bits.

    Equal fingerprints meet in one grouping and only distinct ones are joined. Null,
    empty and blank texts have fingerprint 0 and link like any other. A row without a
    doc_id keeps its fingerprint, links with nothing and has no component. Repeated rows
    give repeated results. An empty table gives an empty result.
    """
    prints = kept(fingerprints(docs, doc_id, text, shingle))
    groups = kept(prints.where("doc_id is not null").groupBy("fingerprint")
                  .agg(F.min("doc_id").alias("first")))
    reach = kept(components(links(groups.select("fingerprint"), threshold)))
    firsts = (reach.join(groups, reach["node"] == groups["fingerprint"])
              .groupBy("component").agg(F.min("first").alias("least")))
    moved = reach.join(firsts, "component").select(
        F.col("node").alias("fingerprint"), "least")
    whole = (groups.join(moved, "fingerprint", "left")
             .select("fingerprint", F.coalesce("least", "first").alias("component_id")))
    return (prints.join(whole, "fingerprint", "left")
            .select("doc_id", "fingerprint",
                    F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
                    .alias("component_id")))


def one_of_each_group(docs, doc_id="doc_id", text="text", threshold=4, shingle=4):
    """The rows of `docs` that stay: of each group of near-duplicates the row with the
    smallest doc_id, once if it is repeated. Rows without a doc_id all stay."""
    found = near_duplicates(docs, doc_id, text, threshold, shingle)
    gone = (found.where("doc_id <> component_id").select(F.col("doc_id").alias(OWN + "id"))
            .distinct())
    named = docs.where(F.col(doc_id).isNotNull())
    stay = named.join(gone, named[doc_id] == gone[OWN + "id"], "left_anti")
    return stay.dropDuplicates([doc_id]).unionByName(docs.where(F.col(doc_id).isNull()))

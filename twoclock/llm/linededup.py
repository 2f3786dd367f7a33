"""Repeated runs of lines found by winnowing and deleted where they come later."""

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from twoclock.session import kept

from .common import OWN


def lines_of(text):
    """[(number of the line, its words joined by one space, count of words)] of the lines
    of UTF-8 bytes that hold any word; words are runs of non-space."""
    out = []
    for number, line in enumerate((text or b"").split(b"\n")):
        words = line.split()
        if words:
            out.append((number, b" ".join(words), len(words)))
    return out


def windows_of(counts, min_words, whole_lines=True):
    """(first, last) of the shortest windows of at least `min_words` words that begin or
    end at each line, and with `whole_lines` of every single line whatever its length;
    `counts` are the words of the lines."""
    n = len(counts)
    found = {(k, k) for k in range(n)} if whole_lines else set()
    end, total = 0, 0
    for first in range(n):
        while end < n and total < min_words:
            total += counts[end]
            end += 1
        if total < min_words:
            break
        found.add((first, end - 1))
        total -= counts[first]
    first, total = n - 1, 0
    for last in range(n - 1, -1, -1):
        while first >= 0 and total < min_words:
            total += counts[first]
            first -= 1
        if total < min_words:
            break
        found.add((first + 1, last))
        total -= counts[last]
    return sorted(found)


def winnowed(text, min_words, whole_lines=False):
    """{fingerprint: [(digest of the window, its first and last line number)]}: each
    window selects the smallest line hash in it, and stands under that fingerprint."""
    lines = lines_of(text)
    hashes = [xxhash.xxh3_64_intdigest(line) - (1 << 63) for _, line, _ in lines]
    chosen = {}
    for first, last in windows_of([n for _, _, n in lines], min_words, whole_lines):
        if first == last:
            digest, least = xxhash.xxh3_128_digest(lines[first][1]), hashes[first]
        else:
            digest = xxhash.xxh3_128_digest(b"\n".join(x[1] for x in lines[first:last + 1]))
            least = min(hashes[first:last + 1])
        chosen.setdefault(least, []).append((digest, lines[first][0], lines[last][0]))
    return chosen


_WINNOWED = ("key binary, fingerprint long, again boolean, "
             "windows array<struct<digest:binary,first:int,last:int>>")


def _selected(min_words, whole_lines):
    """Rows of a document's fingerprints, each with its windows and whether two of them
    are alike."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                keys, prints, again, ends = [], [], [], [0]
                digests, firsts, lasts = [], [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(),
                                     strict=True):
                    for fingerprint, windows in winnowed(text, min_words,
                                                           whole_lines).items():
                        keys.append(key)
                        prints.append(fingerprint)
                        again.append(len({w[0] for w in windows}) < len(windows))
                        for digest, first, last in windows:
                            digests.append(digest)
                            firsts.append(first)
                            lasts.append(last)
                        ends.append(len(digests))
                held = pa.StructArray.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(firsts, pa.int32()),
                     pa.array(lasts, pa.int32())], ["digest", "first", "last"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(prints, pa.int64()),
                     pa.array(again, pa.bool_()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held)],
                    ["key", "fingerprint", "again", "windows"])
    return run


def _row_key(doc_id, text):
    """Bytes that sort as (doc_id, digest of the text): ids in numeric order, rows
    without an id last. Rows alike in both are one place in the corpus."""
    unsigned = F.col(doc_id).cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    number = F.concat(F.lit("00"), F.lpad(F.hex(unsigned), 16, "0"))
    digest = F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 24)
    return F.unhex(F.concat(F.coalesce(number, F.lit("01" + "0" * 16)), digest))


def repeated_runs(docs, doc_id="doc_id", text="text", min_words=10, whole_lines=False):
    """(key, first, last, kept_key, kept_first): the lines to delete, with the earlier
    place that stays, named by its key and first line.

    A window is a shortest row of lines of `min_words` words or more; every run of that
    many words is the union of the windows in it. With `whole_lines` each single line is a
    window too, so a repeated line goes however short it is. A window stands under the smallest line
    hash in it, so equal windows share a fingerprint: fingerprints that occur once in the
    corpus are dropped with all their windows, and the places of the others are joined.
    Of equal windows the first place stays whole, found by a map-side minimum, and never
    are two later places paired. A place that overlaps the first loses what is beyond it.
    """
    found = kept(docs.where(F.col(text).isNotNull())
                 .select(_row_key(doc_id, text).alias("key"),
                         F.col(text).cast("binary").alias("text"))
                 .mapInArrow(_selected(min_words, whole_lines), _WINNOWED))
    several = (found.groupBy("fingerprint")
               .agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"))
               .where("n > 1 or again").select("fingerprint"))
    places = kept(found.join(several, "fingerprint", "left_semi")
                  .select("key", F.explode("windows").alias("w"))
                  .select("key", "w.digest", "w.first", "w.last"))
    earliest = (places.groupBy("digest")
                .agg(F.min(F.struct("key", "first", "last")).alias("place"),
                     F.max(F.struct("key", "first")).alias("end"))
                .where("struct(place.key, place.first) <> end").select("digest", "place"))
    later = (places.join(earliest, "digest")
             .where("key <> place.key or first <> place.first"))
    beyond = F.when(F.col("key") == F.col("place.key"),
                    F.greatest("first", F.col("place.last") + 1)).otherwise(F.col("first"))
    return (later.select("key", beyond.alias("first"), "last",
                         F.col("place.key").alias("kept_key"),
                         F.col("place.first").alias("kept_first"))
            .where("first <= last"))


def _without(text, runs):
    """The text less the lines in `runs`, the number of lines before, and the number
    deleted."""
    lines = text.split("\n")
    left, at = [], 0
    for first, last in sorted(runs):
        between = lines[at:first]
        if at == 0 or any(line.strip(" \t\r\v\f") for line in between):
            left.extend(between)
        at = max(at, last + 1)
    left.extend(lines[at:])
    return "\n".join(left), len(lines), len(lines) - len(left)


def _deleted(batches):
    for batch in batches:
        new, total, gone = [], [], []
        for text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                              strict=True):
            after = (None, 0, 0) if text is None else _without(
                text, [(r["first"], r["last"]) for r in runs or ()])
            for column, value in zip((new, total, gone), after, strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [pa.array(new, pa.string()), pa.array(total, pa.int64()),
             pa.array(gone, pa.int64()), *batch.columns[2:]],
            [OWN + "text", OWN + "lines", OWN + "removed", *batch.schema.names[2:]])


def dedup_lines(docs, doc_id="doc_id", text="text", min_words=10,
                n_lines="n_lines", n_removed="n_removed", whole_lines=False):
    """`docs` with `text` less every run of lines of at least `min_words` words that also
    stands at an earlier place (doc_id, then line), and two more columns: the lines
    before, and the lines deleted. Columns of those names are replaced. With `whole_lines`
    every line that stands at an earlier place goes, of however few words.

    Ids are whole numbers. Lines are equal if their words are; blank lines between two
    deleted lines go too. Null texts stay null with 0 lines; an empty text is one
    empty line, and is never a repeat. Rows with no doc_id come after all others. Rows
    alike in doc_id and text are one place and get the same result. Texts may be of any
    length.
    """
    runs = (repeated_runs(docs, doc_id, text, min_words, whole_lines).groupBy("key")
            .agg(F.collect_set(F.struct("first", "last")).alias(OWN + "runs"))
            .withColumnRenamed("key", OWN + "key"))
    others = [c for c in docs.columns if c not in (text, n_lines, n_removed)]
    joined = (docs.select(F.col(text).alias(OWN + "text"), *[F.col(f"`{c}`") for c in others],
                          _row_key(doc_id, text).alias(OWN + "key"))
              .join(runs, OWN + "key", "left")
              .select(OWN + "text", OWN + "runs", *[F.col(f"`{c}`") for c in others]))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema[2:]]
    done = joined.mapInArrow(_deleted, ", ".join(
        [f"`{OWN}text` string, `{OWN}lines` long, `{OWN}removed` long", *kinds]))
    return done.select(
        *[F.col(OWN + "text").alias(c) if c == text else F.col(f"`{c}`")
          for c in docs.columns if c not in (n_lines, n_removed)],
        F.col(OWN + "lines").alias(n_lines), F.col(OWN + "removed").alias(n_removed))


def without_repeats(docs, doc_id="doc_id", text="text", min_words=10, whole_lines=False):
    """`docs` after `dedup_lines`, less the rows of which every line with words was
    deleted; rows whose text had no words before stay as they are."""
    done = dedup_lines(docs, doc_id, text, min_words, OWN + "lines", OWN + "removed",
                       whole_lines)
    emptied = (F.col(OWN + "removed") > 0) & ~F.coalesce(F.col(text), F.lit("")).rlike(r"\S")
    return done.where(~emptied).select(*[F.col(f"`{c}`") for c in docs.columns])

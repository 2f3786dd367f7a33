"""Ranked lexical search: accumulator-limited, term at a time, over blocks of documents.

Documents are searched where they lie: no list of postings is shuffled, and a word held
by a third of all documents is as many short lists as there are blocks. Statistics of the
whole corpus come first; then each task goes through its documents block by block and
each item through its terms, rarest first. While a document not yet met can still reach
the k-th best score, a term opens accumulators; from then on terms only update those that
can still get there, by looking their documents up in the list. Each task gives its best
k an item, and the best k of those are the answer.
"""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from twoclock.session import kept

from .common import OWN, drop_written

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    """The terms of a text in order; of NULL, none."""
    # Lower case of bytes is that of A-Z alone.
    return TERM.findall(text.encode().lower().decode()) if text else []


def weight(n_documents, holding):
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * holding + 1)))


def length_norm(n_terms, n_documents, all_terms):
    return 75 + 25 * n_terms * n_documents // all_terms


def impacts(counts, norms):
    """What a term adds to a score for each unit of weight."""
    return 1_000_000_000 * counts // (1000 * counts + 12 * norms)


# ---- documents as counts of the query's terms --------------------------------

def _counted(shared):
    def run(batches):
        known = {term: number for number, term in enumerate(shared.value)}
        for batch in batches:
            sizes, numbers, counts, ends = [], [], [], [0]
            for text in batch.column(0):
                words = terms_of(text.as_py())
                sizes.append(len(words))
                for word, count in Counter(words).items():
                    number = known.get(word)
                    if number is not None:
                        numbers.append(number)
                        counts.append(count)
                ends.append(len(numbers))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.int32())),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(counts, pa.int64()))],
                ["doc_id", "n", "terms", "counts"])
    return run


# ---- one block of documents --------------------------------------------------

class Postings:
    """The lists of one block of documents: per term the documents that hold it, in
    order, and its impacts there."""

    def __init__(self, sizes, ends, terms, counts, n_documents, all_terms):
        docs = np.repeat(np.arange(len(sizes)), np.diff(ends))
        order = np.argsort(terms, kind="stable")
        self.docs = docs[order]
        norms = 75 + 25 * sizes * n_documents // max(all_terms, 1)
        self.impact = impacts(counts[order], norms[self.docs])
        names, starts = np.unique(terms[order], return_index=True)
        stops = np.append(starts[1:], len(order))
        tops = np.maximum.reduceat(self.impact, starts) if len(order) else []
        self.at = {int(t): (int(a), int(b), int(m)) for t, a, b, m in
                   zip(names, starts, stops, tops, strict=True)}


def _kth(scores, k):
    """The k-th largest of an array of scores, 0 if it has fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) \
        if k and len(scores) >= k else 0


def best_of_block(postings, query, k, floor, n_docs):
    """(documents, scores) of a block that may be among the best k of an item, exact.

    `query` lists (term, weight) with the rarest term first; a term that stands r times
    in the item has r times its weight. `floor` is a score that k documents are known to
    reach. A score tied with the k-th is kept: the smaller id decides later.
    """
    lists = [(w, *postings.at[t]) for t, w in query if w > 0 and t in postings.at]
    left = sum(w * top for w, _, _, top in lists)
    scores = np.zeros(n_docs, np.int64)
    done = 0
    while done < len(lists) and left >= floor:
        # New accumulators are still allowed.
        w, begin, end, top = lists[done]
        scores[postings.docs[begin:end]] += w * postings.impact[begin:end]
        left -= w * top
        done += 1
        if done < len(lists):
            floor = max(floor, _kth(scores, k))
    alive = np.flatnonzero((scores > 0) & (scores + left >= floor))
    scores = scores[alive]
    for w, begin, end, top in lists[done:]:
        # Survivors only; those that cannot get there any more drop out.
        docs = postings.docs[begin:end]
        spot = np.searchsorted(docs, alive)
        spot[spot == len(docs)] = 0
        held = docs[spot] == alive
        scores += np.where(held, w * postings.impact[begin:end][spot], 0)
        left -= w * top
        floor = max(floor, _kth(scores, k))
        fit = scores + left >= floor
        if not fit.all():
            alive, scores = alive[fit], scores[fit]
    return alive, scores


def _ranked_in_task(shared, k, block_docs):
    def run(batches):
        n_documents, all_terms, queries = shared.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))] * len(queries)
        for batch in batches:
            for begin in range(0, batch.num_rows, block_docs):
                part = batch.slice(begin, block_docs)
                missing = np.asarray(part.column(0).is_null())
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                lists = part.column(2)
                ends = lists.offsets.to_numpy().astype(np.int64)
                postings = Postings(
                    part.column(1).to_numpy(), ends - ends[0],
                    lists.flatten().to_numpy(), part.column(3).flatten().to_numpy(),
                    n_documents, all_terms)
                for number, (_, query) in enumerate(queries):
                    held = best[number]
                    found, scores = best_of_block(
                        postings, query, k, _kth(held[1], k), len(ids))
                    if len(found):
                        best[number] = _best(
                            np.concatenate([held[0], ids[found]]),
                            np.concatenate([held[1], scores]),
                            np.concatenate([held[2], missing[found]]), k)
        for number, (ids, scores, missing) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([queries[number][0]] * len(ids), pa.int32()),
                     pa.array(ids, mask=missing), pa.array(scores)],
                    ["item", "doc_id", "score"])
    return run


def _best(ids, scores, missing, k):
    order = np.lexsort((ids, missing, -scores))[:k]
    return ids[order], scores[order], missing[order]


# ---- items -------------------------------------------------------------------

def _item_blocks(items, item_id, text, block_bytes):
    """Blocks of [(item id, its terms with repeats)] of at most `block_bytes` of text, or
    of one item; the driver holds one block at a time."""
    rows = (items.where(F.col(f"`{text}`").isNotNull())
            .select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").alias("text"))
            .distinct().orderBy("item", "text"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        terms = terms_of(row["text"])
        if block and block[-1][0] == row["item"]:
            block[-1][1].extend(terms)
        else:
            if block and size + len(row["text"]) > block_bytes:
                yield block
                block, size = [], 0
            block.append((row["item"], terms))
        size += len(row["text"])
    if block:
        yield block


def ranked(docs, items, k=20, doc_id="doc_id", text="text", item_id="item_id",
           item_text="text", block_bytes=2_000_000, block_docs=4096):
    """(item_id, rank, doc_id, score): for each item the `k` documents with the highest
    score above 0, or all, if fewer; equal scores by ascending doc_id, NULL last.

    Every row of `docs` is a document, so rows that repeat rank one after the other, and
    a NULL or empty text is a document without terms: it scores nothing and does not
    count as one. Rows of `items` that repeat count once; further texts under one id, NULL
    included, add their terms to the item. Items without terms, or whose terms stand
    nowhere, give no rows; so do empty tables. Other columns are left aside. Items are
    taken in blocks of at most `block_bytes` of text, which bounds what is broadcast and
    gathered; each block reads all documents, whole.
    """
    spark = docs.sparkSession
    id_type = items.schema[item_id].dataType
    taken = docs.select(F.col(f"`{text}`").alias(OWN + "text"),
                        F.col(f"`{doc_id}`").cast("long").alias("doc_id"))
    found = None
    for block in _item_blocks(items, item_id, item_text, block_bytes):
        vocabulary = sorted({t for _, terms in block for t in terms})
        if not vocabulary:
            continue
        counted = kept(taken.mapInArrow(
            _counted(spark.sparkContext.broadcast(vocabulary)),
            "doc_id long, n long, terms array<int>, counts array<long>"))
        whole = counted.where("n > 0").agg(
            F.count(F.lit(1)).alias("documents"), F.sum("n").alias("terms")).head()
        holding = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").count()
                       .toLocalIterator())
        number = {t: n for n, t in enumerate(vocabulary)}
        queries = []
        for at, (_, terms) in enumerate(block):
            repeats = {}
            for t in terms:
                repeats[number[t]] = repeats.get(number[t], 0) + 1
            rarest = sorted((holding[t], t) for t in repeats if t in holding)
            queries.append((at, [(t, repeats[t] * weight(whole["documents"], df))
                                 for df, t in rarest]))
        shared = spark.sparkContext.broadcast(
            (whole["documents"], whole["terms"] or 0, queries))
        best = counted.mapInArrow(_ranked_in_task(shared, k, block_docs),
                                  "item int, doc_id long, score long")
        order = W.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        best = kept(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        drop_written(counted)
        names = spark.createDataFrame(list(enumerate(i for i, _ in block)),
                                      f"item int, item_id {id_type.simpleString()}")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame(
            [], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    return found

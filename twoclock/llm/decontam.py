"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

import hashlib

import pyarrow as pa
from pyspark.sql import functions as F

from twoclock.session import kept

from .common import OWN

#: A-Z to lower case, every other character that is in no word to a space.
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c
              if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))


def words_of(text):
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of lower-cased UTF-8 bytes (or None)."""
    return text.translate(_WORD).split() if text else []


class ShiftTable:
    """Patterns of one length (in words) for Wu-Manber search with blocks of two words.

    `shift` says how far the end of the window may move on when it stands on a block: up
    to the rightmost place of that block in any pattern, and past a block that is in none.
    A block that ends a pattern shifts by 0 and leads to the bucket of the patterns that
    end so; those are compared word by word.
    """

    def __init__(self, patterns):
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.shift, self.buckets = {}, {}
        for pattern, items in patterns.items():
            for end in range(self.block, self.length + 1):
                block = pattern[end - self.block:end]
                move = self.length - end
                if move < self.shift.get(block, self.length):
                    self.shift[block] = move
            self.buckets.setdefault(pattern[-self.block:], []).append((pattern, items))

    def search(self, words):
        """Yields (first word, items) of every occurrence of a pattern."""
        length, size, at, n = self.length, self.block, self.length, len(words)
        far, shift = self.length - self.block + 1, self.shift.get
        while at <= n:
            block = tuple(words[at - size:at])
            move = shift(block, far)
            if move:
                at += move
                continue
            for pattern, items in self.buckets[block]:
                if tuple(words[at - length:at]) == pattern:
                    yield at - length, items
            at += 1


def tables_for(items, window):
    """Shift tables, one for each pattern length, for [(item, text bytes)]."""
    by_length = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1) if size else ():
            pattern = tuple(words[at:at + size])
            by_length.setdefault(size, {}).setdefault(pattern, set()).add(item)
    return [ShiftTable(p) for _, p in sorted(by_length.items())]


def hits(words, tables):
    """(first words and lengths of the occurrences, items) of one document."""
    spans, items = [], set()
    for table in tables:
        for at, found in table.search(words):
            spans.append((at, table.length))
            items |= found
    return spans, items


def _covered(spans):
    """[[first, end)] the union of spans as disjoint runs."""
    runs = []
    for first, size in sorted(spans):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], first + size)
        else:
            runs.append([first, first + size])
    return runs


def _blocks(benchmark, item_id, text, block_bytes):
    """Lists of (item id as text, text bytes) of at most `block_bytes` of text each, or
    of one item; the driver holds one block at a time."""
    rows = (benchmark.where(F.col(text).isNotNull())
            .select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                    F.col(text).cast("binary").alias("text")).orderBy("item"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        if block and size + len(row["text"]) > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["item"], bytes(row["text"])))
        size += len(row["text"])
    yield block


def _searched(shared, window, first):
    """Adds what one block finds to the spans and items found so far."""
    def run(batches):
        tables = tables_for(shared.value, window)
        for batch in batches:
            n = batch.num_columns - 3 * (not first)
            texts = batch.column(0).to_pylist()
            before = (None, None) if first else (
                batch.column(n + 1).to_pylist(), batch.column(n + 2).to_pylist())
            counts, covered, found = [], [], []
            for k, text in enumerate(texts):
                words = words_of(text)
                spans, items = hits(words, tables)
                if not first:
                    spans += [(r[0], r[1] - r[0]) for r in before[0][k]]
                    items |= set(before[1][k])
                counts.append(len(words))
                covered.append(_covered(spans))
                found.append(sorted(items))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(counts, pa.int64()),
                 pa.array(covered, pa.list_(pa.list_(pa.int64()))),
                 pa.array(found, pa.list_(pa.string()))],
                [*batch.schema.names[:n], OWN + "words", OWN + "runs", OWN + "items"])
    return run


def _search_all(state, benchmark, item_id, item_text, window, block_bytes):
    """`state`, whose first column is a text as binary, with the words, hit runs and items
    of every row in columns of our own."""
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)
    first = True
    for block in _blocks(benchmark, item_id, item_text, block_bytes):
        shared = state.sparkSession.sparkContext.broadcast(block)
        state = (state if first else kept(state)).mapInArrow(
            _searched(shared, window, first),
            f"{given}, `{OWN}words` long, `{OWN}runs` array<array<long>>, "
            f"`{OWN}items` array<string>")
        first = False
    return state


def contamination(docs, benchmark, doc_id="doc_id", text="text", item_id="item_id",
                  item_text="text", window=10, block_bytes=8_000_000):
    """For each row of `docs`: doc_id, n_words, `runs` (the disjoint runs [first, end) of
    words inside any occurrence of a benchmark window) and `items` (the ids, as sorted
    strings, of the items with an occurring window).

    A window is `window` consecutive words of an item; an item of fewer words, but not
    none, is one window. Null and wordless texts, of documents or items, have no words
    and no hits; an item without an id counts under "". Rows without a doc_id and
    repeated rows are searched like any other; further columns are left aside. The
    benchmark is read in blocks of at most `block_bytes` of text, each broadcast by
    itself and searched in a pass of its own over whole documents, so what is broadcast
    has a bound and no item is left out.
    """
    state = docs.select(F.col(text).cast("binary").alias(OWN + "text"), doc_id)
    found = _search_all(state, benchmark, item_id, item_text, window, block_bytes)
    return found.select(doc_id, F.col(OWN + "words").alias("n_words"),
                        F.col(OWN + "runs").alias("runs"), F.col(OWN + "items").alias("items"))


def digest(found, doc_id="doc_id"):
    """The counts of `contamination`, without the spans."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    return found.select(
        doc_id, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def clean_documents(docs, benchmark, text="text", item_id="item_id", item_text="text",
                    window=10, block_bytes=8_000_000):
    """The rows of `docs` in which no benchmark window occurs."""
    state = docs.select(F.col(text).cast("binary").alias(OWN + "text"), *[F.col(f"`{c}`") for c in docs.columns if c != text])
    found = _search_all(state, benchmark, item_id, item_text, window, block_bytes)
    return found.where(F.size(OWN + "runs") == 0).select(
        *[F.col(OWN + "text").cast("string").alias(c) if c == text else F.col(f"`{c}`")
          for c in docs.columns])


def items_digest(items):
    """What `items_sha256` holds for a set of item ids."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()

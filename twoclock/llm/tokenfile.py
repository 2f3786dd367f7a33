"""Token ids as binary blocks with Elias-Fano document boundaries.

The file format, a folder of Parquet written by Spark so that a lost task leaves nothing
half written and any store serves. Each row is a block of whole documents, in ascending
doc_id order over the blocks of a part and over the parts:

    part, block      place of the block in the order
    part_start       tokens of the part before this block
    n_docs, n_null   documents, and how many of them (the first) have no doc_id
    n_tokens, width  ids in the block, and the bytes of each: 2, or 4 for large vocabularies
    ids              the ids of all documents, one after another, little-endian
    ends             Elias-Fano code of the end of each document in `ids`
    first_id, keys   smallest doc_id, and Elias-Fano code of the doc_ids less it
"""

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import OWN, per_worker

SAMPLE = 64
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1)


class EliasFano:
    """A non-decreasing sequence of n whole numbers up to u in about 2 + log2(u / n) bits
    each: the low bits packed, the high bits in unary, and for selection the places of
    every 64th one in the unary bits, as 32-bit integers.

    Bytes: n, u and the low width as 3 uint64; the number of bytes of the low and the
    high bits as 2 uint64; then samples, low bits, high bits.
    """

    def __init__(self, data):
        n, self.u, self.width, n_low, n_high = np.frombuffer(data, "<u8", 5).tolist()
        self.n, at = n, 40
        count = -(-n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", count, at)
        self.low = np.frombuffer(data, np.uint8, n_low, at + 4 * count)
        self.high = np.frombuffer(data, np.uint8, n_high, at + 4 * count + n_low)

    @staticmethod
    def pack(values):
        values = np.asarray(values, np.uint64)
        n = len(values)
        u = int(values[-1]) if n else 0
        width = max(0, (u // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(high[-1]) + 1 if n else 0, np.uint8)
        unary[high] = 1
        low = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        low, unary = (np.packbits(b, bitorder="little") for b in
                      (low.astype(np.uint8).ravel(), unary))
        return b"".join([np.array([n, u, width, len(low), len(unary)], "<u8").tobytes(),
                         high[::SAMPLE].astype("<u4").tobytes(), low.tobytes(),
                         unary.tobytes()])

    def _low(self, i):
        value = 0
        for b in range(self.width):
            at = i * self.width + b
            value |= (int(self.low[at >> 3]) >> (at & 7) & 1) << b
        return value

    def select(self, i):
        """The i-th value: from the sampled one before it, whole bytes are skipped by
        their number of ones."""
        at = int(self.samples[i // SAMPLE])
        left, byte = i % SAMPLE, at >> 3
        held = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := int(_ONES[held])) <= left:
            left -= ones
            byte += 1
            held = int(self.high[byte])
        for _ in range(left):
            held &= held - 1
        place = byte * 8 + (held & -held).bit_length() - 1
        return (place - i) << self.width | self._low(i)

    def all(self):
        """Every value, in one pass over the bits."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        high = (places - np.arange(self.n)).astype(np.uint64)
        bits = np.unpackbits(self.low, bitorder="little")[:self.n * self.width]
        weights = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        low = (bits.reshape(self.n, self.width).astype(np.uint64) * weights).sum(
            axis=1, dtype=np.uint64)
        return (high << np.uint64(self.width)) | low


class ChunkedEncoder:
    """The ids a tokenizer gives a whole text, from those of its chunks.

    A byte-level tokenizer cuts a text before a space that a non-space follows, around a
    lone line end, and between a letter or digit and a comma or full stop, so the chunks
    between are encoded by themselves. Texts are cut in one pass over their bytes, and each
    different chunk of a column is looked up once. New ones that begin with a space go into one
    string, whose ids are parted by the bytes they stand for; others are parted there by a
    special token. The ids of
    short chunks are kept in two generations, about `memory` of them: a full one becomes
    the old one, and what is met again moves on to the new.
    """

    def __init__(self, file, width, memory=1_200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.kind, self.width, self.memory = f"<u{width}", width, memory
        self.known, self.old = {}, {}
        added = self.tokenizer.get_added_tokens_decoder()
        marks = [(k, t.content) for k, t in added.items()
                 if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = min(marks, default=(None, None))
        self.stops = {c: np.array(self.tokenizer.encode(c, add_special_tokens=False).ids,
                                  self.kind).tobytes() for c in ",."}
        # A byte-level token has a character a byte.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max([*vocabulary.values(), *added]) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)
        for k, token in added.items():
            self.bytes_of[k] = len(token.content.encode())

    @staticmethod
    def chunks(text):
        if "\0" not in text and not _SPACED.search(text):
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        parts = text.split(" ")
        out = [parts[0]]
        for part in parts[1:]:
            if part and not part[0].isspace():
                out.append(" " + part)
            else:
                out[-1] += " " + part
        return out

    def _parted(self, found, ends):
        """The ids of an encoded string between the places `ends` that cut it."""
        data = np.array(found, self.kind).tobytes()
        ends = (np.asarray(ends) * self.width).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _learn_spaced(self, chunks):
        """Adds chunks that begin with one space and end with none; gives those back whose
        ends are not ends of tokens, as with a tokenizer that is not byte-level."""
        found = self.tokenizer.encode_batch_fast(["".join(chunks)], add_special_tokens=False)[0]
        ids = np.array(found.ids, np.int64)
        at = np.cumsum(self.bytes_of[ids])
        ends = np.cumsum([len(c.encode()) for c in chunks])
        last = np.searchsorted(at, ends)
        if not len(at) or at[-1] != ends[-1] or (at[last] != ends).any():
            return chunks
        self.known.update(zip(chunks, self._parted(ids, last + 1), strict=True))
        return []

    def _learn(self, chunks):
        """Adds the ids of chunks not met before."""
        alone, ended, whole = [], [], set()
        for chunk in chunks:
            if chunk[-1] in ",." and len(chunk) > 1 and chunk[-2].isalnum():
                ended.append(chunk)
                base = chunk[:-1]
                if base in self.old and base not in self.known:
                    self.known[base] = self.old[base]
                if base not in self.known:
                    whole.add(base)
            else:
                whole.add(chunk)
        plain, spaced = [], []
        for chunk in whole:
            if not self.mark or self.mark in chunk:
                alone.append(chunk)
            elif len(chunk) > 1 and chunk[0] == " " and not (
                    chunk[1].isspace() or chunk[-1].isspace()):
                spaced.append(chunk)
            else:
                plain.append(chunk)
        for lo in range(0, len(spaced), 5000):
            plain += self._learn_spaced(spaced[lo:lo + 5000])
        for lo in range(0, len(plain), 5000):
            part = plain[lo:lo + 5000]
            found = self.tokenizer.encode_batch_fast([self.mark.join(part)],
                                                     add_special_tokens=False)[0]
            ids = np.array(found.ids, np.int64)
            cuts = (np.flatnonzero(ids == self.mark_id) * self.width).tolist()
            data = ids.astype(self.kind).tobytes()
            self.known.update(zip(part, [data[a:b] for a, b in zip(
                [0] + [c + self.width for c in cuts], cuts + [len(data)])], strict=True))
        for chunk, found in zip(alone, self.tokenizer.encode_batch_fast(
                alone, add_special_tokens=False), strict=True):
            self.known[chunk] = np.array(found.ids, self.kind).tobytes()
        for chunk in ended:
            self.known[chunk] = self.known[chunk[:-1]] + self.stops[chunk[-1]]

    def _look_up(self, chunks):
        """The ids of different chunks, new ones learnt."""
        if len(self.known) > self.memory // 2:
            self.known, self.old = {}, self.known
        found = list(map(self.known.get, chunks))
        missing = {c for c, ids in zip(chunks, found, strict=True) if ids is None}
        if missing:
            again = missing & self.old.keys()
            self.known.update((c, self.old[c]) for c in again)
            missing -= again
            self._learn(missing)
            found = [self.known[c] if ids is None else ids
                     for c, ids in zip(chunks, found, strict=True)]
            for chunk in [c for c in missing if len(c) > 64]:
                del self.known[chunk]
        return found

    def encode(self, texts):
        """The ids of each text as little-endian bytes."""
        cut = [[c for c in self.chunks(t) if c] if t else [] for t in texts]
        different = list({c for parts in cut for c in parts})
        ids = dict(zip(different, self._look_up(different), strict=True))
        return [b"".join(map(ids.__getitem__, parts)) for parts in cut]

    def encode_column(self, column):
        """The same of an Arrow column of texts. Chunks follow each other, so their places
        make a column of the same bytes, whose different values Arrow finds."""
        column = column.cast(pa.string()).fill_null("")
        ends, data = _text_bytes(column)
        odd = _oddly_spaced(ends, data)
        if odd.any():
            rest = iter(self.encode_column(column.filter(pa.array(~odd))))
            found = iter(self.encode(column.filter(pa.array(odd)).to_pylist()))
            return [next(found) if o else next(rest) for o in odd.tolist()]
        if not len(data):
            return [b""] * len(column)
        starts = np.zeros(len(data) + 1, bool)
        lines = np.flatnonzero(data == 10)
        for places in (data == 32).nonzero()[0], lines, lines + 1, ends:
            starts[places] = True
        places = np.flatnonzero(starts).astype(np.int32)
        chunks = pa.StringArray.from_buffers(
            len(places) - 1, pa.py_buffer(places), pa.py_buffer(data)).dictionary_encode()
        found = self._look_up(chunks.dictionary.to_pylist())
        # Each chunk gives the ids of its value, from where they stand among all values'.
        which = chunks.indices.to_numpy()
        size = np.array([len(ids) for ids in found], np.int64) // self.width
        first, size = (np.cumsum(size) - size)[which], size[which]
        before = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(first - before[:-1], size)
        at += np.arange(before[-1])
        ids = np.frombuffer(b"".join(found), self.kind)[at].tobytes()
        cuts = (before[np.searchsorted(places, ends)] * self.width).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _text_bytes(column):
    """(n + 1 places, bytes) of a column of texts without nulls."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)[places[0]:places[-1]]
    return places.astype(np.int64) - places[0], data


def _oddly_spaced(ends, data):
    """Which texts hold white space beside white space, or a space at their end, as
    `_SPACED` finds them."""
    white = _WHITE[data]
    inner = np.zeros(len(data), bool)
    for code in _WIDE_WHITE:
        found = np.flatnonzero(data[:len(data) - len(code) + 1] == code[0])
        for n, byte in enumerate(code[1:], 1):
            found = found[data[found + n] == byte]
        for n in range(len(code)):
            white[found + n] = True
            inner[found + n] = n < len(code) - 1
    beside = np.flatnonzero(white[:-1] & white[1:] & ~inner[:-1])
    of = np.searchsorted(ends, beside, "right") - 1
    odd = np.zeros(len(ends) - 1, bool)
    odd[of[beside + 1 < ends[of + 1]]] = True
    last = ends[1:][ends[1:] > ends[:-1]] - 1
    odd[ends[1:] > ends[:-1]] |= data[last] == 32
    return odd


#: White space beside white space, or a space at the end: no plain cut.
_SPACED = re.compile(r"\s\s| \Z")
_SPACES = [c for c in map(chr, range(0x3001)) if c.isspace()]
_WHITE = np.isin(np.arange(256), [ord(c) for c in _SPACES if c < "\x80"])
_WIDE_WHITE = [c.encode() for c in _SPACES if c >= "\x80"]
#: Texts are encoded together up to so many bytes.
_PIECE = 1 << 23


def _block(part, number, before, keys, ids, width):
    n_null = sum(k is None for k in keys)
    first = keys[n_null] if n_null < len(keys) else 0
    ends = np.cumsum([len(i) // width for i in ids])
    named = np.array([k - first for k in keys[n_null:]], np.uint64)
    return {"part": part, "block": number, "part_start": before, "n_docs": len(keys),
            "n_null": n_null, "n_tokens": int(ends[-1]), "width": width,
            "ids": b"".join(ids), "ends": EliasFano.pack(ends), "first_id": first,
            "keys": EliasFano.pack(named)}


_BLOCK = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("part_start", pa.int64()),
                    ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64()),
                    ("width", pa.int32()), ("ids", pa.binary()), ("ends", pa.binary()),
                    ("first_id", pa.int64()), ("keys", pa.binary())])
_BLOCK_SQL = ("part int, block int, part_start long, n_docs long, n_null long, n_tokens long, "
              "width int, ids binary, ends binary, first_id long, keys binary")


def _pieces(batch):
    """Slices of at most `_PIECE` bytes of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(
        zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + _PIECE, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _blocks(file, end_id, width, block_tokens):
    def run(batches):
        coder = per_worker(("tokens", file, width), lambda: ChunkedEncoder(file, width))
        part = TaskContext.get().partitionId()
        end = np.array([end_id], f"<u{width}").tobytes()
        number, before, keys, ids, size = 0, 0, [], [], 0

        def out():
            row = _block(part, number, before, keys, ids, width)
            return pa.RecordBatch.from_pylist([row], _BLOCK)
        for batch in batches:
            for piece in _pieces(batch):
                coded = coder.encode_column(piece.column(1))
                for key, data in zip(piece.column(0).to_pylist(), coded, strict=True):
                    if keys and size + len(data) // width + 1 > block_tokens:
                        yield out()
                        number, before, keys, ids, size = number + 1, before + size, [], [], 0
                    keys.append(key)
                    ids.append(data + end)
                    size += len(data) // width + 1
        if keys:
            yield out()
    return run


def write(docs, path, tokenizer_file, end_id=2, doc_id="doc_id", text="text",
          block_tokens=1 << 20):
    """Writes the ids of every whole text of `docs`, each document's ids followed by
    `end_id`, in ascending doc_id order (rows without one first; rows of one id by a hash
    of their texts, so that a repeated id is spread too).

    Texts are dealt by ranges of doc_id before they are encoded. A block closes at
    `block_tokens` ids; a longer document is a block of its own. Null and empty texts
    have the end id alone. Ids are whole numbers; an empty table gives an empty folder.
    """
    from tokenizers import Tokenizer

    most = max(Tokenizer.from_file(tokenizer_file).get_vocab_size() - 1, end_id)
    width = 2 if most < 1 << 16 else 4
    order = [OWN + "id", OWN + "hash"]
    (docs.select(F.col(doc_id).cast("long").alias(order[0]), F.col(text).alias(OWN + "text"),
                 F.xxhash64(text).alias(order[1]))
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .select(order[0], OWN + "text")
     .mapInArrow(_blocks(tokenizer_file, end_id, width, block_tokens), _BLOCK_SQL)
     .write.parquet(path))


def _documents(bases):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ends = EliasFano(row["ends"]).all().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                named = EliasFano(row["keys"]).all().astype(np.int64) + row["first_id"]
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes())
                        for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                base = bases[row["part"]] + row["part_start"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None] * row["n_null"] + named.tolist(), pa.int64()),
                     pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()),
                     pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read(spark, path):
    """(doc_id, start, n_tokens, ids_crc32) of every document of a written folder; start
    counts the ids of all documents before it. The driver adds up one number a part."""
    blocks = spark.read.schema(_BLOCK_SQL).parquet(path)
    bases, total = {}, 0
    for row in (blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
                .orderBy("part").collect()):
        bases[row["part"]] = total
        total += row["n"]
    return blocks.mapInArrow(_documents(bases),
                             "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_of(block, k):
    """The ids of the k-th document of a block (a row), by selection."""
    ends = EliasFano(block["ends"])
    start = ends.select(k - 1) if k else 0
    return np.frombuffer(block["ids"], f"<u{block['width']}")[start:ends.select(k)]

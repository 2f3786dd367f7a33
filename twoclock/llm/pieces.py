"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives the Viterbi."""

import math
import re
import zlib
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import OWN, per_worker, tidy

_CHUNK = re.compile("\n| *[^ \n]+| +")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_CONTROL = ("<unk>", "<s>", "</s>", "<pad>")


def vocabulary(model_file):
    """The pieces of a model file by id, with U+2581 written as the space it stands for."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [model.id_to_piece(k).replace("▁", " ") for k in range(model.get_piece_size())]


def zipf_scores(pieces):
    """Whole-numbered log probabilities by rank, in 64ths: the model file gives merge
    ranks, and by Zipf's law a piece of rank r has a probability in proportion to 1 / r.
    Whole numbers make sums exact and ties defined."""
    plain = [k for k, p in enumerate(pieces) if p not in _CONTROL and not _BYTE.fullmatch(p)]
    return {k: -round(64 * math.log(r + 2)) for r, k in enumerate(plain)}


class PieceCodec:
    """Encodes to the piece ids of the highest total score, and decodes.

    A space goes before the text, as SentencePiece has it. A character that no piece
    spells alone may stand for itself at 640 below the lowest score, and becomes its
    UTF-8 bytes' pieces. Of paths that tie, each end keeps its longest last piece. No
    piece goes from a non-space over into a space, or holds a line end, so the best path
    is that of each chunk of spaces and non-spaces, or line end, by itself; the results of short chunks are kept, about
    `memory` of them.
    """

    def __init__(self, pieces, scores=None, memory=300_000):
        scores = zipf_scores(pieces) if scores is None else scores
        self.automaton, self.single = ahocorasick.Automaton(), set()
        self.bytes_of, self.of_byte = [], {}
        self.size = np.array([len(p) for p in pieces], np.int64)
        self.score = np.array([scores.get(k, 0) for k in range(len(pieces))], np.int64)
        for k, piece in enumerate(pieces):
            byte = _BYTE.fullmatch(piece)
            self.bytes_of.append(bytes([int(byte[1], 16)]) if byte else
                                 b"" if piece in _CONTROL else piece.encode())
            if byte:
                self.of_byte[int(byte[1], 16)] = k
            if k in scores:
                if re.search("[^ ] |\n", piece):
                    raise ValueError(f"piece {piece!r} crosses into a space or a new line")
                self.automaton.add_word(piece, k)
                if len(piece) == 1:
                    self.single.add(piece)
        if len(self.of_byte) < 256:
            raise ValueError("the vocabulary has no piece for some byte")
        self.automaton.make_automaton()
        self.unknown = min(scores.values()) - 640
        self.memory, self.known = memory, {}

    def _best_path(self, chunk):
        """The single pass over one chunk: at each end the automaton's state gives the
        pieces that end there, by output links from the longest to the shortest, and each
        relaxes the best score of that end."""
        n, matches = len(chunk), [[] for _ in range(len(chunk) + 1)]
        for at, k in self.automaton.iter(chunk):
            matches[at + 1].append(k)
        best, last = [0] + [-math.inf] * n, [None] * (n + 1)
        for end in range(1, n + 1):
            for k in matches[end]:
                score = best[end - int(self.size[k])] + int(self.score[k])
                if score > best[end]:
                    best[end], last[end] = score, k
            if chunk[end - 1] not in self.single and best[end - 1] + self.unknown > best[end]:
                best[end], last[end] = best[end - 1] + self.unknown, None
        ids, end = [], n
        while end:
            if last[end] is None:
                ids.extend(self.of_byte[b] for b in reversed(chunk[end - 1].encode()))
                end -= 1
            else:
                ids.append(last[end])
                end -= int(self.size[last[end]])
        ids.reverse()
        return ids

    def _best_paths(self, chunks):
        """The same for many short chunks of known characters at once: one run of the
        automaton over all of them, parted by line ends, which are in no piece; then the
        ends at the same distance from their starts are relaxed together."""
        sizes = np.array([len(c) for c in chunks])
        starts = np.cumsum(sizes + 1) - sizes - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter("\n".join(chunks))),
                            np.int64).reshape(-1, 2)
        chunk = np.repeat(np.arange(len(chunks)), sizes + 1)[found[:, 0]]
        end = found[:, 0] - starts[chunk] + 1
        order = np.argsort(end.astype(np.int16), kind="stable")
        chunk, end, piece = chunk[order], end[order], found[order, 1]
        best = np.full((int(sizes.max()) + 1, len(chunks)), -(1 << 40), np.int64)
        last = np.zeros(best.shape, np.int32)
        best[0] = 0
        cuts = np.searchsorted(end, np.arange(1, len(best) + 1))
        for e in range(1, len(best)):
            at = slice(cuts[e - 1], cuts[e])
            c, k = chunk[at], piece[at]
            if not len(c):
                continue
            score = best[e - self.size[k], c] + self.score[k]
            new = np.flatnonzero(np.append(True, c[1:] != c[:-1]))  # one group an end
            top = np.maximum.reduceat(score, new)
            hit = score == np.repeat(top, np.diff(np.append(new, len(c))))
            c, k, score = c[hit][::-1], k[hit][::-1], score[hit][::-1]
            best[e, c], last[e, c] = score, k  # of equals the longest is written last
        paths, left = [], sizes.copy()
        rows = np.arange(len(chunks))
        while len(rows):
            k = last[left[rows], rows]
            paths.append((rows, k))
            left[rows] -= self.size[k]
            rows = rows[left[rows] > 0]
        owner = np.concatenate([r for r, _ in paths[::-1]])
        flat = np.concatenate([k for _, k in paths[::-1]])
        order = np.argsort(owner, kind="stable")
        data = flat[order].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(chunks)))).tolist()
        return [data[a:b] for a, b in zip([0] + ends, ends)]

    def _learn(self, chunks):
        """Adds the ids of chunks not met before."""
        plain = []
        for chunk in chunks:
            if len(chunk) <= 64 and self.single.issuperset(chunk):
                plain.append(chunk)
            else:
                self.known[chunk] = np.array(self._best_path(chunk), "<i4").tobytes()
        for lo in range(0, len(plain), 20_000):
            part = plain[lo:lo + 20_000]
            self.known.update(zip(part, self._best_paths(part), strict=True))

    def encode_all(self, texts):
        """Piece ids of each text as int32 arrays; none for an empty or null one."""
        cut = [_CHUNK.findall(" " + t) if t else [] for t in texts]
        missing = {c for chunks in cut for c in chunks} - self.known.keys()
        if len(self.known) + len(missing) > self.memory:
            self.known.clear()
            missing = {c for chunks in cut for c in chunks}
        self._learn(missing)
        out = [np.frombuffer(b"".join(map(self.known.__getitem__, chunks)), "<i4")
               for chunks in cut]
        for chunk in [c for c in missing if len(c) > 64]:
            del self.known[chunk]
        return out

    def encode(self, text):
        return self.encode_all([text])[0]

    def decode(self, ids):
        """The text of piece ids: exact for whatever `encode` gave."""
        whole = b"".join(map(self.bytes_of.__getitem__, ids))
        return whole.removeprefix(b" ").decode("utf-8", "replace")


def _codec(shared):
    return per_worker(("pieces", tuple(shared.value)), lambda: PieceCodec(shared.value))


def _encoded(shared, back):
    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = codec.encode_all(part.column(0).to_pylist())
                ends = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, "<i4")
                texts = [pa.array([codec.decode(i.tolist()) for i in ids], pa.string())] * back
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                     pa.array([zlib.crc32(i) for i in ids], pa.int64()), *texts],
                    [*part.schema.names[1:], OWN + "ids", OWN + "crc", *[OWN + "text"] * back])
    return run


def _decoded(shared):
    def run(batches):
        codec = _codec(shared)
        for batch in batches:
            texts = [None if i is None else codec.decode(i) for i in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(texts, pa.string())],
                [*batch.schema.names[1:], OWN + "text"])
    return run


def _kinds(df):
    return [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]


def encode(docs, model_file, text="text", ids="ids", crc="ids_crc32", decoded=None):
    """`docs` with the piece ids of every whole text, array<int>, in place of the text,
    and the crc32 of the ids as little-endian 32-bit integers; with `decoded`, also a
    column of that name with the text the ids decode to, in the same pass. Null and empty
    texts have no ids. Columns of those names are replaced. The vocabulary is broadcast;
    its size is that of the model file."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model_file))
    others = docs.select(*[F.col(f"`{c}`") for c in docs.columns
                           if c not in (text, ids, crc, decoded)])
    state = docs.select(F.col(text).alias(OWN + "text"), *[F.col(f"`{c}`") for c in others.columns])
    back = int(decoded is not None)
    done = state.mapInArrow(tidy(_encoded(shared, back)), ", ".join(
        [*_kinds(others), f"`{OWN}ids` array<int>", f"`{OWN}crc` long"]
        + [f"`{OWN}text` string"] * back))
    names = {OWN + "ids": ids, OWN + "crc": crc}
    return done.withColumnsRenamed(names | ({OWN + "text": decoded} if back else {}))


def decode(encoded, model_file, ids="ids", text="text"):
    """`encoded` with the text of its piece ids as a further column; null ids give null.
    A column of that name is replaced."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(model_file))
    others = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != text])
    state = encoded.select(F.col(ids).alias(OWN + "ids"),
                           *[F.col(f"`{c}`") for c in others.columns])
    done = state.mapInArrow(_decoded(shared), ", ".join([*_kinds(others), f"`{OWN}text` string"]))
    return done.withColumnRenamed(OWN + "text", text)

"""Document quality by attention-based multiple-instance learning over passages."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import OWN, bucket_of, tidy

#: Words of a passage. A document is a bag of passages.
PASSAGE = 60

_UPPER, _LOWER, _DIGIT, _HIGH = (
    bytes(range(*r)) for r in ((65, 91), (97, 123), (48, 58), (128, 256)))
_MARKS = {"end": b".!?", "comma": b",;:", "shout": b"!", "bar": b"|", "odd": b"#$%&*@^~<>{}[]\\=+_",
          "dash": b"-/", "quote": b"\"'()"}
_KEEP = {name: bytes(set(range(256)) - set(held)) for name, held in
         [("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("high", _HIGH),
                      *_MARKS.items()]}

FEATURES = ["bias", "words", "mean_word", "upper", "digit", *_MARKS, "high", "lines",
            "distinct", "next_same", "top_word", "title", "long_word", "upper_words",
            "marked_words"]


def passage_features(words, newlines):
    """The features of one passage, a list of words as UTF-8 bytes; each is a share or a
    squashed count, so that the scale is that of any other passage."""
    joined, n = b"".join(words), len(words)
    size = max(len(joined), 1)
    kept = {name: len(joined.translate(None, drop)) for name, drop in _KEEP.items()}
    letters = max(kept["upper"] + kept["lower"], 1)
    distinct = set(words)
    counts = max(words.count(w) for w in words[:1] + words[n // 2:n // 2 + 1] + words[-1:])
    return [1.0, min(n / PASSAGE, 1.0), min(size / n / 12, 2.0), kept["upper"] / letters,
            kept["digit"] / size, *[min(kept[m] / n, 2.0) for m in _MARKS],
            kept["high"] / size, min(newlines / n, 1.0), len(distinct) / n,
            sum(map(bytes.__eq__, words, words[1:])) / n, counts / n,
            sum(map(bytes.istitle, words)) / n, sum(len(w) > 20 for w in words) / n,
            sum(map(bytes.isupper, words)) / n,
            sum(w[-1:] in b"#$%&*!|" for w in words) / n]


def bag(text, passage=PASSAGE):
    """The feature rows of every passage of UTF-8 bytes, whole text; a text without words
    is one passage of zeros but for the bias."""
    words = (text or b"").split()
    if not words:
        return [[1.0] + [0.0] * (len(FEATURES) - 1)]
    newlines = (text.count(b"\n") + 1) / len(words)
    rows = []
    for at in range(0, len(words), passage):
        part = words[at:at + passage]
        rows.append(passage_features(part, newlines * len(part)))
    return rows


class AttentionModel:
    """Gated attention over passages:

    e = tanh(x W), a = softmax over the document of v . (tanh(x V) * sigmoid(x U)),
    score = sigmoid(c . sum(a e) + d). Trained on document labels only.
    """

    def __init__(self, features=len(FEATURES), encode=12, gate=8, seed=7):
        rng = np.random.default_rng(seed)
        self.at = {"W": (features, encode), "V": (features, gate), "U": (features, gate),
                   "v": (gate,), "c": (encode,), "d": (1,)}
        self.p = {k: rng.normal(0, 0.4, s) for k, s in self.at.items()}
        self.mean, self.scale = np.zeros(features), np.ones(features)

    def _forward(self, x, starts):
        x = (x - self.mean) / self.scale
        p, sizes = self.p, np.diff(np.append(starts, len(x)))
        e, t = np.tanh(x @ p["W"]), np.tanh(x @ p["V"])
        g = 1 / (1 + np.exp(-(x @ p["U"])))
        raw = (t * g) @ p["v"]
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), sizes))
        a = raw / np.repeat(np.add.reduceat(raw, starts), sizes)
        z = np.add.reduceat(a[:, None] * e, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))
        return x, e, t, g, a, z, y, sizes

    def score(self, x, starts):
        return self._forward(x, starts)[6]

    def fit(self, x, starts, labels, steps=150, rate=0.05, decay=1e-4, balanced=True):
        """Full-batch Adam on the log loss; `balanced` weighs the classes alike."""
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        self.mean[0], self.scale[0] = 0.0, 1.0
        labels = np.asarray(labels, float)
        share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        weigh = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)) if balanced else 1.0
        m = {k: np.zeros(s) for k, s in self.at.items()}
        s2 = {k: np.zeros(s) for k, s in self.at.items()}
        for step in range(1, steps + 1):
            xs, e, t, g, a, z, y, sizes = self._forward(x, starts)
            p = self.p
            dy = (y - labels) * weigh / len(labels)
            dz = np.repeat(dy, sizes)[:, None] * p["c"]
            da = (dz * e).sum(axis=1)
            low = np.repeat(np.add.reduceat(a * da, starts), sizes)
            draw = a * (da - low)
            de = a[:, None] * dz * (1 - e * e)
            dtg = draw[:, None] * p["v"]
            grad = {"c": z.T @ dy, "d": np.array([dy.sum()]), "W": xs.T @ de,
                    "v": (t * g).T @ draw, "V": xs.T @ (dtg * g * (1 - t * t)),
                    "U": xs.T @ (dtg * t * g * (1 - g))}
            for k in p:
                d = grad[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                s2[k] = 0.999 * s2[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(s2[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def _bags(batches):
    for batch in batches:
        rows = [np.asarray(bag(t), np.float32).ravel() for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.float32())), batch.column(1)], ["bag", "label"])


def train(docs, labels, doc_id="doc_id", text="text", label="quality", modulus=4, held_out=2,
          sample=2000, steps=150):
    """A model fitted on at most `sample` labelled documents, as near as hashing gets to
    that number, outside the held-out fold: crc32 of the id as text, modulo `modulus`,
    is not `held_out`. The bound holds for fitting alone; passages of the sample are
    encoded by the executors. With no labelled row of both kinds, every document scores
    the share of ones there is, or 1 with no labels at all."""
    named = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()
                         & (bucket_of(F.col(doc_id), modulus) != held_out))
    named = named.groupBy(doc_id).agg(F.max(label).cast("int").alias(OWN + "label"))
    n = named.count()
    if n > sample:  # at most a little over `sample` rows, which bounds the broadcast too
        named = named.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20))
                            < int((1 << 20) * sample / n))
    joined = (docs.select(F.col(doc_id), F.col(text).cast("binary").alias(OWN + "text"))
              .join(F.broadcast(named), doc_id).select(OWN + "text", OWN + "label"))
    rows = (joined.mapInArrow(_bags, "bag array<float>, label int")
            .sort(F.xxhash64("bag", "label")).collect())
    model = AttentionModel()
    kinds = {r["label"] for r in rows}
    if len(kinds) < 2:
        model.p["c"][:] = 0
        model.p["d"][:] = -4 if kinds == {0} else 4
        return model
    parts = [np.asarray(r["bag"], float).reshape(-1, len(FEATURES)) for r in rows]
    starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
    return model.fit(np.concatenate(parts), starts, [r["label"] for r in rows], steps)


def _scorer(model, first):
    """Adds the score of column `first` as the last column."""
    def run(batches):
        for batch in batches:
            scores = []
            texts = batch.column(first).to_pylist()
            for lo in range(0, len(texts), 256):
                parts = [bag(t) for t in texts[lo:lo + 256]]
                starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
                x = np.asarray([row for p in parts for row in p], float)
                scores.append(model.score(x, starts))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.concatenate(scores) if scores else [],
                                          pa.float64())],
                [*batch.schema.names, OWN + "score"])
    return run


def scored(docs, model, text="text", score="score"):
    """`docs` with the score of every whole text, 0 to 1; null, empty and blank texts are
    scored as one passage without words. A column of that name is replaced."""
    others = [c for c in docs.columns if c not in (text, score)]
    state = docs.select(F.col(text).alias(OWN + "text"), *[F.col(f"`{c}`") for c in others],
                        F.col(text).cast("binary").alias(OWN + "bytes"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)
    done = state.mapInArrow(tidy(_scorer(model, len(state.columns) - 1)),
                            f"{kinds}, `{OWN}score` double")
    return done.select(*[F.col(OWN + "text").alias(c) if c == text else F.col(f"`{c}`")
                         for c in docs.columns if c != score],
                       F.col(OWN + "score").alias(score))


def good_documents(docs, labels, text="text", keep=0.7, **fit):
    """The rows of `docs` that score `keep` or more under a model trained on them."""
    model = train(docs, labels, text=text, **fit)
    return scored(docs, model, text, OWN + "score").where(F.col(OWN + "score") >= keep).drop(
        OWN + "score")

"""Toxicity by weak supervision: voters, a generative label model, a linear classifier."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twoclock.session import kept

from .common import OWN, bucket_of
from .decontam import _WORD

# Lexicons of the given voters. Words are lower case; further lexicons are mined.
LEXICONS = {
    "insults": "idiot idiots moron morons imbecile fool loser losers clown clowns jerk dumb "
               "stupid dimwit halfwit",
    "contempt": "pathetic worthless disgusting trash scum garbage filth vermin repulsive "
                "despicable useless",
    "foreign": "idiota imbécil estúpido escoria basura connard imbécile salaud ordure "
               "dummkopf abschaum arschloch dreckskerl",
}
PATTERNS = ("shut up", "go to hell", "you are a", "you are so", "people like you")

#: Lengths of the word beginnings that are mined, beside whole words.
STEMS = (4, 5, 6)
_KINDS = ("word",) + tuple(f"stem{k}" for k in STEMS)
VOTERS = tuple(LEXICONS) + ("pattern", "several", "loud") + tuple(
    f"{kind}_{level}" for kind in _KINDS for level in ("strong", "weak")) + (
    "mined_twice", "nothing_strong", "nothing_weak")


def words_set(text):
    return set(text.translate(_WORD).split()) if text else set()


def tokens_of(words):
    """Distinct words and word beginnings, each under its kind."""
    found = {b"w" + w for w in words}
    for k in STEMS:
        found |= {b"%d" % k + w[:k] for w in words if len(w) > k}
    return found


class Voters:
    """The voters with what was mined: {token: (index, log odds)}."""

    def __init__(self, mined):
        self.mined = mined
        self.lexicons = [frozenset(w.encode() for w in words.split())
                         for words in LEXICONS.values()]
        self.patterns = [p.encode() for p in PATTERNS]

    def look(self, text):
        """(votes, indexes of the mined tokens it holds) of a text as bytes or None."""
        words = words_set(text)
        found = [self.mined[t] for t in tokens_of(words) if t in self.mined] \
            if self.mined else []
        held = [len(words & lexicon) for lexicon in self.lexicons]
        votes = [int(n > 0) for n in held]
        flat = b" ".join((text or b"").translate(_WORD).split()) if words else b""
        votes.append(int(any(p in flat for p in self.patterns)))
        votes.append(int(sum(held) > 1))
        letters = text.translate(None, _NOT_LETTERS) if text else b""
        upper = sum(map(letters.count, _UPPER)) if letters else 0
        votes.append(int(upper > 0.6 * len(letters) and len(letters) > 20))
        levels = Counter((kind, odds >= STRONG) for _, odds, kind in found)
        for kind in range(len(_KINDS)):
            votes += [int(levels[kind, True] > 0), int(levels[kind, False] > 0)]
        strong = sum(n for (_, level), n in levels.items() if level)
        votes += [int(strong > 1), -int(strong + sum(held) == 0),
                  -int(len(found) + sum(held) == 0)]
        return votes, [i for i, _, _ in found]


STRONG, WEAK = 4.0, 2.0
_UPPER = [bytes([c]) for c in range(65, 91)]
_NOT_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))


def _labelled(docs, labels, doc_id, text, label, modulus, held_out, most):
    """(text, label) of at most a little over `most` labelled rows of the training fold;
    their ids, which that number bounds, are broadcast, so no text is shuffled."""
    named = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()
                          & (bucket_of(F.col(doc_id), modulus) != held_out))
             .groupBy(doc_id).agg(F.max(label).cast("int").alias(OWN + "label")))
    n = named.count()
    if n > most:
        named = named.where(F.pmod(F.xxhash64(doc_id), F.lit(1 << 20))
                            < int((1 << 20) * most / n))
    return (docs.select(F.col(doc_id), F.col(text).cast("binary").alias(OWN + "text"))
            .join(F.broadcast(named), doc_id).select(F.col(OWN + "text").alias("text"),
                                                     F.col(OWN + "label").alias("label")))


def _counted(wanted):
    """Partial counts of the documents each token is in, flushed at a bounded size."""
    def run(batches):
        only = wanted.value if wanted else None
        counts = Counter()

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                ["token", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = tokens_of(words_set(text))
                counts.update(found if only is None else found & only)
                if len(counts) > 200_000:
                    yield out()
                    counts.clear()
        yield out()
    return run


def mine(labelled, share=0.005, most=4000):
    """{token: (index, log odds, kind)}: words and word beginnings that mark the toxic
    documents of `labelled` (text as binary, label). A token must be in at least `share`
    of them, which also bounds the list that is broadcast by their mean number of
    distinct tokens over `share`. At most `most` tokens, the heaviest, make the model."""
    spark = labelled.sparkSession
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label")
             .agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad:
        return {}

    def counts(label, wanted=None):
        part = labelled.where(F.col("label") == label).select("text")
        return (part.mapInArrow(_counted(wanted), "token binary, n long")
                .groupBy("token").agg(F.sum("n").alias("n")))
    frequent = counts(1).where(F.col("n") >= max(3, math.ceil(share * bad))).collect()
    ones = {bytes(r["token"]): r["n"] for r in frequent}
    shared = spark.sparkContext.broadcast(frozenset(ones))
    zeros = {bytes(r["token"]): r["n"] for r in counts(0, shared).collect()} if good else {}
    odds = {t: math.log((n + .5) / (bad + 1)) - math.log((zeros.get(t, 0) + .5) / (good + 1))
            for t, n in ones.items()}
    chosen = sorted((t for t in odds if odds[t] >= WEAK),
                    key=lambda t: (-odds[t] * ones[t], t))[:most]
    kinds = {b"w": 0, **{b"%d" % k: 1 + i for i, k in enumerate(STEMS)}}
    return {t: (i, odds[t], kinds[t[:1]]) for i, t in enumerate(chosen)}


class LabelModel:
    """Accuracies and correlations of voters, estimated from how often each pattern of
    votes occurs; what is latent is the true label.

    The voters of one group are modelled jointly given the label, the groups are
    independent given it. The first fit has a group for each voter; voters whose votes
    stay correlated given its posteriors then share a group, and the fit is repeated.
    """

    def __init__(self, prior):
        self.prior, self.groups, self.tables = prior, [], []

    def _fit(self, votes, weights, anchor, rounds):
        votes = [tuple(v) for v in votes]
        parts = [[tuple(v[k] for k in g) for v in votes] for g in self.groups]
        codes = []
        for part in parts:
            index = {p: i for i, p in enumerate(dict.fromkeys(part))}
            codes.append((index, np.array([index[p] for p in part])))
        post = anchor / np.maximum(anchor.sum(axis=1, keepdims=True), 1e-9)
        known = anchor.sum(axis=1) > 0
        majority = np.array([sum(v) > 0 for v in votes])
        post = np.where(known[:, None], post, np.column_stack([~majority, majority]))
        for _ in range(rounds):
            mass = post * weights[:, None] + anchor
            score = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
            self.tables = []
            for index, code in codes:
                table = np.full((len(index), 2), 0.5)
                np.add.at(table, code, mass)
                table = np.log(table / (table.sum(axis=0) + 1))
                self.tables.append((index, table))
                score = score + table[code]
            score -= score.max(axis=1, keepdims=True)
            post = np.exp(score)
            post /= post.sum(axis=1, keepdims=True)
        return post

    def fit(self, votes, weights, anchor, rounds=25, tie=0.15):
        """`votes`: patterns; `weights`: documents of each; `anchor`: of those, how many
        are labelled clean and toxic in the training fold."""
        n = len(votes[0])
        anchor = anchor * (weights.sum() / max(anchor.sum(), 1))  # labels weigh as the rest
        self.groups = [(k,) for k in range(n)]
        post = self._fit(votes, weights, anchor, rounds)
        v, near = np.array(votes, float), np.zeros((n, n))
        for y in (0, 1):
            w = post[:, y] * weights + anchor[:, y]
            if w.sum() < 10:
                continue
            mean = (w[:, None] * v).sum(axis=0) / w.sum()
            cov = ((v - mean) * w[:, None]).T @ (v - mean) / w.sum()
            dev = np.sqrt(np.diag(cov))
            near = np.maximum(near, np.abs(cov) / np.maximum(np.outer(dev, dev), 1e-6))
        self.correlations, home = near, list(range(n))
        for a, b in zip(*np.where(near > tie)):
            if a < b and home[a] != home[b]:
                old, new = max(home[a], home[b]), min(home[a], home[b])
                home = [new if h == old else h for h in home]
        self.groups = [tuple(k for k in range(n) if home[k] == h) for h in sorted(set(home))]
        post = self._fit(votes, weights, anchor, rounds)
        self.accuracies = [
            float((np.where(v[:, k] > 0, post[:, 1], post[:, 0]) * weights)[v[:, k] != 0].sum()
                  / max(weights[v[:, k] != 0].sum(), 1e-9)) for k in range(n)]
        return post[:, 1]


class Linear:
    """Logistic regression on votes and mined tokens, fitted on soft labels."""

    def __init__(self, n_votes, n_tokens):
        self.w, self.n_votes = np.zeros(1 + 2 * n_votes + n_tokens), n_votes

    def _columns(self, votes, tokens):
        at = [0] + [1 + 2 * k + (v < 0) for k, v in enumerate(votes) if v]
        return at + [1 + 2 * self.n_votes + t for t in tokens]

    def fit(self, rows, target, weights, steps=300, rate=0.1, decay=1e-4):
        cols = [self._columns(*r) for r in rows]
        sizes = [len(c) for c in cols]
        flat, starts = np.concatenate(cols), np.cumsum([0] + sizes[:-1])
        m, s2 = np.zeros_like(self.w), np.zeros_like(self.w)
        weights = weights / weights.sum()
        for step in range(1, steps + 1):
            y = 1 / (1 + np.exp(-np.clip(np.add.reduceat(self.w[flat], starts), -30, 30)))
            g = np.bincount(flat, np.repeat((y - target) * weights, sizes), len(self.w))
            g[1:] += decay * self.w[1:]
            m, s2 = 0.9 * m + 0.1 * g, 0.999 * s2 + 0.001 * g * g
            self.w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s2 / (1 - 0.999 ** step)) + 1e-8)
        return self

    def score(self, votes, tokens):
        z = self.w[self._columns(votes, tokens)].sum()
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def _looked(mined):
    def run(batches):
        voters = Voters(mined.value)
        for batch in batches:
            found = [voters.look(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([v for v, _ in found], pa.list_(pa.int8())),
                 pa.array([t for _, t in found], pa.list_(pa.int32()))],
                [*batch.schema.names[1:], "votes", "tokens"])
    return run


def _rated(linear):
    def run(batches):
        for batch in batches:
            n = batch.num_columns - 2
            scores = [linear.score(v, t) for v, t in zip(
                batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(scores, pa.float64())],
                [*batch.schema.names[:n], "score"])
    return run


def toxicity(docs, labels, doc_id="doc_id", text="text", label="toxic", modulus=5, held_out=0,
             labelled=20_000, sample=6000, share=0.005, most=4000):
    """(doc_id, score) for every row of `docs`: 0 to 1, higher is likelier toxic.

    Lexicon and pattern voters, given and mined from about `labelled` rows of the
    training fold (crc32 of the id as text, modulo `modulus`, is not `held_out`), vote on
    every whole text. The label model is fitted on the counts of all vote patterns of the
    corpus, with all training labels as a prior; a linear classifier is fitted on the
    posterior labels of about `sample` documents, half of them likely toxic, and scores
    all. The two bounds hold for fitting alone. A word or word beginning becomes part of
    the classifier if at least `share` of the toxic documents among the labelled ones hold
    it; of those, the `most` with the heaviest odds do. They are parameters of the model,
    like its regularisation, and cut no document and no text.

    Null and empty texts have no words and score like any text without a hit. Rows with
    no doc_id are scored and never used as labelled. Repeated rows give repeated results.
    Without labels of both kinds the given voters alone decide. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    mined = spark.sparkContext.broadcast(
        mine(_labelled(docs, labels, doc_id, text, label, modulus, held_out, labelled),
             share, most))
    kind = docs.schema[doc_id].dataType.simpleString()
    seen = kept(docs.select(F.col(text).cast("binary").alias(OWN + "text"),
                            F.col(doc_id).alias("doc_id"))
                .mapInArrow(_looked(mined), f"doc_id {kind}, votes array<byte>, "
                                            "tokens array<int>"))
    truth = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()
                          & (bucket_of(F.col(doc_id), modulus) != held_out))
             .groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("truth")))
    patterns = (seen.join(truth, "doc_id", "left").groupBy("votes").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("truth") == 0).alias("clean"),
        F.count_if(F.col("truth") == 1).alias("toxic")).orderBy("votes").collect())
    linear = _fitted(seen, patterns, len(mined.value), sample)
    return seen.mapInArrow(_rated(linear), f"doc_id {kind}, score double")


def _fitted(seen, patterns, n_tokens, sample):
    linear = Linear(len(VOTERS), n_tokens)
    if not patterns:
        return linear
    votes = [list(r["votes"]) for r in patterns]
    counts = np.array([r["n"] for r in patterns], float)
    anchor = np.array([[r["clean"], r["toxic"]] for r in patterns], float)
    share = anchor[:, 1].sum() / max(anchor.sum(), 1)
    model = LabelModel(min(max(share if anchor.sum() else 0.1, 0.01), 0.99))
    post = dict(zip(map(tuple, votes), model.fit(votes, counts, anchor)))
    strata = [[v for v in post if (post[v] >= .5) == side] for side in (False, True)]
    rows, target, weights = [], [], []
    for side in strata:
        total = sum(n for v, n in zip(map(tuple, votes), counts) if v in set(side))
        if not total:
            continue
        part = min(1.0, sample / 2 / total)
        keys = seen.sparkSession.createDataFrame([(list(v),) for v in side], "votes array<byte>")
        drawn = (seen.join(F.broadcast(keys), "votes")
                 .where(F.pmod(F.xxhash64("doc_id", "votes", "tokens"), F.lit(1 << 20))
                        < int(part * (1 << 20)) + 1)
                 .groupBy("votes", "tokens").agg(F.count(F.lit(1)).alias("n"))
                 .sort("votes", "tokens").collect())
        # Rows alike in both come as one with their number, so a text that many rows repeat,
        # drawn with all of them, is one row here.
        every = sum(r["n"] for r in drawn)
        for r in drawn:
            rows.append((r["votes"], r["tokens"]))
            target.append(post[tuple(r["votes"])])
            weights.append(total / every * r["n"])
    weights = np.array(weights)
    return linear.fit(rows, np.array(target), weights)

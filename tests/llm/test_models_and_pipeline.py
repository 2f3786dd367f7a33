import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twoclock.llm import decontam, linededup, pieces, quality, simhash, toxicity
from twoclock.llm import queries as llm_queries
from twoclock.session import kept

DATA = "/root/testdata/sf0.01"
GIVEN = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


def read(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


def test_attention_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    x, starts = rng.normal(size=(9, 4)), np.array([0, 2, 3, 7])
    y = np.array([1.0, 0, 1, 0])

    def loss(model):
        p = model.score(x, starts)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    for name in ("W", "V", "U", "v", "c", "d"):
        model = quality.AttentionModel(features=4, encode=3, gate=2)
        before = loss(model)
        frozen = {k: v.copy() for k, v in model.p.items()}
        model.mean, model.scale = np.zeros(4), np.ones(4)
        model.fit(x, starts, y, steps=1, rate=1e-4, decay=0, balanced=False)
        fitted = {k: model.p[k] if k == name else v for k, v in frozen.items()}
        model.p = fitted
        assert loss(model) < before  # the first Adam step goes down along every weight


def held_out_accuracy(rows, labels, column, wanted):
    mine = [(labels[r["doc_id"]][column], r["predicted"]) for r in rows
            if r["doc_id"] in labels and r["held_out"] == wanted]
    return sum(a == b for a, b in mine) / len(mine)


@GIVEN
@pytest.mark.parametrize("name,column,modulus,fold,least", [
    ("op6_quality", "quality", 4, 2, 0.95), ("op1_toxicity", "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, name, column, modulus, fold, least):
    rows = llm_queries.QUERIES[name](spark, DATA).collect()
    labels = {r["doc_id"]: r for r in read(spark, "labels").collect()}
    assert len(rows) == read(spark, "documents").count()
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == fold)
    assert held_out_accuracy(rows, labels, column, True) >= least


ODD = [None, "", " \n ", "x", "word " * 30000, "ÀÉÎ ¿?", "tie", "tie"]


def test_classifiers_take_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, "s", 0.5) for k, t in enumerate(ODD)] + [(None, "no id", "s", 0.5)],
                                 "doc_id long, text string, label string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 1), (3, None, None), (6, 0, 1),
                                  (4, 1, 0), (5, 0, 1), (8, 1, 1), (2, 1, 0)],
                                 "doc_id long, quality int, toxic int")
    for labels in (none, some):
        scored = quality.scored(docs, quality.train(docs, labels, steps=5))
        assert scored.columns == docs.columns and scored.count() == len(ODD) + 1
        assert quality.good_documents(docs, labels, steps=5).columns == docs.columns
        found = toxicity.toxicity(docs, labels).collect()
        assert len(found) == len(ODD) + 1 and all(0 <= r["score"] <= 1 for r in found)
    assert toxicity.toxicity(docs.limit(0), some).count() == 0
    assert quality.scored(docs.limit(0), quality.train(docs, none)).count() == 0


def test_label_model_recovers_accuracies_and_a_correlated_pair():
    rng = random.Random(0)
    truth = {"acc": (0.95, 0.9, 0.8, 0.8)}
    counts, known = {}, {}
    for n in range(20000):
        y = rng.random() < 0.3
        votes = [1 if (rng.random() < a) == y else -1 for a in truth["acc"][:3]]
        votes.append(votes[2] if rng.random() < 0.9 else (1 if rng.random() < 0.5 else -1))
        key = tuple(votes)
        counts[key] = counts.get(key, 0) + 1
        if n % 10 == 0:
            known.setdefault(key, [0, 0])[y] += 1
    patterns = sorted(counts)
    model = toxicity.LabelModel(0.3)
    post = model.fit([list(p) for p in patterns], np.array([counts[p] for p in patterns], float),
                     np.array([known.get(p, [0, 0]) for p in patterns], float))
    assert (2, 3) in model.groups and (0,) in model.groups
    for k, accuracy in enumerate(truth["acc"][:3]):
        assert abs(model.accuracies[k] - accuracy) < 0.05
    assert all((p > 0.5) == (pattern[0] > 0) for p, pattern in zip(post, patterns)
               if pattern[0] == pattern[1])


@GIVEN
def test_pipeline_stages_against_brute_force(spark):
    docs = read(spark, "documents")
    columns, vocabulary = docs.columns, pieces.vocabulary(corpus_pipeline.MODEL_FILE)
    (_, first), (_, second), (_, third), (_, fourth), (_, fifth) = corpus_pipeline.STAGES
    good = kept(first(spark, docs, DATA))
    labels = {r["doc_id"]: r["quality"] for r in read(spark, "labels").collect()}
    stayed = {r["doc_id"] for r in good.select("doc_id").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in stayed for i in clean) >= 0.99 * len(clean)
    assert sum(i in stayed for i, q in labels.items() if q == 0) <= 0.05 * len(labels)

    left = kept(second(spark, good, DATA))
    seen, lines = {}, {}
    for r in good.orderBy("doc_id").collect():
        gone, held = set(), linededup.lines_of(r["text"].encode())
        for a, b in linededup.windows_of([n for _, _, n in held], 10):
            run = tuple(x for _, x, _ in held[a:b + 1])
            place = (r["doc_id"], held[a][0], held[b][0])
            was = seen.setdefault(run, place)
            if was != place:
                start = max(held[a][0], was[2] + 1) if was[0] == r["doc_id"] else held[a][0]
                gone.update(n for n, _, _ in held[a:b + 1] if n >= start)
        text = r["text"].split("\n")
        worded = [n for n, _, _ in held]
        for a, b in zip(worded, worded[1:]):
            if a in gone and b in gone:
                gone.update(range(a, b))
        lines[r["doc_id"]] = "\n".join(x for n, x in enumerate(text) if n not in gone)
    assert {r["doc_id"]: r["text"] for r in left.collect()} == {
        i: t for i, t in lines.items() if t.strip()}

    one = kept(third(spark, left, DATA))
    rows = left.orderBy("doc_id").collect()
    prints = np.array([simhash.fingerprint_of(r["text"].encode()) for r in rows], np.int64).view(np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    least = np.arange(len(rows))
    while (lower := np.where(near, least[None, :], len(rows)).min(axis=1)).tolist() != least.tolist():
        least = lower
    assert {r["doc_id"] for r in one.select("doc_id").collect()} == {
        rows[k]["doc_id"] for k in range(len(rows)) if least[k] == k}

    free = kept(fourth(spark, one, DATA))
    tests = [(b["item_id"], decontam.words_of(b["text"].encode()))
             for b in read(spark, "benchmark").collect()]
    windows = {tuple(w[i:i + 10]) for _, w in tests for i in range(len(w) - 9)}
    assert min(len(w) for _, w in tests) >= 10

    def dirty(text):
        w = decontam.words_of(text.encode())
        return any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9))
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    assert {r["doc_id"] for r in free.select("doc_id").collect()} == {
        i for i, t in texts.items() if not dirty(t)}
    for frame in (good, left, one, free):
        assert frame.columns == columns

    last = fifth(spark, free, DATA).collect()
    codec = pieces.PieceCodec(vocabulary)
    assert len(last) == free.count()
    for r in last[::10]:
        assert r["ids"] == codec.encode(texts[r["doc_id"]]).tolist()
        assert r["text"] == texts[r["doc_id"]]
    ran = corpus_pipeline.run(spark, DATA)
    assert sorted(map(tuple, ran.select("doc_id", "ids_crc32").collect())) == sorted(
        (r["doc_id"], r["ids_crc32"]) for r in last)


def test_pipeline_stages_take_empty_tables(spark, tmp_path):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for name, frame in (("labels", labels), ("benchmark", bench)):
        frame.write.parquet(str(tmp_path / f"{name}.parquet"))
    odd = [(k, t, "en", "s", 1) for k, t in enumerate(ODD)] + [(None, None, None, None, None)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, kinds)
        for _, stage in corpus_pipeline.STAGES:
            docs = kept(stage(spark, docs, str(tmp_path)))
        assert docs.count() == (0 if not rows else docs.select(F.col("text")).count())

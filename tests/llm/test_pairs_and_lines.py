import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twoclock.llm import decontam, linededup, simhash, similar
from twoclock.llm.common import components

DOC = "doc_id long, text string, lang string, key string, fingerprint long"


def docs_of(spark, texts, ids=None):
    ids = ids if ids is not None else range(len(texts))
    return spark.createDataFrame([(i, t, "en", "k", 7) for i, t in zip(ids, texts)], DOC)


def closure(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_hubs_and_nothing(spark):
    rng = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(200, 400)]
    edges += [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(200)]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    want = closure({x for e in edges for x in e}, edges)
    linked = {x for e in edges for x in e if e[0] != e[1]}
    assert {r["node"]: r["component"] for r in got} == {n: want[n] for n in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = []
    for part in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "") \
            .replace("\t", " ").replace("\n", " ").split(" "):
        if part:
            words.append(part)
    shingles = [" ".join(words[k:k + 4]) for k in range(len(words) - 3)] \
        if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["Été", "ÀB", "X Y"]
    texts = [None, "", " \n\t", "one", "ONE", "one two three"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randrange(5, 200))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
    texts.append("long " * 70000)
    ids = [5 * k + 3 for k in range(len(texts))]
    prints = {i: plain_fingerprint(t) for i, t in zip(ids, texts)}
    pairs = [(a, b) for a in ids for b in ids
             if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4]
    want = closure(ids, pairs)
    docs = docs_of(spark, texts + [texts[3]], [*ids, None])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert r["fingerprint"] % (1 << 64) == prints[r["doc_id"]]
            assert r["component_id"] == want[r["doc_id"]]
    kept = simhash.one_of_each_group(docs.unionByName(docs.where("doc_id = 3")))
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == \
        sorted(set(want.values()))
    assert kept.where("doc_id is null").count() == 1


@pytest.mark.parametrize("threshold", [1, 2, 4, 7])
def test_pigeonring_loses_no_link(spark, threshold):
    rng = random.Random(threshold)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(12):
            near = base
            for b in rng.sample(range(64), rng.randrange(threshold + 3)):
                near ^= 1 << b
            prints.add(near)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = {(a, b) for a in signed for b in signed
            if a < b and bin((a ^ b) % (1 << 64)).count("1") <= threshold}
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"),
                        threshold)
    assert {tuple(r) for r in got.collect()} == want


def test_simhash_of_an_empty_table(spark):
    empty = docs_of(spark, [])
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.one_of_each_group(empty).count() == 0


def test_similar_groups_match_brute_force(spark):
    import corpus_pipeline
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", "one", "ONE", "a b c d e f", "a b c d e f " * 3]
    for k in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(12, 150))]
        texts.append(" ".join(base))
        for _ in range(30 if k == 3 else rng.randrange(4)):
            near = list(base)
            for _ in range(rng.randrange(1, 4)):
                near[rng.randrange(len(near))] = rng.choice(words)
            texts.append(" ".join(near))
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, "another text under a known id"), (3, texts[3])]

    def cut(text):
        w = (text or "").lower().split()
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    sets, prints = [cut(t) for _, t in rows], [plain_fingerprint(t) for _, t in rows]
    alike, far = [], 0
    for a in range(len(rows)):
        for b in range(a):
            bits = bin(prints[a] ^ prints[b]).count("1")
            near = bool(sets[a]) and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
            far += near and bits > 4
            if near or bits <= 4:
                alike.append((b, a))
    assert far > 50
    want = closure(range(len(rows)), alike)
    order = {}
    for k, group in want.items():
        order.setdefault(group, set()).add(rows[k])
    docs = docs_of(spark, [t for _, t in rows] + ["one"], [i for i, _ in rows] + [None])
    stay = corpus_pipeline.near_dedup(spark, docs, None)
    assert stay.columns == docs.columns
    left = [(r["doc_id"], r["text"]) for r in stay.collect()]
    assert left.count((None, "one")) == 1 and len(left) == len(order) + 1
    for group in order.values():
        least = min(i for i, _ in group)
        assert sum(x in left for x in group) == 1
        assert any(x in left for x in group if x[0] == least)
    assert similar.one_of_each_group(docs.limit(0)).count() == 0


def plain_dedup(rows, min_words):
    """Every run of lines against every earlier run, in all lengths."""
    seen, out = {}, {}
    order = sorted({(r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())
                    : r for r in rows if r[1] is not None}.items())
    lines = {k: [(n, " ".join(x.split())) for n, x in enumerate(r[1].split("\n"))
                 if x.split()] for k, r in order}
    places = {}
    for key, _ in order:
        held = lines[key]
        for i in range(len(held)):
            for j in range(i, len(held)):
                if sum(len(x.split()) for _, x in held[i:j + 1]) >= min_words:
                    run = tuple(x for _, x in held[i:j + 1])
                    places.setdefault(run, []).append((key, held[i][0], held[j][0]))
    gone = {key: set() for key, _ in order}
    for run, found in places.items():
        found.sort()
        for key, first, last in found[1:]:
            start = max(first, found[0][2] + 1) if key == found[0][0] else first
            gone[key].update(n for n, _ in lines[key] if start <= n <= last)
    for key, r in order:
        text = r[1].split("\n")
        worded = [n for n, _ in lines[key]]
        for a, b in zip(worded, worded[1:]):
            if a in gone[key] and b in gone[key]:
                gone[key].update(range(a, b))
        out[(r[0], r[1])] = "\n".join(x for n, x in enumerate(text) if n not in gone[key])
    return out


@pytest.mark.parametrize("min_words", [1, 4, 9])
def test_line_dedup_matches_brute_force(spark, min_words):
    rng = random.Random(min_words)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 7)))
            for _ in range(25)] + ["", "  ", "tab\tsep", "a  b "]
    rows = [(None if k == 3 else k - 5,
             "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 14))))
            for k in range(70)]
    rows += [(900, None), (901, ""), rows[10], (902, rows[11][1])]
    frame = spark.createDataFrame([(i, t, "n", "k", 1) for i, t in rows],
                                  "doc_id long, text string, key string, first string, last int")
    got = linededup.dedup_lines(frame, min_words=min_words)
    assert got.columns == [*frame.columns, "n_lines", "n_removed"]
    want = plain_dedup(rows, min_words)
    source = {}
    for i, t in rows:
        source.setdefault(i, []).append(t)
    rows_got = got.collect()
    assert len(rows_got) == len(rows)
    for r in rows_got:
        if r["doc_id"] == 900:
            assert r["text"] is None and r["n_lines"] == 0
            continue
        assert r["text"] in {want[(r["doc_id"], t)] for t in source[r["doc_id"]]}
        assert r["n_lines"] - r["n_removed"] in {
            0 if r["n_removed"] == r["n_lines"] else r["text"].count("\n") + 1}


def test_line_dedup_keeps_the_first_and_drops_emptied(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, f"own one\n{passage}"), (2, f"{passage}\nother"), (3, passage), (4, ""),
            (5, None), (6, "short\nshort\nshort")]
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    left = {r["doc_id"]: r["text"] for r in linededup.without_repeats(docs).collect()}
    assert left == {1: rows[0][1], 2: "other", 4: "", 5: None, 6: rows[5][1]}
    assert linededup.without_repeats(docs.limit(0)).count() == 0
    places = linededup.repeated_runs(docs).select("first", "last", "kept_first").collect()
    assert sorted(map(tuple, places)) == [(0, 0, 1), (0, 0, 1)]


@pytest.mark.parametrize("min_words", [4, 10])
def test_line_dedup_of_whole_lines_matches_brute_force(spark, min_words):
    rng = random.Random(min_words)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 6)))
            for _ in range(25)] + ["", "  ", "long line " * 6]
    rows = [(k - 5, "\n".join([*(rng.choice(pool) for _ in range(rng.randrange(0, 14))), f"own {k}"]))
            for k in range(60)]
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    got = {r["doc_id"]: r for r in linededup.dedup_lines(
        docs, min_words=min_words, whole_lines=True).collect()}
    seen = set()
    for i, text in rows:
        lines = text.split("\n")
        words = [tuple(x.split()) for x in lines]
        gone = set()
        for n, w in enumerate(words):
            if w and w in seen:
                gone.add(n)
            seen.add(w)
        worded = [n for n, w in enumerate(words) if w]
        for a, b in zip(worded, worded[1:]):
            if a in gone and b in gone:
                gone.update(range(a, b))
        assert got[i]["text"] == "\n".join(x for n, x in enumerate(lines) if n not in gone)
        assert got[i]["n_removed"] == len(gone)


def test_pipeline_line_stage_leaves_no_repeated_line(spark):
    import corpus_pipeline
    docs = docs_of(spark, ["menu\nfirst own text", "menu\nsecond own text", "menu"]) \
        .withColumn("n_chars", F.length("text").cast("long"))
    left = corpus_pipeline.line_dedup(spark, docs, None).collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in left} == {
        0: ("menu\nfirst own text", 19), 1: ("second own text", 15)}


def plain_contamination(text, items, window):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if ord(c) > 127 or c.isascii() and c.isalnum() else " "
                       for c in low).split(" ")
    doc = [w for w in words(text) if w]
    hit, found = set(), set()
    for item, t in items:
        own = [w for w in words(t) if w]
        size = min(window, len(own))
        for i in range(len(own) - size + 1) if own else ():
            for j in range(len(doc) - size + 1):
                if doc[j:j + size] == own[i:i + size]:
                    hit.update(range(j, j + size))
                    found.add(item)
    return len(doc), len(hit), found


@pytest.mark.parametrize("block_bytes", [1, 120, 10_000])
def test_contamination_matches_brute_force(spark, block_bytes):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice("abcé") for _ in range(n)))
             for k, n in enumerate([0, 1, 2, 3, 5, 9, 10, 11, 14, 20])]
    items[1] = (1, "unique-word")
    items += [(10, None), (11, items[9][1]), (12, "?!")]
    texts = [None, "", "!!", "UNIQUE word", "ÉA éa x"]
    for _ in range(40):
        parts = [rng.choice("abcéxyz") for _ in range(rng.randrange(40))]
        if rng.random() < .6:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(items)[1] or "")
        texts.append(rng.choice([" ", ", ", "\n"]).join(parts).upper())
    docs = docs_of(spark, texts).withColumn("items", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.digest(decontam.contamination(docs, bench, window=10,
                                                 block_bytes=block_bytes)).collect()
    clean = {r["doc_id"] for r in decontam.clean_documents(docs, bench).collect()}
    for r in got:
        n, hit, found = plain_contamination(texts[r["doc_id"]], items, 10)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(found))
        assert r["items_sha256"] == decontam.items_digest(found)
        assert r["contaminated"] == (hit > 0) == (r["doc_id"] not in clean)
    assert len(got) == len(texts)


def test_contamination_with_empty_tables(spark):
    docs, none = docs_of(spark, ["a b", None]), spark.createDataFrame([], "item_id long, text string")
    got = decontam.digest(decontam.contamination(docs, none)).collect()
    assert [(r["n_hit"], r["contaminated"]) for r in got] == [(0, False)] * 2
    assert decontam.contamination(docs.limit(0), none).count() == 0
    assert decontam.clean_documents(docs, none).columns == docs.columns


def test_sketches_never_differ_more_than_the_sets():
    rng = random.Random(5)
    for _ in range(200):
        pool = [rng.getrandbits(63) - (1 << 62) for _ in range(rng.choice([3, 40, 900]))]
        one, two = (np.array(sorted({h for h in pool if rng.random() < share}), np.int64)
                    for share in (rng.random(), rng.random()))
        x, y = similar.sketch_of(one), similar.sketch_of(two)
        differ = len(np.setxor1d(one, two))
        assert similar.sketches_differ(x, y) <= differ
        assert (differ - similar.sketches_differ(x, y)) % 2 == 0
    assert similar.sketches_differ(similar.sketch_of(one), similar.sketch_of(one)) == 0

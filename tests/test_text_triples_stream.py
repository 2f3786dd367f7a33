import random
import re

import pytest

from conftest import CLAIM, day
from twoclock.operators import textmatch, triples
from twoclock.operators.resolve import standing
from twoclock.streaming import incremental


def _brute(subjects, texts):
    split = re.compile(r"[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+")

    def words(text):
        return [w.lower() for w in split.findall(text) if len(w) > 3]

    out = {}
    for key, name, described in subjects:
        wanted = [(w, 6) for w in words(name)] + [(w, 1) for w in dict.fromkeys(words(described))]
        best, score = None, 0
        for n, text in enumerate(texts):
            here = 0
            for w, weight in wanted:
                held = [t for t in texts if re.search(rf"\b{w}", t.lower())]
                if held and re.search(rf"\b{w}", text.lower()):
                    here += weight / len(held)
            if here > score + 1e-9:
                best, score = n, here
        out[key] = (best, round(score, 6) if best is not None else None)
    return out


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_best_paragraph_is_exact(spark, seed):
    rng = random.Random(seed)
    stems = ["stock", "count", "line", "flavour", "batch", "freezer", "rota", "élan", "the"]
    ends = ["", "s", "ing", "_x", "é"]
    texts = [" ".join(rng.choice(stems) + rng.choice(ends) for _ in range(rng.randrange(0, 9)))
             for _ in range(30)] + ["Stock,Count-LINE", "stock count line"]
    subjects = [(k, "".join(w.title() for w in rng.sample(stems[:7], 2)),
                 " ".join(rng.choice(stems) for _ in range(4))) for k in range(12)]
    subjects += [(90, "Nothing", "matches here"), (91, "abc", "a bb ccc")]
    got = textmatch.best_paragraph(
        spark.createDataFrame(subjects, "key int, name string, description string"),
        spark.createDataFrame(list(enumerate(texts)), "index int, text string"))
    expected = _brute(subjects, texts)
    assert {r.key: (r["index"], r.score and round(r.score, 6)) for r in got.collect()} == expected


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, "\n\n a \n \t\n\nb\nc\n \n\n d ")],
                               "doc_id int, text string")
    assert [(r.position, r.paragraph) for r in textmatch.paragraphs(df).collect()] == [
        (0, "a"), (1, "b\nc"), (2, "d")]


def test_domains_and_ranges(spark):
    T = triples
    rows = [("p1", T.TYPE, T.OBJECT_PROPERTY), ("p2", T.TYPE, T.OBJECT_PROPERTY),
            ("p3", T.TYPE, "rdf:Property"), ("A", T.SUBCLASS, "_:n1"), ("B", T.SUBCLASS, "_:n2"),
            ("_:x", T.SUBCLASS, "_:n2"), ("A", T.SUBCLASS, "_:n3"), ("A", T.SUBCLASS, "_:n4"),
            *[(n, T.TYPE, T.RESTRICTION) for n in ("_:n1", "_:n2", "_:n3")],
            ("_:n1", T.ON, "p1"), ("_:n2", T.ON, "p1"), ("_:n3", T.ON, "p2"),
            ("_:n4", T.ON, "p3"), ("_:n1", T.ALL_FROM, "C"), ("_:n3", T.ALL_FROM, "C"),
            ("p2", T.RANGE, "xsd:string"), ("C", T.TYPE, T.CLASS)]
    df = spark.createDataFrame(rows, "s string, p string, o string")
    got = T.inferred(df)
    assert {(r.property, r.side, r.outcome, tuple(r.members or ())) for r in got.collect()} == {
        ("p1", "domain", "union", ("A", "B")), ("p1", "range", "added", ("C",)),
        ("p2", "domain", "single", ("A",)), ("p2", "range", "kept", ()),
        ("p3", "domain", "none", ()), ("p3", "range", "none", ())}
    whole = T.with_inferred(df, got)
    assert [r.property for r in T.drawable_edges(whole).collect()] == ["p1"]


def test_closure_of_a_deep_tree(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(37)] + [("n0", "m")],
                                  "parent string, child string")
    got = triples.closure(edges)
    assert got.count() == 38 * 39 // 2 + 2
    assert got.where("ancestor = 'n0'").count() == 39


def test_ancestors_of_deep_and_circular_graphs(spark):
    rng = random.Random(2)
    deep = [(f"n{i}", f"n{i + 1}") for i in range(700)]
    circle = [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [("c3", "d"), ("d", "e"), ("n5", "c0")]
    mixed = [(f"m{rng.randrange(30)}", f"m{rng.randrange(30)}") for _ in range(40)]
    edges = deep + circle + mixed + [(None, "n0"), ("x", "x")]
    above = {}
    for parent, child in edges:
        above.setdefault(child, set()).add(parent)
    asked = ["n700", "n3", "e", "c4", "stranger", *[f"m{k}" for k in range(0, 30, 4)]]
    want = set()
    for node in asked:
        seen, todo = {node}, [node]
        while todo:
            for up in above.get(todo.pop(), ()):
                if up is not None and up not in seen:
                    seen.add(up)
                    todo.append(up)
        want |= {(a, node) for a in seen}
    got = triples.ancestors_of(spark.createDataFrame(edges, "parent string, child string"),
                               spark.createDataFrame([(a,) for a in asked + [None]], "node string"))
    assert sorted((r["ancestor"], r["descendant"]) for r in got.collect()) == sorted(want)


def test_state_follows_the_log(spark, tmp_path):
    log_path, state, va = str(tmp_path / "log"), str(tmp_path / "state"), "2026-12-31"

    def write(rows):
        out = [(i, n, s, p, v, day(t), day(t), r) for i, n, s, p, v, t, r in rows]
        spark.createDataFrame(out, CLAIM).coalesce(1).write.mode("append").parquet(log_path)

    def log():
        return spark.read.schema(CLAIM).parquet(log_path)

    def read(df):
        return {(r.subject, r.slot): r.value for r in df.collect()}

    write([("a", 1, "s", "x", "1", "2026-01-01", None), ("b", 2, "t", "x", "2", "2026-01-01", None),
           ("c", 3, "u", "x", "3", "2026-01-01", None)])
    incremental.rebuild(log(), state, va, va, buckets=8)
    checkpoint = str(tmp_path / "cp")

    def catch_up():
        stream = spark.readStream.schema(CLAIM).parquet(log_path)
        q = incremental.maintain(stream, log, state, checkpoint, va, va, buckets=8)
        q.awaitTermination(120)
        assert read(incremental.current_state(spark, state)) == read(standing(log(), va, va))

    catch_up()
    # A newer value, and a retraction that empties another pair from a third one.
    write([("d", 4, "s", "x", "9", "2026-02-01", None), ("e", 5, "v", "y", None, "2026-02-01", "b")])
    catch_up()
    assert read(incremental.current_state(spark, state)) == {("s", "x"): "9", ("u", "x"): "3"}

import pytest
from pyspark.sql import functions as F

from conftest import day
from twoclock.operators import ingest, ranking
from twoclock.operators.resolve import registry, standing, stated
from twoclock.schema import ASSERTION
from twoclock.sources import append_claims, read_claims, read_log


def test_melt_drops_blanks_and_tells_references(spark):
    df = spark.createDataFrame([("t1", "Tub 1", "4.8", "v"), ("t2", "", None, None)],
                               "uri string, name string, kg string, flavour string")
    got = {(r.subject, r.slot, r.value_literal, r.value_ref) for r in ingest.melt(
        df, "uri", {"name": "s:name", "kg": "s:kg", "flavour": "s:flavour"},
        refs=["flavour"], type_slot="s:class", class_name="Tub").collect()}
    assert got == {("t1", "s:name", "Tub 1", None), ("t1", "s:kg", "4.8", None),
                   ("t1", "s:flavour", None, "v"), ("t1", "s:class", "Tub", None),
                   ("t2", "s:class", "Tub", None)}


def test_corrections_withdraw_what_stands(claims, spark):
    log = claims([("a", "x", "1", "2026-01-01", "2026-01-01", None),
                  ("a", "x", "2", "2026-01-02", "2026-01-02", None),
                  ("b", "x", "3", "2026-01-01", "2026-01-01", None)])
    fixes = spark.createDataFrame([("a", "x", "9"), ("b", "x", None), ("c", "x", "1")],
                                  "subject string, slot string, value string")
    now = standing(log, "2026-02-01", "2026-02-01")
    got = ingest.corrections(fixes, now).collect()
    assert {(r.subject, r.value, r.revokes) for r in got} == {("a", "9", "c1"), ("b", None, "c2")}
    again = ingest.corrections(fixes, now).collect()
    assert {r.id for r in got} == {r.id for r in again}


def _raw(spark, **changes):
    base = dict(id="a", seq=1, subject_id="s", predicate_id="p", value_literal="1",
                value_ref=None, valid_from=day("2026-01-01"), recorded_at=day("2026-01-01"),
                revokes=None, intent_id="i", source="imported", confidence=None, authority=None,
                ontology_version="v1", subject_key_id=None)
    row = {**base, **changes}
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ASSERTION)
    return spark.createDataFrame([tuple(row[f.name] for f in ASSERTION)], schema)


@pytest.mark.parametrize("changes,error", [
    ({}, None), ({"confidence": "low"}, None),
    ({"value_literal": None, "value_ref": "e"}, None),
    ({"value_literal": None, "revokes": "b"}, None),
    ({"value_literal": None}, "value_exactly_one"),
    ({"value_ref": "e"}, "value_exactly_one"),
    ({"value_ref": "e", "revokes": "b"}, "value_exactly_one"),
    ({"confidence": "sure"}, "confidence_levels"), ({"source": "rumour"}, "source_known"),
    ({"subject_id": None}, "not_null"), ({"valid_from": None}, "not_null"),
])
def test_constraints(spark, changes, error):
    good, bad = ingest.split_valid(ingest.constraint_errors(_raw(spark, **changes)))
    assert [r.error for r in bad.collect()] == ([error] if error else [])
    assert good.count() == (0 if error else 1)


def test_facts(spark):
    facts = spark.createDataFrame(
        [("s", "p", "1", None), ("s", "p", None, None), ("s", "q", "1", None),
         ("s", "p", "1", "sure"), (None, "p", "1", None), ("s", "r", "e", "high")],
        "subject string, predicate string, value string, confidence string")
    slots = spark.createDataFrame([("p", False), ("r", True)], "predicate string, is_ref boolean")
    got = [(r.subject, r.predicate, r.error, r.is_ref)
           for r in ingest.fact_errors(facts, slots).collect()]
    assert sorted(got, key=str) == sorted(
        [("s", "p", None, False), ("s", "p", "no_value", False),
         ("s", "q", "unknown_predicate", None), ("s", "p", "bad_confidence", False),
         (None, "p", "missing_key", False), ("s", "r", None, True)], key=str)


def test_updates_and_deletes_show(claims):
    rows = [("a", "x", "1", "2026-01-01", "2026-01-01", None),
            ("b", "x", "2", "2026-01-01", "2026-01-01", None)]
    before = claims(rows)
    more = claims([*rows, ("c", "x", "3", "2026-01-01", "2026-01-01", None)])
    changed = claims([rows[0], ("b", "x", "9", "2026-01-01", "2026-01-01", None)])

    def failed(current):
        return ingest.append_only_summary(before, current).first().failed

    assert failed(more) == 0
    assert failed(changed) == 1
    assert failed(before.limit(0)) == 2


def test_register_once(spark):
    said = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "uri string")
    known = spark.createDataFrame([("b",)], "uri string")
    first = ingest.register_uris(said, known)
    assert sorted(r.uri for r in first.collect()) == ["a", "c"]
    assert ingest.register_uris(said, known.unionByName(first.select("uri"))).count() == 0


def test_batch_defaults_and_dense_seq(spark):
    batch = spark.range(1000).select(
        (F.col("id") * 7).alias("batch_order"), F.lit("s").alias("subject_id"),
        F.lit("p").alias("predicate_id"), F.col("id").cast("string").alias("value_literal"),
        F.when(F.col("id") == 3, F.lit("2020-01-01").cast("timestamp_ntz")).alias("valid_from"))
    made = ingest.append_batch(batch, intent_id="i", occurred_at="2026-01-01T09:00",
                               recorded_at="2026-01-02T09:00", last_seq=50)
    got = {r.value_literal: r for r in made.collect()}
    assert [got[str(n)].seq for n in range(1000)] == list(range(51, 1051))
    assert got["3"].valid_from == day("2020-01-01")
    assert got["4"].valid_from == day("2026-01-01T09:00")
    assert made.columns == ASSERTION.fieldNames()
    assert ingest.constraint_errors(made).where("error IS NOT NULL").count() == 0


def test_positions_in_a_hot_group(spark):
    df = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string"))
        .alias("k"), ((F.col("id") * 7919) % 9000).alias("v"), "id")
    got = ranking.position(df, ["k"], ["v", "id"], pieces=16)
    assert "k" in got.columns and "_piece" not in got.columns
    by_key = {}
    for r in got.collect():
        by_key.setdefault(r.k, []).append((r.v, r.id, r.position))
    for held in by_key.values():
        assert [p for *_, p in sorted(held)] == list(range(1, len(held) + 1))
    # Most of the order column one value: the next column cuts it.
    flat = df.withColumn("v", F.when(F.col("id") % 4 == 0, F.col("v")).otherwise(5))
    sizes = (ranking.with_piece(flat, ["v", "id"], 16).groupBy("_piece").count()
             .agg(F.max("count")).first()[0])
    assert sizes < 1500
    crowded = {}
    for r in ranking.position(flat, ["k"], ["v", "id"], pieces=16).collect():
        crowded.setdefault(r.k, []).append((r.v, r.id, r.position))
    for held in crowded.values():
        assert [p for *_, p in sorted(held)] == list(range(1, len(held) + 1))
    tops = ranking.running_max_before(df, ["k"], ["id"], "v", "m", pieces=16)
    seen = {}
    for r in tops.orderBy("id").collect():
        assert r.m == seen.get(r.k)
        seen[r.k] = max(seen.get(r.k, -1), r.v)


def test_append_twice_adds_nothing(claims, spark, tmp_path):
    log = claims([("a", "x", "1", "2026-01-01", "2026-01-01", None),
                  ("b", "y", "2", "2026-01-01", "2026-01-01", None)])
    path = str(tmp_path / "log")
    append_claims(log, path)
    append_claims(log, path, known_ids=read_claims(spark, path))
    assert read_claims(spark, path).count() == 2
    more = claims([("a", "x", "1", "2026-01-01", "2026-01-01", None)] * 3)
    append_claims(more, path, known_ids=read_claims(spark, path))
    assert read_claims(spark, path).count() == 3


def test_registry_and_stated(spark, tmp_path):
    rows = [("r1", 1, "E", "E", "sys:uri", None, None), ("r2", 2, "S", "E", "thing", None, None),
            ("r3", 3, "S", "E", "thing-again", None, None), ("r4", 4, "P", "E", "slot", None, None),
            ("r5", 5, "O", "E", "other", None, None), ("f1", 6, "S", "P", None, "O", None),
            ("f2", 7, "O", "P", "lit", None, None), ("f3", 8, "O", "P", None, None, "f2")]
    full = [(i, s, a, p, v, r, day("2026-01-01"), day("2026-01-01"), rev, "i", "imported", None,
             None, "v1", None) for i, s, a, p, v, r, rev in rows]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ASSERTION)
    path = str(tmp_path / "assertions")
    spark.createDataFrame(full, schema).write.parquet(path)
    log = read_log(spark, path, "assertion")
    assert {(r.entity_id, r.uri) for r in registry(log, "sys:uri").collect()} == {
        ("E", "sys:uri"), ("S", "thing"), ("P", "slot"), ("O", "other")}
    for slots in (["slot"], None):
        got = {(r.subject, r.slot, r.value)
               for r in stated(log, "sys:uri", "2026-02-01", "2026-02-01", slots).collect()
               if r.slot == "slot"}
        assert got == {("thing", "slot", "other")}


def test_ids_survive_a_retry_after_other_appends(spark):
    batch = spark.range(5).select(F.col("id").alias("batch_order"), F.lit("s").alias("subject_id"),
                                  F.lit("p").alias("predicate_id"), F.lit("v").alias("value_literal"))
    first, again = (ingest.append_batch(batch, intent_id="i", occurred_at="2026-01-01",
                                        last_seq=n) for n in (0, 90))
    assert {r.id for r in first.collect()} == {r.id for r in again.collect()}
    intent, entities, rows = ingest.append_act(batch, intent_id="i", actor_id="a",
                                               action_name="x", occurred_at="2026-01-01")
    assert (intent.count(), entities.count(), rows.count()) == (1, 1, 5)


def test_pieces_of_any_orderable_type(spark):
    from twoclock.operators.ranking import position, with_piece
    df = spark.range(4000).select(
        F.col("id"), F.md5(F.col("id").cast("string")).alias("text"),
        (F.rand(3) * 10 - 5).alias("real"), (F.rand(4) * 100).cast("decimal(12,6)").alias("exact"),
        F.date_add(F.lit("2020-01-01"), F.col("id").cast("int") % 900).alias("date"))
    for column in ("text", "real", "exact", "date"):
        assert with_piece(df, [column], 8).select("_piece").distinct().count() >= 8
        got = position(df, [], [column, "id"], pieces=8).orderBy("position").collect()
        assert [r.position for r in got] == list(range(1, 4001))
        assert [(r[column], r.id) for r in got] == sorted((r[column], r.id) for r in got)


def test_correct_by_id(claims, spark):
    log = claims([("s", "p", "1", "2026-01-01", "2026-01-02", None)])
    fixes = spark.createDataFrame([("c0", "2", None, "r"), ("c9", "2", None, "r")],
                                  "claim_id string, value string, valid_from timestamp_ntz, reason string")
    made, rejects = ingest.correct_by_id(fixes, log, recorded_at="2026-02-01")
    row = made.collect()[0]
    assert (row.subject, row.slot, row.value, row.revokes) == ("s", "p", "2", "c0")
    assert row.valid_from == day("2026-01-01")
    assert [r.claim_id for r in rejects.collect()] == ["c9"]


def test_a_million_uris_under_one_prefix_use_all_ranges(spark):
    """Texts that differ after 35 characters alone, short and missing ones among them."""
    n = F.col("id")
    uris = spark.range(1_000_000).select(
        F.when(n % 1000 == 1, F.lit(None)).when(n % 1000 == 2, F.substring(n.cast("string"), 1, 3))
        .otherwise(F.concat(F.lit("https://example.org/a/long/path/to/"), F.sha1(n.cast("string"))))
        .alias("uri"), "id")
    sizes = [r["count"] for r in ranking.with_piece(uris, ["uri", "id"], 16)
             .groupBy("_piece").count().collect()]
    assert len(sizes) == 16 and sum(sizes) == 1_000_000 and max(sizes) < 1.5 * 1_000_000 / 16
    numbered = ranking.position(uris, [], ["uri", "id"], pieces=16)
    assert numbered.agg(F.countDistinct("position"), F.min("position"), F.max("position")) \
        .head()[:] == (1_000_000, 1, 1_000_000)
    small = numbered.where("id % 5000 < 3").orderBy("position").select("uri", "id").collect()
    assert small == sorted(small, key=lambda r: (r["uri"] is not None, r["uri"] or "", r["id"]))


def test_a_correction_act_is_whole_rows(spark):
    from conftest import day
    from twoclock.operators.ingest import correction_act
    known = spark.createDataFrame(
        [("a", "s", "p", "old", None, day("2026-01-01")), ("b", "s", "q", None, "ref", day("2026-01-02")),
         ("c", "t", "p", "gone", None, day("2026-01-03"))],
        "id string, subject_id string, predicate_id string, value_literal string, value_ref string, "
        "valid_from timestamp_ntz")
    fixes = spark.createDataFrame(
        [("b", "other", None), ("a", "new", day("2026-02-01")), ("c", None, None), ("z", "x", None),
         ("a", "newer", None)], "claim_id string, value string, valid_from timestamp_ntz")
    intent, rows, rejects = correction_act(
        fixes, known, intent_id="i", actor_id="me", occurred_at="2026-03-01 10:00:00",
        recorded_at="2026-03-01 11:00:00", last_seq=7, reason_code="typo")
    assert [(r["id"], r["action_name"], r["reason_code"]) for r in intent.collect()] == [
        ("i", "correct", "typo")]
    got = {r["revokes"]: (r["seq"], r["subject_id"], r["predicate_id"], r["value_literal"],
                          r["value_ref"], str(r["valid_from"]), r["intent_id"], r["source"])
           for r in rows.collect()}
    assert got == {"a": (8, "s", "p", "new", None, "2026-02-01 00:00:00", "i", "imported"),
                   "b": (9, "s", "q", None, "other", "2026-01-02 00:00:00", "i", "imported"),
                   "c": (10, "t", "p", None, None, "2026-01-03 00:00:00", "i", "imported")}
    assert sorted((r["claim_id"], r["value"]) for r in rejects.collect()) == [("a", "newer"), ("z", "x")]

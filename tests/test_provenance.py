from pyspark.sql import functions as F

from conftest import day
from twoclock.operators import provenance
from test_resolve import BASE, EXTRA


def _log(claims):
    return claims([*BASE, EXTRA["retracted"]]).withColumn("intent_id", F.concat(F.lit("i"), "seq"))


def _intents(spark, n=8):
    return spark.createDataFrame(
        [(f"i{k}", day("2026-01-01"), "ada" if k % 2 else "ben", f"submit_{k % 3}", None)
         for k in range(1, n + 1)],
        "id string, occurred_at timestamp_ntz, actor_id string, action_name string, note string")


def test_history_hides_nothing(claims, spark):
    pairs = spark.createDataFrame([("student", "fee")], "subject string, slot string")
    rows = provenance.oldest_first(
        provenance.history(_log(claims), _intents(spark), pairs)).collect()
    assert [r.value for r in rows] == ["5000000", "5500000", None, "6000000"]
    assert [r.revoked_by for r in rows] == [None, "c3", None, None]
    assert rows[0].actor_id == "ada"
    steps = provenance.steps(_log(claims))
    assert [r.step for r in steps.orderBy("valid_from", "recorded_at", "seq").collect()] == [
        1, 2, 3, 4]
    lost = spark.createDataFrame([("student", "nope")], "subject string, slot string")
    assert [r.uri for r in provenance.unregistered(lost, _log(claims)).collect()] == ["nope"]


def test_revoked_by_within_a_pair(claims, spark):
    log = claims([("a", "x", "1", "2026-01-01", "2026-01-01", None),
                  ("a", "x", "2", "2026-01-01", "2026-01-02", 0),
                  ("a", "x", "3", "2026-01-01", "2026-01-03", 0),
                  ("b", "x", "4", "2026-01-01", "2026-01-04", 0)])
    inside = provenance.with_revoked_by(log, log, within_pair=True)
    assert inside.where("id = 'c0'").first().revoked_by == "c2"
    anywhere = provenance.with_revoked_by(log, log)
    assert anywhere.where("id = 'c0'").first().revoked_by == "c1"


def test_ledger(claims, spark):
    log, acts = _log(claims), _intents(spark)

    def ids(**how):
        return [r.id for r in provenance.recent(log, acts, **how).orderBy(F.col("seq").desc())
                .collect()]

    assert ids(k=2) == ["c3", "c2"] and ids(k=2, offset=1) == ["c2", "c1"]
    assert ids(kind="revocations") == ["c3", "c1"]
    assert ids(actor="ben") == ["c3", "c1"]
    assert ids(search="5500") == ["c1"] and ids(search="FEE", k=1) == ["c3"]
    assert ids(kind="g", action_groups={"g": ["submit_1"]}) == ["c3", "c0"]


def test_status_and_targets(claims, spark):
    log = _log(claims)
    status = {r.id: r.status for r in provenance.status(
        provenance.with_revoked_by(log, log)).collect()}
    assert status == {"c0": "active", "c1": "revoked", "c2": "active", "c3": "retraction"}
    kinds = {r.id: r.event for r in provenance.event_kind(log).collect()}
    assert kinds == {"c0": "state", "c1": "correct", "c2": "change", "c3": "retract"}
    assert provenance.correction_target(log).first().target == "c2"
    chosen = spark.createDataFrame([("c0",)], "id string")
    assert provenance.correction_target(log, chosen=chosen).first().target == "c0"
    gone = claims([("a", "x", "1", "2026-01-01", "2026-01-01", None),
                   ("a", "x", None, "2026-01-01", "2026-01-02", 0)])
    assert provenance.correction_target(gone).first().target == "c1"


def test_window_and_actors(claims, spark):
    got = provenance.log_window(_log(claims), _intents(spark)).first()
    assert (got.assertions, got.revocations, got.intents) == (4, 1, 8)
    assert got.first_valid_from == day("2026-01-01") and got.last_recorded_at == day("2026-03-10")
    people = spark.createDataFrame([("p1", "Ada Brown"), ("p2", "Eve Green")],
                                   "entity_uri string, label string")
    assert {(r.actor, r.label) for r in provenance.known_actors(_intents(spark), people)
            .collect()} == {("ada", "Ada Brown"), ("ben", None), ("eve", "Eve Green")}


def test_the_newest_rows_are_picked_before_any_join(spark, claims):
    log = claims([("s", "p", str(n), "2026-01-01", "2026-01-02", n - 1 if n % 3 == 0 and n else None)
                  for n in range(30)]).withColumn("intent_id", F.col("id"))
    acts = log.select("id", F.lit("a").alias("actor_id"), F.lit("x").alias("action_name"),
                      F.col("recorded_at").alias("occurred_at"), F.lit(None).cast("string").alias("note"),
                      F.lit("bot").alias("agent_id"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = provenance.recent(log, acts, k=5, offset=2)
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "TakeOrdered" in plan and "LeftSemi, BuildRight" in plan
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.seq for r in rows) == [24, 25, 26, 27, 28]
    assert {r.seq: r.revoked_by for r in rows}[27] == "c27"
    assert {r.agent_id for r in rows} == {"bot"}


def test_a_strict_history_refuses_unknown_uris(claims, spark):
    import pytest
    from twoclock.operators import provenance
    log = claims([("s", "p", "v", "2026-01-01", "2026-01-01", None)])
    intents = spark.createDataFrame([], "id string, occurred_at timestamp_ntz, actor_id string, "
                                    "agent_id string, action_name string, reason_code string, note string")
    log = log.withColumn("intent_id", log["id"])
    pairs = spark.createDataFrame([("s", "p"), ("nobody", "p")], "subject string, slot string")
    assert provenance.history(log, intents, pairs).count() == 0
    with pytest.raises(provenance.UnknownURI, match="nobody"):
        provenance.history(log, intents, pairs, strict=True)
    provenance.history(log, intents, pairs.where("subject = 's'"), strict=True)

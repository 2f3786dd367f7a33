import random

from conftest import CLAIM, day
from twoclock.operators.resolve import standing
from twoclock.streaming.runnerups import RunnerUps, follow

AT = "2026-01-08"


def ids(df):
    return sorted((r["subject"], r["slot"], r["id"], r["value"]) for r in df.collect())


def test_state_follows_every_batch(claims, spark, tmp_path):
    """Batches in any order: revocations come before and after what they revoke."""
    rng = random.Random(7)
    days = [f"2026-01-{d:02d}" for d in range(1, 13)]
    rows = []
    for n in range(60):
        revokes = rng.randrange(60) if rng.random() < 0.4 else None
        value = None if revokes is not None and rng.random() < 0.5 else f"v{n}"
        rows.append((rng.choice("stu"), rng.choice("xy"), value, rng.choice(days),
                     rng.choice(days), revokes))
    log = claims(rows).cache()
    order = rng.sample(range(1, 61), 60)
    state = RunnerUps(spark, str(tmp_path / "state"), AT, AT, buckets=5)
    assert state.standing().count() == 0
    for n in range(0, 60, 20):
        state.take(log.where(f"seq in ({','.join(map(str, order[n:n + 20]))})"))
        so_far = log.where(f"seq in ({','.join(map(str, order[:n + 20]))})")
        assert ids(state.standing()) == ids(standing(so_far, AT, AT))
    # The last batch again changes nothing; neither does an empty one.
    state.take(log.where(f"seq in ({','.join(map(str, order[40:]))})"))
    state.take(log.limit(0))
    assert ids(state.standing()) == ids(standing(log, AT, AT))
    places = state.held().groupBy("subject", "slot").count().collect()
    assert max(r["count"] for r in places) > 1


def test_a_revocation_brings_back_the_earlier_winner(spark, tmp_path):
    """By a stream, of which the state alone remembers what came before."""
    def write(n, rows):
        spark.createDataFrame([(i, k, s, "p", v, day(vf), day(vf), r) for i, k, s, v, vf, r in rows],
                              CLAIM).coalesce(1).write.parquet(f"{tmp_path}/log/part={n}")

    write(0, [("a", 1, "s", "old", "2026-01-01", None), ("b", 2, "s", "new", "2026-01-02", None),
              ("c", 3, "t", "kept", "2026-01-01", None)])
    state = RunnerUps(spark, f"{tmp_path}/state", AT, AT, buckets=3)

    def catch_up():
        stream = spark.readStream.schema(CLAIM).parquet(f"{tmp_path}/log/*")
        follow(stream, state, f"{tmp_path}/checkpoint").awaitTermination(120)
        return {r["subject"]: r["value"] for r in state.standing().collect()}

    assert catch_up() == {"s": "new", "t": "kept"}
    write(1, [("d", 4, "u", None, "2026-01-03", "b"), ("e", 5, "u", None, "2026-01-03", "z")])
    assert catch_up() == {"s": "old", "t": "kept"}
    write(2, [("z", 6, "v", "too late", "2026-01-01", None), ("f", 7, "u", None, "2026-01-04", "a")])
    assert catch_up() == {"t": "kept"}

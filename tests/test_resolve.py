import random
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import CLAIM, day
from twoclock.operators import resolve

BASE = [
    ("student", "fee", "5000000", "2026-01-01", "2026-01-10", None),
    ("student", "fee", "5500000", "2026-01-01", "2026-02-05", None),
    ("student", "fee", "6000000", "2026-03-01", "2026-03-01", None),
]
EXTRA = {
    "fact": ("student", "fee", "4000000", "2025-12-01", "2026-03-10", None),
    "retracted": ("student", "fee", None, "2026-01-01", "2026-03-10", 1),
    "backfilled": ("student", "fee", "5100000", "2026-01-01", "2026-01-20", None),
    "replaced": ("student", "fee", "5700000", "2026-01-01", "2026-03-10", 1),
    "simultaneous": ("student", "fee", "5600000", "2026-01-01", "2026-02-05", None),
    "crowded_subject": ("sibling", "fee", "9900000", "2026-01-01", "2026-02-20", None),
    "crowded_predicate": ("student", "enrolled", "9800000", "2026-01-01", "2026-02-25", None),
}


@pytest.mark.parametrize("fixture,valid_at,as_of,expected", [
    ("fact", "2026-01-15T00:00", "2026-03-20T00:00", "5500000"),
    ("fact", "2026-01-15T00:00", "2026-01-20T00:00", "5000000"),
    ("fact", "2026-01-15T00:00", "2026-02-10T00:00", "5500000"),
    ("fact", "2026-03-15T00:00", "2026-03-20T00:00", "6000000"),
    ("fact", "2026-01-15T00:00", "2026-01-05T00:00", None),
    ("retracted", "2026-01-15T00:00", "2026-03-20T00:00", "5000000"),
    ("retracted", "2026-01-15T00:00", "2026-03-01T00:00", "5500000"),
    ("backfilled", "2026-01-15T00:00", "2026-03-20T00:00", "5500000"),
    ("replaced", "2026-01-15T00:00", "2026-03-20T00:00", "5700000"),
    ("simultaneous", "2026-01-15T00:00", "2026-03-20T00:00", "5600000"),
    ("crowded_subject", "2026-01-15T00:00", "2026-03-20T00:00", "5500000"),
    ("crowded_predicate", "2026-01-15T00:00", "2026-03-20T00:00", "5500000"),
])
def test_point_reads(claims, fixture, valid_at, as_of, expected):
    log = claims([*BASE, EXTRA[fixture]])
    got = [r["value"] for r in
           resolve.resolve_point(log, "student", "fee", valid_at, as_of).collect()]
    assert got == ([] if expected is None else [expected])
    for path in (resolve.standing, resolve.standing_by_aggregate):
        whole = {(r["subject"], r["slot"]): r["value"]
                 for r in path(log, valid_at, as_of).collect()}
        assert whole.get(("student", "fee")) == expected


def _mutant(log, order, where="TRUE"):
    seen = log.where(resolve.visible(log, "2026-01-15T00:00", "2026-03-20T00:00")
                     & (F.col("subject") == "student") & F.expr(where))
    return seen.orderBy(*[F.col(c).desc() for c in order]).first()["value"]


def test_the_fixtures_catch_wrong_rules(claims):
    """Each neighbouring rule gives another answer on the log made to catch it."""
    fact, late, swapped = (claims([*BASE, EXTRA[f]]) for f in
                           ("fact", "backfilled", "replaced"))
    assert _mutant(fact, ["recorded_at", "seq"]) == "4000000"
    assert _mutant(late, ["valid_from", "seq"], "value IS NOT NULL") == "5100000"
    not_revoked = swapped.join(resolve.revoked_ids(swapped, "2026-03-20"), "id", "left_anti")
    assert _mutant(not_revoked, ["valid_from", "recorded_at", "seq"],
                   "revokes IS NULL") == "5000000"


def test_revocation_crosses_pairs_and_is_not_transitive(claims):
    log = claims([
        ("a", "x", "1", "2026-01-01", "2026-01-01", None),
        ("b", "y", "2", "2026-01-01", "2026-01-02", 0),     # revokes a.x
        ("c", "z", "3", "2026-01-01", "2026-01-03", 1),     # revokes the revoker
    ])
    assert {(r["subject"], r["value"]) for r in
            resolve.standing(log, "2026-02-01", "2026-02-01").collect()} == {("c", "3")}
    assert {(r["subject"], r["value"]) for r in
            resolve.standing(log, "2026-02-01", "2026-01-01").collect()} == {("a", "1")}


moment = st.integers(0, 20)
row = st.tuples(st.sampled_from("ab"), st.sampled_from("xy"),
                st.one_of(st.none(), st.sampled_from("123")), moment, moment,
                st.one_of(st.none(), st.integers(0, 30)))


def _log(spark, rows):
    start = datetime(2026, 1, 1)
    out = []
    for n, (s, p, v, vf, ra, rev) in enumerate(rows):
        rev = f"c{rev % n}" if rev is not None and n else None
        out.append((f"c{n}", n, s, p, v, start + timedelta(vf), start + timedelta(ra), rev))
    return spark.createDataFrame(out, CLAIM), out, start


def _brute(rows, va, ao):
    revoked = {r[7] for r in rows if r[7] and r[6] <= ao}
    best = {}
    for r in rows:
        if r[4] is None or r[5] > va or r[6] > ao or r[0] in revoked:
            continue
        rank = (r[5], r[6], r[1])
        if rank > best.get(r[2:4], ((datetime.min,) * 2 + (-1,), None))[0]:
            best[r[2:4]] = (rank, r[4])
    return {k: v[1] for k, v in best.items()}


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(row, min_size=1, max_size=25), moment, moment)
def test_against_brute_force_and_prefix(spark, rows, va, ao):
    log, plain, start = _log(spark, rows)
    valid_at, as_of = start + timedelta(va), start + timedelta(ao)
    expected = _brute(plain, valid_at, as_of)

    def read(df):
        return {(r["subject"], r["slot"]): r["value"] for r in df.collect()}

    assert read(resolve.standing(log, valid_at, as_of)) == expected
    assert read(resolve.standing_by_aggregate(log, valid_at, as_of)) == expected
    # What was recorded later changes nothing.
    known = log.where(F.col("recorded_at") <= F.lit(as_of).cast("timestamp_ntz"))
    assert read(resolve.standing(known, valid_at, as_of)) == expected
    grid = resolve.clock_grid(log, [(valid_at, as_of), (start, start)])
    here = grid.where((F.col("valid_at") == F.lit(valid_at).cast("timestamp_ntz"))
                      & (F.col("as_of") == F.lit(as_of).cast("timestamp_ntz")))
    if (va, ao) != (0, 0):
        assert read(here) == expected
    wide = resolve.standing_wide(log, {"x": "x", "y": "y"}, valid_at, as_of)
    cells = {(r["subject"], c): r[c] for r in wide.collect() for c in "xy" if r[c]}
    assert cells == expected


def _random_log(rng, size):
    at = [f"2026-01-{1 + k:02d}" for k in range(12)]
    rows = []
    for n in range(size):
        revokes = rng.randrange(size) if rng.random() < 0.4 else None
        value = None if revokes is not None and rng.random() < 0.5 else f"v{n}"
        rows.append((rng.choice("st"), rng.choice("xyz"), value, rng.choice(at), rng.choice(at),
                     revokes))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_grid_and_index_match_point_reads(claims, seed, spark, tmp_path):
    from twoclock.sources import revocations_of
    rng = random.Random(seed)
    log = claims(_random_log(rng, 70))
    index = revocations_of(log).cache()
    clocks = [(f"2026-01-{rng.randrange(1, 13):02d}T00:00", f"2026-01-{rng.randrange(1, 13):02d}T00:00")
              for _ in range(7)]
    clocks.append(clocks[0])
    grid = resolve.clock_grid(log, clocks)
    assert grid.columns == [*log.columns, "valid_at", "as_of"]
    got, again = ({(str(r["valid_at"]), str(r["as_of"]), r["subject"], r["slot"]): r["id"]
                   for r in g.collect()}
                  for g in (grid, resolve.clock_grid(log, clocks, revocations=index)))
    want = {}
    for va, ao in set(clocks):
        for by_index in (None, index):
            won = {(str(day(va)), str(day(ao)), r["subject"], r["slot"]): r["id"]
                   for r in resolve.standing(log, va, ao, revocations=by_index).collect()}
            assert by_index is None or all(want[k] == v for k, v in won.items())
            want.update(won)
    assert got == again == want and grid.count() == len(want)
    pairs = log.where("subject = 's'").select("subject")
    va, ao = clocks[0]
    for slot in "xyz":
        for by_index in (None, index):
            point = resolve.resolve_point(log, "s", slot, va, ao, by_index).collect()
            assert [r["id"] for r in point] == [v for k, v in want.items() if k == (
                str(day(va)), str(day(ao)), "s", slot)]
    subset = [sorted(r["id"] for r in resolve.standing_of(log, pairs, va, ao, i).collect())
              for i in (None, index)]
    assert subset[0] == subset[1]
    assert resolve.clock_grid(log, []).count() == 0


def test_grid_makes_no_row_for_a_claim_and_a_clock(spark):
    """A long history of one pair meets many clocks as its few rectangles."""
    at = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    log = spark.range(20_000).select(
        F.col("id").cast("string").alias("id"), F.col("id").alias("seq"),
        F.lit("s").alias("subject"), F.lit("p").alias("slot"), F.col("id").cast("string").alias("value"),
        *[(at + F.make_dt_interval(mins=F.col("id").cast("int"))).alias(c)
          for c in ("valid_from", "recorded_at")], F.lit(None).cast("string").alias("revokes"))
    clocks = [(f"2026-01-{d:02d}T00:00", f"2026-01-{e:02d}T00:00")
              for d in range(2, 12) for e in range(2, 12)]
    grid = resolve.clock_grid(log, clocks)
    assert grid.count() == 100
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode") == plan.count("WindowGroupLimit") / 2 == 1


def test_a_point_reads_the_revocations_of_its_pair_alone(spark, claims, tmp_path):
    from twoclock.sources import append_claims, append_indexed, read_claims, read_revocations
    rows = [(f"s{k}", slot, f"v{k}", "2026-01-01", "2026-01-02", None)
            for k in range(40) for slot in ("a", "b")]
    rows += [(f"s{k}", "a", None, "2026-01-01", f"2026-01-{3 + k % 9:02d}", 2 * k) for k in range(40)]
    whole = claims(rows)
    log_path, index_path = f"{tmp_path}/log", f"{tmp_path}/index"
    first = whole.where("seq <= 30 or seq > 85")
    append_claims(first, log_path)
    from twoclock.sources import write_revocations
    write_revocations(first, index_path)
    waiting = read_revocations(spark, index_path).where("slot is null").count()
    assert waiting > 0
    for _ in range(2):
        append_indexed(whole.where("seq > 30 and seq <= 85"), log_path, index_path)
    log, index = read_claims(spark, log_path), read_revocations(spark, index_path)
    assert log.count() == len(rows)
    for ao in ("2026-01-02", "2026-01-06T00:00", "2026-02-01"):
        plain = resolve.standing(log, "2026-02-01", ao)
        by_index = resolve.standing(log, "2026-02-01", ao, revocations=index)
        assert sorted(plain.collect()) == sorted(by_index.select(*plain.columns).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        point = resolve.resolve_point(log, "s7", "a", "2026-02-01", "2026-02-01", index)
        scans = [line for line in point._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
                 .splitlines() if "FileScan" in line]
        assert len(scans) == 2
        for scan in scans:
            assert "EqualTo(subject,s7)" in scan.replace("IsNotNull", "") and "= a)" in scan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_hot_pair_is_cut_down_before_the_shuffle(spark):
    """A third of the log under one pair: each map task sends one of its rows."""
    log = spark.range(30_000).select(
        F.col("id").cast("string").alias("id"), F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), "id"))
        .alias("subject"), F.lit("p").alias("slot"), F.col("id").cast("string").alias("value"),
        F.lit("2026-01-01").cast("timestamp_ntz").alias("valid_from"),
        F.lit("2026-01-01").cast("timestamp_ntz").alias("recorded_at"),
        F.lit(None).cast("string").alias("revokes"))
    won = resolve.standing(log, "2026-02-01", "2026-02-01")
    assert won.count() == 20_001
    assert won.where("subject = 'hot'").first()["value"] == "29997"
    plan = won._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_versions(spark):
    from twoclock.operators.resolve import version_as_of

    def version(n, vf, sealed):
        return {"ordinal": n, "version": f"v{n}", "valid_from": day(vf),
                "sealed_at": day(sealed), "supersedes": None}

    chain = [version(1, "2026-01-01", "2026-01-01T09:00"),
             version(2, "2026-02-01", "2026-02-01T09:00")]
    retro = [version(1, "2026-01-01", "2026-01-01T09:00"),
             version(2, "2026-01-01", "2026-03-01T09:00")]
    reseal = [*chain, version(3, "2026-01-01", "2026-03-01T09:00")]
    for versions, va, ao, expected in [
            (chain, "2026-03-01", "2026-01-15", "v1"), (chain, "2026-03-01", "2026-04-01", "v2"),
            (reseal, "2026-04-01", "2026-04-01", "v3"), (retro, "2026-01-15", "2026-04-01", "v2"),
            (retro, "2026-01-15", "2026-02-01", "v1"), (chain, "2026-03-01", "2025-12-01", None),
            (chain, "2025-12-01", "2026-04-01", None), ([], "2026-01-01", "2026-01-01", None)]:
        rows = spark.createDataFrame([(day(va), day(ao))], "va timestamp_ntz, ao timestamp_ntz")
        assert version_as_of(rows, versions, "va", "ao").first()["version"] == expected


def plain_version(versions, va, ao):
    held = [(v[3], v[0], v[1]) for v in versions if v[3] <= ao and v[2] <= va]
    return max(held)[2] if held else None


@pytest.mark.parametrize("count,fanout", [(1, 2), (37, 2), (300, 64)])
def test_version_tree_matches_brute_force(spark, count, fanout):
    from twoclock.operators.versions import VersionTree, version_as_of
    rng = random.Random(count * fanout)
    at = day("2020-01-01")
    versions = [(n, f"v{n}", at + timedelta(days=rng.randrange(40)),
                 at + timedelta(days=rng.randrange(30))) for n in range(count)]
    dim = spark.createDataFrame(versions, "ordinal int, version string, "
                                "valid_from timestamp_ntz, sealed_at timestamp_ntz")
    tree = VersionTree(dim, fanout)
    rows = [(n, at + timedelta(days=rng.randrange(-1, 42)), at + timedelta(days=rng.randrange(-1, 32)))
            for n in range(200)] + [(900, None, at), (901, at, None)]
    frame = spark.createDataFrame(rows, "n int, va timestamp_ntz, ao timestamp_ntz")
    got = {r["n"]: r["version"] for r in tree.choose(frame, "va", "ao").collect()}
    assert got == {n: plain_version(versions, va, ao) if va and ao else None
                   for n, va, ao in rows}
    newest = max((v[3], v[0], v[1]) for v in versions)[2]
    got = {r["n"]: r["version"] for r in version_as_of(frame, tree, "va", "ao", True).collect()}
    assert got[900] == got[901] == newest


def test_each_pair_of_clocks_goes_down_the_version_tree_once(spark, monkeypatch):
    from twoclock.operators.versions import VersionTree
    at = day("2020-01-01")
    versions = [(n, f"v{n}", at + timedelta(days=n % 7), at + timedelta(days=n % 5))
                for n in range(40)]
    tree = VersionTree(spark.createDataFrame(
        versions, "ordinal int, version string, valid_from timestamp_ntz, "
                  "sealed_at timestamp_ntz"), 4)
    down, sent = VersionTree._down, []
    monkeypatch.setattr(VersionTree, "_down",
                        lambda self, rows: sent.append(rows) or down(self, rows))
    rows = [(n, at + timedelta(days=n % 3), at + timedelta(days=n % 2) if n % 50 else None)
            for n in range(600)]
    frame = spark.createDataFrame(rows, "n int, va timestamp_ntz, ao timestamp_ntz")
    got = {r["n"]: r["version"] for r in tree.choose(frame, "va", "ao").collect()}
    assert got == {n: plain_version(versions, va, ao) if ao else None for n, va, ao in rows}
    assert [clocks.count() for clocks in sent] == [6]


def test_a_hundred_thousand_versions(spark):
    from twoclock.operators.versions import VersionTree
    day0 = F.lit("1990-01-01 00:00:00").cast("timestamp_ntz")
    minutes = [F.pmod(F.col("id") * k, F.lit(m)).cast("int") for k, m in ((7919, 99991), (104729, 99989))]
    dim = spark.range(100_000).select(
        F.col("id").alias("ordinal"), F.col("id").cast("string").alias("version"),
        (day0 + F.make_dt_interval(mins=minutes[0])).alias("valid_from"),
        (day0 + F.make_dt_interval(mins=minutes[1])).alias("sealed_at"))
    tree = VersionTree(dim)
    assert len(tree.levels) == 3 and tree.levels[2].count() == 1
    rows = spark.range(400).select("id", *[
        (day0 + F.make_dt_interval(mins=F.pmod(F.col("id") * k, F.lit(100_000)).cast("int"))).alias(c)
        for k, c in ((31337, "va"), (271, "ao"))])
    held = [(k * 104729 % 99989, k, k * 7919 % 99991) for k in range(100_000)]
    found = tree.choose(rows, "va", "ao")
    for r in found.where("id % 10 = 3").collect():
        va, ao = r["id"] * 31337 % 100_000, r["id"] * 271 % 100_000
        best = max(((s, k) for s, k, v in held if s <= ao and v <= va), default=None)
        assert r["version"] == (str(best[1]) if best else None)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_version_rows_must_be_whole(spark):
    from twoclock.sources import load_versions
    dim = spark.createDataFrame(
        [(1, "v1", day("2026-01-01"), None, None)],
        "ordinal int, version string, valid_from timestamp_ntz, sealed_at timestamp_ntz, "
        "supersedes string")
    with pytest.raises(ValueError, match="sealed_at"):
        load_versions(dim)


def test_clocks():
    from twoclock.functions.clocks import ClockError, instant
    assert instant("2026-06-16") == datetime(2026, 6, 16, 23, 59, 59, 999999)
    assert instant("2026-06-16T00:00:00+02:00") == datetime(2026, 6, 15, 22)
    assert abs(instant(None) - instant("")) < timedelta(seconds=5)
    with pytest.raises(ClockError):
        instant("yesterday")



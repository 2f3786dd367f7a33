import random

from pyspark.sql import functions as F

from conftest import day
from twoclock.operators import quality, report


def test_mentions_against_brute_force(spark):
    rng = random.Random(5)
    words = ["ab", "abc", "b", "cab", "é", "x\ny", ""]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(25)]
    texts += ["The Whole Phrase of words here", "a  b"]
    names = {" ".join(rng.choice(words) for _ in range(n)) for n in (1, 2, 3, 4, 5)
             for _ in range(12)} - {""}
    names |= {"hole phrase of wor", "WHOLE PHRASE", "zzz", "ra", "ase of", "  "}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    bodies = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.name for r in quality.unmentioned(df, bodies).collect()}
    assert got == {n for n in names if not any(n.lower() in t.lower() for t in texts)}


def test_balances(spark):
    outputs = spark.createDataFrame([(1, "pan", 2, 1.0), (1, "pan", 1, 0.5), (2, "pan", 3, 1.0)],
                                    "batch int, format string, units int, share double")
    weights = spark.createDataFrame([("pan", 2.0)], "format string, weight double")
    inputs = spark.createDataFrame([(1, 4.0, 1.0), (2, 5.9, None)],
                                   "batch int, input double, allowance double")
    assert [r.batch for r in quality.mass_balance(outputs, weights, inputs).collect()] == [2]
    more = outputs.union(spark.createDataFrame([(3, "tin", 10, 1.0), (4, "pan", 1, 1.0)], outputs.schema))
    more = quality.mass_balance(more, weights, inputs.union(
        spark.createDataFrame([(3, 1.0, None)], inputs.schema))).collect()
    assert {r.batch: r.reason for r in more} == {2: "too much", 3: "no weight", 4: "no input"}
    held = spark.createDataFrame([("a",), ("b",), ("x",)], "key string")
    known = spark.createDataFrame([("a",), ("b",)], "key string")
    stale = quality.stale_exemptions(held, known, known.where("key = 'b'")).collect()
    assert {r.key: r.reason for r in stale} == {"x": "unknown", "b": "used"}
    parts = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0), ("c", 9.0)],
                                  "key string, amount double")
    totals = spark.createDataFrame([("a", 3.004), ("b", 2.0), ("c", 1.0), ("d", 1.0)],
                                   "key string, total double")
    exempt = spark.createDataFrame([("c",)], "key string")
    assert [r.key for r in quality.parts_against_total(parts, totals, exempt).collect()] == ["b"]
    parts = parts.union(spark.createDataFrame([("a", None), ("d", 1.0)], parts.schema))
    off = {r.key: (r.worked, r.reason) for r in quality.parts_against_total(parts, totals).collect()}
    assert off == {"a": (None, "no amount"), "b": (1.0, "differ"), "c": (9.0, "differ")}


def test_rules(spark):
    seen = spark.createDataFrame([("k1", "v", 2.0), ("k2", "v", 1.0), ("k3", "w", 0.0)],
                                 "key string, kind string, amount double")
    floors = spark.createDataFrame([("v", 2.0)], "kind string, floor double")
    assert [r.key for r in quality.below_floor(seen, floors).collect()] == ["k2"]
    days = spark.createDataFrame([("a", "van", day("2026-06-15")), ("b", "van", day("2026-06-16"))],
                                 "key string, kind string, day timestamp_ntz")
    monday = spark.createDataFrame([("van", 2)], "kind string, weekday int")
    assert [r.key for r in quality.off_schedule(days, monday).collect()] == ["b"]
    named = spark.createDataFrame([("Tues", day("2026-06-16")), ("Monday", day("2026-06-16"))],
                                  "n string, d timestamp_ntz")
    assert [r.n for r in quality.wrong_weekday(named, "d", "n").collect()] == ["Monday"]


def test_coverage(spark):
    def names(*held, column="name"):
        return spark.createDataFrame([(h,) for h in held], f"{column} string")

    aliases = spark.createDataFrame([("Sucrose", "Sugar")], "name string, target string")
    got = quality.uncovered(names("Sugar", "Sucrose", "Water", "Dust"), names("Sugar"), aliases,
                            names("Water"))
    assert [r.name for r in got.collect()] == ["Dust"]
    left = quality.orphans(names("a", "b", "c", column="key"), names("a", "a", column="key"),
                           names("b", column="key"))
    assert [r.key for r in left.collect()] == ["c"]


def test_cells(spark):
    df = spark.createDataFrame([(1, "£4.50", "1999"), (2, "—", "old"), (3, "", None)],
                               "k int, price string, year string")
    assert {(r.key, r.missing) for r in quality.incomplete(
        df, "k", {"price": None, "year": r"\b(19|20)\d\d\b"}).collect()} == {
        (2, "price"), (2, "year"), (3, "price"), (3, "year")}
    price = r"^£[\d,]+\.\d\d$"
    assert [r.k for r in quality.outside_vocabulary(df, "price", pattern=price).collect()] == [3]
    texts = spark.createDataFrame([(1, "one\nIt ADDS up to two\nand adds up to works out at 3")],
                                  "d int, text string")
    hits = quality.forbidden_phrases(texts, "d", ["adds up to", r"works out (to|at)\b"])
    assert {(r.line, r.phrase) for r in hits.collect()} == {
        (2, "adds up to"), (3, "adds up to"), (3, r"works out (to|at)\b")}
    tally = quality.summary([("a", df, hits), ("b", df, df.limit(0))]).collect()
    assert {(r["check"], r.counted, r.failed, r.ok) for r in tally} == {
        ("a", 3, 3, False), ("b", 3, 0, True)}


def test_comparisons(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "z")], "k int, p string, q string")
    b = spark.createDataFrame([(1, "x", "n"), (3, "y", "z")], "k int, p string, q string")
    assert {(r.k, r.column) for r in quality.differing_cells(a, b, "k").collect()} == {
        (1, "q"), (2, "p"), (2, "q"), (3, "p"), (3, "q")}
    assert quality.same_rows(a, a).first().failed == 0
    assert quality.same_rows(a, a.unionByName(a)).first().failed == 2
    mixed = a.repartition(3, "p").orderBy(F.desc("k"))
    assert quality.fingerprint(a).first() == quality.fingerprint(mixed).first()
    assert quality.fingerprint(a).first() != quality.fingerprint(b).first()


def test_reports(spark):
    items = spark.createDataFrame(
        [("a", "p", "A", "Dry", 10.0, 5.0, -60.0, -6.0, True, False, None, 4.0),
         ("b", "p", "B", "Dry", 1.0, 9.0, -20.0, -20.0, False, True, 8.0, 3.0),
         ("c", "q", "C", "Cold", 2.0, 0.0, 5.0, 2.5, False, False, None, 1.0)],
        "part string, place string, name string, location string, list_price double, "
        "remaining double, gap_value double, gap double, is_anomaly boolean, "
        "is_reorder boolean, reorder_base double, counted double").withColumn(
        "counted_value", F.col("counted") * F.col("list_price"))
    k = report.kpi_totals(items).first()
    assert (k.valuation, k.remaining_valuation, k.gap_value) == (45.0, 59.0, -75.0)
    assert report.kpi_totals(items.limit(0)).first().accuracy_pct == 100.0
    top = report.top_losses(items).collect()
    assert [r.part for r in top] == ["a", "b"]
    assert [round(r.pct_of_total, 1) for r in top] == [80.0, 26.7]
    assert [round(r.pct_of_max, 1) for r in top] == [100.0, 33.3]
    assert {(r.alert, r.part, r.deficit) for r in report.alerts(items).collect()} == {
        ("anomaly", "a", 6.0), ("reorder", "b", 5.0)}
    assert {(r.location, r["items"]) for r in report.zone_rollup(items).collect()} == {
        ("Dry", 2), ("Cold", 1)}


def test_every_name_length_is_searched(spark):
    names = spark.createDataFrame([("n" * k,) for k in range(1, 1102)], "name string")
    bodies = spark.createDataFrame([(1, "n" * 1101)], "id int, text string")
    assert quality.unmentioned(names, bodies).count() == 0


def test_item_health_in_the_words_of_any_model(spark):
    from twoclock.operators import report
    named = report.Named("title", "shelf", "least", "cost", "shelf_name", "of", "on", "holds",
                         "town", "sku", "site", "due", "seen", "off", "seen_worth", "off_worth")
    items = spark.createDataFrame([("i1", "Nut", "s1", 3.0, 2.0), ("i2", "Bolt", "s2", None, 1.0)],
                                  "entity_uri string, title string, shelf string, least double, cost double")
    shelves = spark.createDataFrame([("s1", "Crate")], "entity_uri string, shelf_name string")
    holds = spark.createDataFrame([("i1", "s1", 10)], "of string, on string, holds int")
    towns = spark.createDataFrame([("p1", "Here")], "entity_uri string, town string")
    balance = spark.createDataFrame(
        [("i1", "p1", 50.0, 20.0, -30.0, 40.0, -60.0, 2.0), ("i2", "p2", 5.0, 5.0, 0.0, 5.0, 0.0, 1.0)],
        "sku string, site string, due double, seen double, off double, seen_worth double, "
        "off_worth double, cost double")
    meta = report.item_metadata(items, shelves, holds, named)
    assert [(r.entity_uri, r.factor, r.shelf_name) for r in meta.orderBy("entity_uri").collect()] == [
        ("i1", 10.0, "Crate"), ("i2", 1.0, None)]
    rows = {r.part: r for r in report.item_health(balance, meta, towns, named).collect()}
    nut, bolt = rows["i1"], rows["i2"]
    assert (nut.name, nut.location, nut.pack_unit, nut.reorder_base, nut.counted_packs) == (
        "Nut", "Here", "Crate", 30.0, 2.0)
    assert nut.is_anomaly and nut.is_reorder and nut.gap_value == -60.0
    assert (bolt.location, bolt.pack_unit, bolt.is_anomaly, bolt.is_reorder) == (
        "p2", "pieces", False, False)


def test_results_are_compared_by_digest_and_those_that_differ_by_row(spark):
    a = spark.range(500).selectExpr("id", "if(id % 7 = 0, null, cast(id as string)) as name")
    same = quality.same_results(a, a.repartition(5), "run")
    assert same.first() == ("run", 500, 0)
    plan = same._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and "name" not in plan
    assert quality.same_results(a, a.unionByName(a.where("id < 3")), "run").first() == (
        "run", 500, 3)
    other = a.withColumn("name", F.when(F.col("id") != 9, F.col("name")))
    assert quality.same_results(a, other, "run", buckets=3).first() == ("run", 500, 2)

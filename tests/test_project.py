from decimal import Decimal

import pytest
from twoclock.functions.expressions import ExpressionError, arithmetic
from twoclock.operators import project
from twoclock.plans import (Aggregate, Convert, EntitySpec, Expression, GroupedSpec, Model,
                            Parameter, SpecError, Unfilled)

SHOP = Model.from_dict({
    "classes": {
        "Held": {"slots": ["g_class", "g_place"]},
        "Tub": {"is_a": "Held", "slots": ["g_tub_name", "g_tub_kilograms", "g_tub_flavour"]},
        "Flavour": {"slots": ["g_class", "g_flavour_name"]},
        "Rumour": {"slots": ["g_class", "g_rumour_text"]},
        "Tally": {"slots": ["g_tally_total"]},
    },
    "slots": {
        "g_class": {"designates_type": True}, "g_place": None,
        "g_tub_name": {"identifier": True}, "g_tub_kilograms": {"range": "decimal"},
        "g_tub_flavour": {"range": "Flavour"}, "g_flavour_name": {"identifier": True},
        "g_rumour_text": None, "g_tally_total": {"range": "decimal"},
    }})
FACTS = [("g_vanilla", "g_class", "Flavour"), ("g_vanilla", "g_flavour_name", "Vanilla"),
         ("g_tub_1", "g_class", "Tub"), ("g_tub_1", "g_tub_name", "Tub 1"),
         ("g_tub_1", "g_tub_kilograms", "4.8"), ("g_tub_1", "g_tub_flavour", "g_vanilla"),
         ("g_tub_1", "g_place", "Display cabinet"), ("g_tub_2", "g_class", "Tub"),
         ("g_tub_2", "g_tub_name", "Tub 2"), ("g_crate", "g_class", "Held"),
         ("g_crate", "g_place", "Dry store")]


def view(claims, facts):
    log = claims([(*f, "2026-01-01", "2026-01-01", None) for f in facts])
    return project.LogView(log, "2026-02-01", "2026-02-01")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()),
                  key=lambda t: tuple(str(x) for x in t))


def test_entity_lists(claims):
    shop = view(claims, FACTS)
    tubs = project.entities(shop, EntitySpec(SHOP, "Tub"))
    assert tubs.columns == ["entity_uri", "g_tub_name", "g_tub_kilograms", "g_tub_flavour",
                            "g_class", "g_place"]
    assert rows(tubs, *tubs.columns) == [
        ("g_tub_1", "Tub 1", Decimal("4.800000"), "g_vanilla", "Tub", "Display cabinet"),
        ("g_tub_2", "Tub 2", None, None, "Tub", None)]
    held = project.entities(shop, EntitySpec(SHOP, "Held"))
    assert rows(held, "entity_uri", "g_class", "g_place") == [
        ("g_crate", "Held", "Dry store"), ("g_tub_1", "Tub", "Display cabinet"),
        ("g_tub_2", "Tub", None)]
    assert project.entities(shop, EntitySpec(SHOP, "Rumour")).count() == 0
    with pytest.raises(SpecError, match="no slot saying"):
        EntitySpec(SHOP, "Tally")


def test_a_malformed_number_is_an_error_unless_asked_otherwise(claims):
    shop = view(claims, [("t", "g_class", "Tub"), ("t", "g_tub_kilograms", "heavy")])
    spec = EntitySpec(SHOP, "Tub")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        project.entities(shop, spec).collect()
    assert project.entities(shop, spec, safe_cast=True).first()["g_tub_kilograms"] is None


MODEL = Model.from_dict({
    "classes": {
        "Item": {"slots": ["kind", "price"]}, "Part": {"is_a": "Item"},
        "Place": {"slots": ["kind"]}, "Inside": {"is_a": "Place"},
        "Move": {"slots": ["kind", "m_item", "m_into", "m_out", "m_qty", "m_unit"]},
        "Count": {"slots": ["kind", "c_item", "c_where", "c_qty", "c_unit"]},
        "Factor": {"slots": ["kind", "f_item", "f_unit", "f_factor"]},
    },
    "slots": {"kind": {"designates_type": True}, "price": {"range": "decimal"},
              "m_item": {"range": "Item"}, "m_into": {"range": "Place"},
              "m_out": {"range": "Place"}, "m_qty": {"range": "decimal"}, "m_unit": None,
              "c_item": {"range": "Item"}, "c_where": {"range": "Place"},
              "c_qty": {"range": "decimal"}, "c_unit": None,
              "f_item": {"range": "Item"}, "f_unit": None, "f_factor": {"range": "decimal"}}})
BY = {"item": "m_item", "place": "m_into"}
CONVERT = Convert("Factor", {"f_item": "m_item", "f_unit": "m_unit"}, "f_factor")


def spec(**columns):
    return GroupedSpec(MODEL, "Stock", {"item": "key", "place": "key", **columns})


def thing(name, kind, **slots):
    return [(name, "kind", kind), *[(name, k, v) for k, v in slots.items()]]


LOG = [
    *thing("nut", "Part", price="2.5"), *thing("bolt", "Item"), *thing("ghost", "Rumour"),
    *thing("shelf", "Inside"), *thing("yard", "Place"),
    *thing("f1", "Factor", f_item="nut", f_unit="box", f_factor="10"),
    *thing("m1", "Move", m_item="nut", m_into="shelf", m_qty="2", m_unit="box"),
    *thing("m2", "Move", m_item="nut", m_into="shelf", m_qty="3", m_unit="each"),
    *thing("m3", "Move", m_item="bolt", m_into="yard", m_out="shelf", m_qty="7", m_unit="box"),
    *thing("m4", "Move", m_item="nut", m_qty="1", m_unit="each"),
    *thing("m5", "Move", m_item="ghost", m_into="shelf", m_qty="99", m_unit="each"),
    *thing("m6", "Move", m_item="bolt", m_into="shelf", m_unit="each"),
    *thing("c1", "Count", c_item="nut", c_where="shelf", c_qty="20", c_unit="each"),
]


def test_grouped_values(claims):
    stock = spec(
        into=Aggregate("Move", "m_qty", BY, convert=CONVERT),
        out=Aggregate("Move", "m_qty", {"item": "m_item", "place": "m_out"}, convert=CONVERT),
        moves=Aggregate("Move", "m_qty", BY, operator="count"),
        price=Parameter("item", "price", "Item"), note=Unfilled("date"),
        net=Expression("{into} - {out}"), worth=Expression("{net} * {price}"))
    got = project.grouped(view(claims, LOG), stock)
    assert got.columns == list(stock.columns)
    assert {(r["item"], r["place"]): (float(r["into"]), float(r["out"]), r["moves"],
                                      r["price"] and float(r["price"]), float(r["net"]),
                                      r["worth"] and float(r["worth"]), r["note"])
            for r in got.collect()} == {
        ("nut", "shelf"): (23.0, 0.0, 2, 2.5, 23.0, 57.5, None),      # 2 boxes of 10, 3 as is
        ("bolt", "yard"): (7.0, 0.0, 1, None, 7.0, None, None),       # no factor, no price
        ("bolt", "shelf"): (0.0, 7.0, 0, None, -7.0, None, None),     # all-NULL sum is 0
        ("nut", None): (1.0, 24.0, 1, 2.5, -23.0, -57.5, None),       # NULL is a key
        ("ghost", "shelf"): (99.0, 0.0, 1, None, 99.0, None, None),
        ("ghost", None): (0.0, 99.0, 0, None, -99.0, None, None),
        ("bolt", None): (0.0, 0.0, 0, None, 0.0, None, None),
    }


def test_scopes_hold_per_aggregate(claims):
    inside = {"m_into": "Inside", "m_item": "Item"}
    mixed = spec(kept=Aggregate("Move", "m_qty", BY, where=inside),
                 every=Aggregate("Move", "m_qty", BY),
                 counted=Aggregate("Count", "c_qty", {"item": "c_item", "place": "c_where"},
                                   where={"c_where": "Inside"}))
    got = {(r["item"], r["place"]): (float(r["kept"]), float(r["every"]), float(r["counted"]))
           for r in project.grouped(view(claims, LOG), mixed).collect()}
    assert got == {("nut", "shelf"): (5.0, 5.0, 20.0), ("bolt", "yard"): (0.0, 7.0, 0.0),
                   ("nut", None): (0.0, 1.0, 0.0), ("ghost", "shelf"): (0.0, 99.0, 0.0),
                   ("bolt", "shelf"): (0.0, 0.0, 0.0)}
    scoped = spec(kept=Aggregate("Move", "m_qty", BY, where=inside))
    assert rows(project.grouped(view(claims, LOG), scoped), "item", "place") == [
        ("bolt", "shelf"), ("nut", "shelf")]


def test_two_factors_for_one_key_count_twice(claims):
    log = [*LOG, *thing("f2", "Factor", f_item="nut", f_unit="box", f_factor="10")]
    stock = spec(into=Aggregate("Move", "m_qty", BY, convert=CONVERT))
    got = {(r["item"], r["place"]): float(r["into"])
           for r in project.grouped(view(claims, log), stock).collect()}
    assert got[("nut", "shelf")] == 43.0


def test_the_same_table_from_a_snapshot(claims, spark, tmp_path):
    from twoclock.sources import refresh_all
    from twoclock.operators.resolve import standing
    stock = spec(into=Aggregate("Move", "m_qty", BY, convert=CONVERT))
    held = view(claims, LOG)
    stated = standing(held.claims, held.valid_at, held.as_of)
    built = refresh_all(stated, [EntitySpec(MODEL, "Item"), stock], str(tmp_path / "s"), "t_")
    assert list(built) == ["p_stock", "p_item"]
    assert rows(built["p_stock"], *built["p_stock"].columns) == rows(
        project.grouped(held, stock), *built["p_stock"].columns)
    for name in built:
        spark.sql(f"DROP TABLE t_{name}")


@pytest.mark.parametrize("columns,message", [
    ({}, "no aggregate"),
    ({"a": Aggregate("Nope", "m_qty", BY)}, "is not one of"),
    ({"a": Aggregate("Move", "nope", BY)}, "no slot for"),
    ({"a": Aggregate("Move", "m_unit", BY)}, "cannot be totalled"),
    ({"a": Aggregate("Move", "m_qty", {})}, "groups nothing"),
    ({"a": Aggregate("Move", "m_qty", {"item": "m_item"})}, "groups by"),
    ({"a": Aggregate("Move", "m_qty", BY, operator="median")}, "operator"),
    ({"a": Aggregate("Move", "m_qty", BY, where={"nope": "Inside"})}, "no slot for"),
    ({"a": Aggregate("Move", "m_qty", BY, where={"m_into": "Nope"})}, "is not one of"),
    ({"a": Aggregate("Move", "m_qty", BY, convert=Convert("Factor", {}, "f_factor"))},
     "at least one"),
    ({"a": Aggregate("Move", "m_qty", BY, convert=Convert("Nope", {"x": "m_item"}, "y"))},
     "is not one of"),
    ({"a": Aggregate("Move", "m_qty", BY), "p": Parameter("nope", "price", "Item")},
     "not a key"),
    ({"a": Aggregate("Move", "m_qty", BY), "p": Parameter("item", "nope", "Item")}, "no Item"),
    ({"a": Aggregate("Move", "m_qty", BY), "e": Expression("{a} + {nope}")}, "no column"),
    ({"a": Aggregate("Move", "m_qty", BY), "e": Expression("{f}"), "f": Expression("{e}")},
     "themselves"),
])
def test_refusals(columns, message):
    with pytest.raises(SpecError, match=message):
        spec(**columns)


def test_arithmetic(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "a int, b int, c double")
    out = project.derive(df, {"q": "{a} / {b}", "r": "{c} / {b}", "s": "({q} + {b}) * -{r}"})
    assert out.first()[3:] == (0, 1.5, -3.0)
    for text in ("{a} || {b}", "{a} -- {b}", "sum({a})"):
        with pytest.raises(ExpressionError):
            arithmetic(text)


def test_reading_a_table(spark):
    t = spark.createDataFrame([("a", "10"), ("b", "9"), ("c", "Pear"), ("d", "apple"), ("e", None)],
                              "k string, v string")
    assert [r.k for r in project.user_sort(t, "v").collect()] == list("dcbae")
    assert [r.k for r in project.user_sort(t, "v", descending=True).collect()] == list("abcde")
    assert [r.k for r in project.containing(t, {"v": "PEA"}).collect()] == ["c"]
    assert project.containing(t, {"v": "none"}).count() == 0
    assert project.only(t, {"v": "9", "k": ""}).count() == 1
    assert [r.k for r in project.in_key_order(t, ["v", "k"]).collect()][-1] == "e"


def test_plan_has_no_products_and_reads_only_its_slots(spark):
    from workload import stock
    from workload.logs import stock_log
    log = stock_log(spark, "/root/testdata/sf0.001")
    df = project.grouped(project.LogView(log, "2000-06-30", "2000-07-03"), stock.RECONCILIATION)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "PartitionFilters: [slot" in plan or "PartitionFilters: [cast(slot" in plan
    assert "isnotnull(valid_from" in plan.split("PushedFilters")[0] or "PushedFilters" in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan

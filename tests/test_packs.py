"""Claims that stay packed in the rows they are made from."""

import datetime as dt
import re

from pyspark.sql import functions as F

from twoclock.operators import project, report, resolve
from twoclock.sources.revocations import revocations_of
from workload import logs, queries

SF = "/root/testdata/sf0.001"
SHAPE = ("id string, seq bigint, subject string, slot string, value string, "
         "valid_from timestamp_ntz, recorded_at timestamp_ntz, revokes string")
CLOCKS = ("2000-06-30", "2000-07-03 00:00:00")


def claim(n, subject, slot, value, day=1, revokes=None):
    at = dt.datetime(2000, 1, day)
    return (f"c{n}", n, subject, slot, value, at, at, revokes)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def packed(log, slots):
    one = F.struct("id", "seq", "value", "valid_from", "recorded_at")
    held = log.where(F.col("slot").isin(slots))
    return [(held, {s: [F.when(F.col("slot") == s, one)] for s in slots})]


def test_packed_view_gives_what_the_log_view_gives(spark):
    log = spark.createDataFrame([
        claim(1, "a", "kind", "Thing"), claim(2, "a", "size", "1"),
        claim(3, "a", "size", "2", 2), claim(4, "a", "size", None, 3, "c3"),
        claim(5, "b", "kind", "Thing"), claim(6, "b", "kind", "Other", 2),
        claim(7, "c", "kind", "Other"), claim(8, "c", "size", "9"),
        claim(9, "c", "kind", "Thing", 3), claim(10, "d", "size", None, 2, "c8")], SHAPE)
    index = revocations_of(log)
    one = project.LogView(log, *CLOCKS)
    two = project.PackedView(lambda slots: packed(log, slots), *CLOCKS, index)
    for view_read in (lambda v: v.wide({"s": "size", "k": "kind"}),
                      lambda v: v.of_class("kind", ["Thing"], {"s": "size"}),
                      lambda v: v.wide({"n": "nowhere"})):
        assert rows_of(view_read(two)) == rows_of(view_read(one))
    assert rows_of(report.packed_pivot(packed(log, ["size"]), ["size"], index)) == \
        rows_of(report.attribute_pivot(log, ["size"])) == [("a", "1")]


def test_index_finds_a_claim_of_a_slot_that_withdraws_nothing(spark):
    log = spark.createDataFrame([
        claim(1, "a", "size", "1"), claim(2, "b", "note", None, 2, "c1"),
        claim(3, "b", "note", None, 3, "c9"), claim(4, "b", "note", "x", 3, "c2")], SHAPE)
    found = {r["id"]: (r["slot"], r["subject"]) for r in revocations_of(log).collect()}
    assert found == {"c1": ("size", "a"), "c2": ("note", "b"), "c9": (None, None)}


def test_claims_of_line_items_are_not_written_and_all_there(spark):
    written = spark.read.parquet(logs.stock_path(spark, SF))
    assert written.where("subject like 'line:%' or subject like 'count:%'").isEmpty()
    lines = logs.line_rows(spark, SF)
    log = logs.stock_log(spark, SF)
    typed = log.where((F.col("slot") == logs.TYPE_SLOT) & F.col("subject").startswith("line:"))
    assert typed.count() == lines.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    some = logs.stock_log(spark, SF, ["counted_at", "list_price"])
    assert rows_of(some.select("id", "value")) == rows_of(
        log.where("slot in ('counted_at', 'list_price')").select("id", "value"))


def test_claims_in_slots_without_withdrawals_are_not_met_by_id(spark):
    log = logs.stock_log(spark, SF)
    index = logs.stock_revocations(spark, SF)
    plan = resolve.standing(log, *CLOCKS, ["counted_at", "place_name"], index)
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_rows_that_stand_alone_are_resolved_where_they_are(spark):
    log = spark.createDataFrame([
        claim(1, "a", "size", "1"), claim(2, "a", "size", "2", 2), claim(3, "b", "size", "7"),
        claim(4, "c", "kind", "Thing")], SHAPE)
    at = F.lit("2000-01-03").cast("timestamp_ntz")
    rows = spark.createDataFrame([("d", "3", "4", True), ("e", "5", None, False),
                                  ("f", "6", None, True)],
                                 "subject string, first string, then string, undone boolean")
    same = [F.lit(1).alias("seq"), at.alias("valid_from"), at.alias("recorded_at")]
    claims = {"size": [
        F.struct(F.col("first").alias("value"), *same, F.col("undone").alias("revoked"),
                 F.when(F.col("undone"), at).alias("revoked_at")),
        F.struct(F.col("then").alias("value"), *same, F.lit(False).alias("revoked"),
                 F.lit(None).cast("timestamp_ntz").alias("revoked_at"))]}
    view = project.PackedView(lambda slots: packed(log, slots), *CLOCKS, revocations_of(log),
                              lambda slots: [(rows, claims)])
    assert rows_of(view.wide({"s": "size"})) == [("a", "2"), ("b", "7"), ("d", "4"), ("e", "5")]
    alone = project.PackedView(lambda slots: [], *CLOCKS, revocations_of(log),
                               lambda slots: [(rows, claims)])
    assert "Exchange" not in alone.wide({"s": "size"})._jdf.queryExecution().toString()


def test_lines_of_one_name_are_resolved_together(spark, tmp_path):
    for name in ("nation", "supplier", "customer", "part", "orders"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_orderkey < 300")
    again = lines.where("l_linenumber % 2 = 0")
    kind = lines.schema["l_tax"].dataType
    (lines.unionByName(again.withColumn("l_returnflag", F.lit("R")))
     .unionByName(again.withColumn("l_tax", F.lit(0.08).cast(kind)))
     .write.parquet(f"{tmp_path}/lineitem.parquet"))
    d = str(tmp_path)
    log = logs.stock_log(spark, d)
    assert not logs.line_rows(spark, d).where("_alone").isEmpty()
    assert not logs.line_rows(spark, d).where("not _alone").isEmpty()
    slots = {s: s for s in ("delivered_pieces", "returned_pieces", "delivered_in",
                            "counted_pieces", logs.TYPE_SLOT)}
    view, plain = queries._view(spark, d), project.LogView(log, *CLOCKS)
    assert rows_of(view.wide(slots)) == rows_of(plain.wide(slots))
    for kinds in (["Return"], ["Part", "PromoPart"], ["Inventory"]):
        asked = (logs.TYPE_SLOT, kinds, {"p": "returned_pieces", "n": "part_name"})
        assert rows_of(view.of_class(*asked)) == rows_of(plain.of_class(*asked))
    assert rows_of(queries.attribute_pivot(spark, d)) == rows_of(
        report.attribute_pivot(log, queries._DELIVERED))
    assert rows_of(queries.class_counts(spark, d)) == rows_of(
        report.class_counts(log, logs.TYPE_SLOT))
    assert set(rows_of(logs.stock_revocations(spark, d).select("slot", "subject", "id"))) == set(
        rows_of(revocations_of(log).select("slot", "subject", "id")))


def test_what_is_asked_of_parts_reads_no_lines(spark):
    plan = queries.cell_evidence(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan and "lineitem" not in plan
    claims = logs.stock_log(spark, SF, [logs.TYPE_SLOT], ["Part"])
    assert claims.where("not subject like 'part:%'").isEmpty()


def test_lists_of_parts_and_places_write_no_lines(spark, tmp_path):
    for name in ("nation", "supplier", "part", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    # There are no orders here, so lines cannot be read.
    assert queries.entities_part(spark, str(tmp_path)).count() == 200
    assert queries.entities_location(spark, str(tmp_path)).count() == 35
    assert queries.corrections(spark, str(tmp_path)).count() == 64


def test_sums_of_lines_are_dealt_once_for_all_that_meets_them(spark):
    def exchanges(name):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        return re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)

    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not any(re.fullmatch(r"part#\d+, place#\d+|_look0#\d+, part#\d+", e)
                       for e in exchanges("on_hand"))
        assert not any(e.startswith("_agg#") for e in exchanges("on_hand_by_unit"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_lines_carry_what_tax_and_discount_decide(spark):
    columns = logs.line_rows(spark, SF).columns
    assert not {"l_tax", "l_discount", "l_linestatus"}.intersection(columns)


def test_classes_of_lines_are_read_without_writing_the_lines(spark, tmp_path):
    """Repeated names, orders there twice or not at all, and lines without one."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").orderBy("l_orderkey").limit(60)
    wanting = lines.limit(4).withColumn("l_orderkey", F.lit(None).cast("bigint"))
    unknown = lines.limit(3).withColumn("l_orderkey", F.lit(-1).cast("bigint"))
    again = lines.limit(20).withColumn("l_linestatus", F.lit("F"))
    nameless = lines.limit(2).withColumn("l_linenumber", F.lit(None).cast("int"))
    (lines.unionByName(wanting).unionByName(unknown).unionByName(again).unionByName(nameless)
     .coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet")))
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.unionByName(orders.where("o_orderkey % 7 = 0")).where("o_orderkey % 5 > 0").write \
        .parquet(str(tmp_path / "orders.parquet"))
    for name in ("customer", "part", "supplier", "nation"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    folder = str(tmp_path)
    direct = logs.stock_classes(spark, folder)
    assert logs._rest_key(spark, folder, "lines") not in logs._written
    written = [logs.stock_log(spark, folder, [logs.TYPE_SLOT], alone=a) for a in (False, True)]
    said = [sorted(r["id"] for r in a.unionByName(b).collect()) for a, b in (direct, written)]
    assert said[0] == said[1] and said[0]
    counted = [rows_of(report.class_counts(a, logs.TYPE_SLOT, b)) for a, b in (direct, written)]
    assert counted[0] == counted[1]
    last = [{r["subject"] for r in resolve.latest_class(a, logs.TYPE_SLOT, b).collect()}
            for a, b in (direct, written)]
    assert last[0] == last[1]
    assert direct[1].count() == written[1].count() > 0


def test_counts_move_finished_lines_alone(spark, tmp_path):
    for name in ("nation", "supplier", "customer", "part", "orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    folder = str(tmp_path)
    view = queries._view(spark, folder)
    slots = {s: s for s in ("counted_part", "counted_at", "counted_pieces", logs.TYPE_SLOT)}
    counts = rows_of(view.wide(slots, {"Inventory"}))
    assert logs._rest_key(spark, folder, "lines") not in logs._written
    assert counts and counts == rows_of(
        view.wide(slots).where(F.col(logs.TYPE_SLOT) == "Inventory"))


def test_packed_entities_are_stated_and_replayed_as_the_whole_log_is(spark):
    """Names that differ from their URI, ids nothing names, and withdrawn claims included."""
    def assertion(n, subject, slot, literal, ref=None, revokes=None, day=1):
        at = dt.datetime(2000, 1, day)
        return (f"a{n}", n, subject, slot, literal, ref, at, at, revokes)

    shape = ("id string, seq bigint, subject string, slot string, literal string, ref string, "
             "valid_from timestamp_ntz, recorded_at timestamp_ntz, revokes string")

    def under_ids(rows):
        return spark.createDataFrame(rows, shape).select(
            "id", "seq", F.md5("subject").alias("subject_id"), F.md5("slot").alias("predicate_id"),
            F.col("literal").alias("value_literal"), F.md5("ref").alias("value_ref"),
            "valid_from", "recorded_at", "revokes")

    others = [assertion(1, "name", "name", "name"), assertion(2, "size", "name", "measure"),
              assertion(3, "in", "name", "in"), assertion(4, "box", "name", "crate"),
              assertion(5, "box", "name", "box", day=2), assertion(6, "box", "size", "9"),
              assertion(7, "size", "name", None, revokes="a2", day=3),
              assertion(8, "size", "name", "size", day=3)]
    packed_ = [assertion(11, "x", "name", "X"), assertion(12, "x", "size", "1"),
               assertion(13, "x", "size", "2", revokes="a12", day=2),
               assertion(14, "x", "in", None, "box"), assertion(15, "x", "odd", "o"),
               assertion(16, "y", "size", "5"), assertion(17, "y", "in", None, "lid")]
    rows = spark.createDataFrame(
        [("x", "X", "1", "2", "box", "o"), ("y", None, "5", None, "lid", None)],
        "subject string, named string, first string, then string, inside string, odd string")

    def one(n, value, day=1, undone=False):
        at = F.lit(f"2000-01-0{day}").cast("timestamp_ntz")
        return F.struct((n if not isinstance(n, int) else F.lit(n)).cast("bigint").alias("seq"),
                        value.alias("value"), at.alias("valid_from"), at.alias("recorded_at"),
                        F.lit(undone).alias("revoked") if isinstance(undone, bool)
                        else undone.alias("revoked"),
                        F.lit("2000-01-02").cast("timestamp_ntz").alias("revoked_at"))

    x = F.col("subject") == "x"
    claims = {"name": [one(11, F.col("named"))],
              "size": [one(F.when(x, 12).otherwise(16), F.col("first"), undone=x),
                       F.when(x, one(13, F.col("then"), 2))],
              "in": [one(F.when(x, 14).otherwise(17), F.col("inside"))],
              "odd": [one(15, F.col("odd"))]}

    def read(slots=None):
        return [(rows, {s: c for s, c in claims.items()
                        if slots is None or s in slots or s == "name"})]

    uris = spark.createDataFrame([(u,) for u in ("name", "size", "in", "odd", "box", "lid")],
                                 "uri string")
    alone = resolve.PackedEntities(read, "name", ["in"], uris)
    whole, rest = under_ids(others + packed_), under_ids(others)
    for valid, known in (("2000-01-05", "2000-01-05"), ("2000-01-01", "2000-01-01")):
        for slots in (None, ["measure", "in"], ["size"]):
            apart = resolve.stated(rest, "name", valid, known, slots, alone)
            assert rows_of(apart) == rows_of(resolve.stated(whole, "name", valid, known, slots))
        apart = resolve.replay(rest, "name", valid, known, alone)
        assert rows_of(apart) == rows_of(resolve.replay(whole, "name", valid, known))


def test_entities_of_lines_that_stand_alone_are_not_shuffled(spark):
    rest = logs.stock_assertions(spark, SF, alone=False)
    named = {r["value_literal"] for r in rest.where(
        F.col("predicate_id") == F.md5(F.lit(logs.URI_SLOT))).collect()}
    assert not any(n.startswith(("line:", "count:")) for n in named)
    entities = logs.stock_entities(spark, SF)
    won = resolve.standing_alone(entities.read(), *CLOCKS)
    assert "Exchange" not in won._jdf.queryExecution().executedPlan().toString()
    assert won.where(F.col("slot") == logs.TYPE_SLOT).count() == logs.stock_log(
        spark, SF, [logs.TYPE_SLOT], alone=True).where(
            "valid_from < '2000-07-01' and recorded_at <= '2000-07-03'").count()


def test_standing_stock_shuffles_no_claim_of_lines_that_stand_alone(spark):
    held = logs.stock_standing(spark, SF, *CLOCKS)
    whole = resolve.standing(logs.stock_log(spark, SF), *CLOCKS,
                             revocations=logs.stock_revocations(spark, SF))
    assert held.exceptAll(whole.select(*held.columns)).isEmpty()
    assert held.count() == whole.count()
    alone = resolve.standing_alone(logs.stock_alone(spark, SF, [logs.TYPE_SLOT, *logs.SLOTS]),
                                   *CLOCKS)
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()


def test_tables_are_refreshed_from_a_view_without_a_snapshot(spark):
    from twoclock.sources import refresh_all
    from workload import stock
    built = refresh_all(queries._view(spark, SF), [stock.ENTITY_SPECS["Packing"]], prefix="v_")
    held = project.entities(queries._view(spark, SF), stock.ENTITY_SPECS["Packing"])
    assert rows_of(built["p_packing"]) == rows_of(held)
    spark.sql("DROP TABLE v_p_packing")


def test_references_of_assertions_that_stand_alone(spark):
    from twoclock.operators import ingest
    shape = ("id string, subject_id string, predicate_id string, value_ref string, "
             "revokes string, intent_id string")
    rest = [("c1", "box", "in", "shelf", None, "i1"), ("c2", "box", "in", None, "c9", "i9")]
    more = [("c3", "line", "in", "box", None, "i3"), ("c4", "line", "to", "lost", "c3", "i3")]
    known = spark.createDataFrame([("box",), ("in",)], "id string")
    acts = spark.createDataFrame([("i1",)], "id string")
    found = ingest.dangling_references(spark.createDataFrame(rest, shape), known, acts,
                                       spark.createDataFrame(more, shape))
    assert rows_of(found) == [("intent_id", "c2", "i9"), ("predicate_id", "c4", "to"),
                              ("revokes", "c2", "c9"), ("value_ref", "c1", "shelf"),
                              ("value_ref", "c4", "lost")]

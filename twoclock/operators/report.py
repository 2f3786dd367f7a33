"""Stock reports over a reconciliation, and clock-free checks of the log's shape."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from .resolve import pivot_packs


@dataclass(frozen=True)
class Named:
    """Which columns of the tables a report is made from mean what it asks for. Of items:
    their label, the unit they are kept in, the level to reorder at (in that unit) and the
    price. Of units their label; of conversions the item, the unit and the factor; of
    places their label. Of the reconciliation: both keys, what should remain, what was
    counted, how they differ, and the values of the last two."""
    label: str
    unit: str
    level: str
    price: str
    unit_label: str
    converted_item: str
    converted_unit: str
    factor: str
    place_label: str
    item: str
    place: str
    remaining: str
    counted: str
    gap: str
    counted_value: str
    gap_value: str


def item_metadata(items, units, conversions, named: Named) -> DataFrame:
    """Each item with the unit it is counted in and that unit's factor; every item
    stays, an unconverted one has factor 1."""
    u = units.select(F.col("entity_uri").alias("_holder"), named.unit_label)
    c = conversions.select(F.col(named.converted_item).alias("_item"),
                           F.col(named.converted_unit).alias("_cunit"),
                           F.col(named.factor).alias("_factor"))
    return (items.join(u, F.col(named.unit) == F.col("_holder"), "left")
            .join(c, (F.col("entity_uri") == F.col("_item"))
                  & (F.col(named.unit) == F.col("_cunit")), "left")
            .select("entity_uri", named.label, named.unit, named.level, named.price,
                    F.coalesce("_factor", F.lit(1)).cast("double").alias("factor"),
                    named.unit_label))


def item_health(reconciliation, metadata, places, named: Named, severe=-50.0) -> DataFrame:
    """One row per (item, place), in the report's own words: quantities, money, and the
    two flags.

    An anomaly lost `severe` or more in value. A reorder is counted below the level in
    base units while something should remain.
    """
    m = metadata.select(F.col("entity_uri").alias("part"), F.col(named.label).alias("_label"),
                        "factor", F.col(named.level).cast("double").alias("_level"),
                        F.coalesce(named.unit_label, F.lit("pieces")).alias("pack_unit"))
    p = places.select(F.col("entity_uri").alias("place"),
                      F.col(named.place_label).alias("_where"))
    money = {ours: F.coalesce(F.col(theirs).cast("double"), F.lit(0.0)) for ours, theirs in
             (("list_price", named.price), ("remaining", named.remaining),
              ("counted", named.counted), ("gap", named.gap))}
    held = reconciliation.withColumnsRenamed({named.item: "part", named.place: "place"})
    rows = (held.join(m, "part", "left").join(p, "place", "left")
            .select("part", "place",
                    F.coalesce("_label", "part").alias("name"),
                    F.coalesce("_where", "place").alias("location"),
                    F.coalesce("pack_unit", F.lit("pieces")).alias("pack_unit"),
                    F.coalesce("factor", F.lit(1.0)).alias("pack_factor"),
                    (F.col("_level") * F.coalesce("factor", F.lit(1.0))).alias("reorder_base"),
                    *[c.alias(n) for n, c in money.items()],
                    F.col(named.counted_value).cast("double").alias("_sv"),
                    F.col(named.gap_value).cast("double").alias("_vv")))
    return rows.select(
        "part", "place", "name", "location", "pack_unit", "pack_factor",
        "reorder_base", "list_price", "remaining", "counted", "gap",
        F.round(F.when(F.col("pack_factor") != 0, F.col("counted") / F.col("pack_factor"))
                .otherwise(F.col("counted")), 1).alias("counted_packs"),
        F.coalesce("_sv", F.col("counted") * F.col("list_price")).alias("counted_value"),
        F.coalesce("_vv", F.col("gap") * F.col("list_price")).alias("gap_value"),
        (F.coalesce("_vv", F.col("gap") * F.col("list_price")) <= severe).alias("is_anomaly"),
        (F.col("reorder_base").isNotNull() & (F.col("counted") < F.col("reorder_base"))
         & (F.col("remaining") > 0)).alias("is_reorder"))


def kpi_totals(items) -> DataFrame:
    totals = items.agg(
        F.coalesce(F.sum("counted_value"), F.lit(0.0)).alias("valuation"),
        F.coalesce(F.sum(F.col("remaining") * F.col("list_price")), F.lit(0.0))
        .alias("remaining_valuation"),
        F.coalesce(F.sum("gap_value"), F.lit(0.0)).alias("gap_value"),
        F.coalesce(F.sum("gap"), F.lit(0.0)).alias("gap_pieces"))
    return totals.withColumn(
        "accuracy_pct",
        F.when(F.col("remaining_valuation") == 0, F.lit(100.0))
        .otherwise(F.col("valuation") / F.col("remaining_valuation") * 100))


def zone_rollup(items) -> DataFrame:
    return items.groupBy("location").agg(
        F.count(F.lit(1)).alias("items"), F.sum("counted_value").alias("valuation"),
        F.sum("gap_value").alias("gap_value"))


def worst_first(items):
    return items.orderBy("gap_value", "name", "part", "place")


def top_losses(items, k=6) -> DataFrame:
    """The k largest losses, each as a share of the whole gap and of the largest
    loss. The two totals are scalars, so no window spans the table; the items, read
    three times, are computed once and kept in the shared folder."""
    items = kept(items.select("part", "place", "name", "gap_value"))
    whole = F.abs(items.agg(F.sum("gap_value")).scalar())
    deepest = F.abs(items.where("gap_value < 0").agg(F.min("gap_value")).scalar())
    loss = F.abs(F.col("gap_value"))
    return (items.where("gap_value < 0")
            .orderBy("gap_value", "part", "place").limit(k)
            .select("part", "place", "name", "gap_value",
                    F.when(whole != 0, loss / whole * 100).otherwise(0.0)
                    .alias("pct_of_total"),
                    F.least(F.lit(100.0), F.when(deepest > 0, loss / deepest * 100)
                            .otherwise(0.0)).alias("pct_of_max")))


def alerts(items) -> DataFrame:
    """One row per anomaly and per reorder; every breach, whatever the item. The items
    are computed once for their total and their rows."""
    items = kept(items)
    whole = F.abs(items.agg(F.sum("gap_value")).scalar())
    kinds = F.array(
        F.when(F.col("is_anomaly"), F.struct(
            F.lit("anomaly").alias("alert"), F.abs("gap").alias("deficit"),
            F.when(whole != 0, F.abs("gap_value") / whole * 100).alias("share_pct"))),
        F.when(F.col("is_reorder"), F.struct(
            F.lit("reorder").alias("alert"),
            (F.col("reorder_base") - F.col("counted")).alias("deficit"),
            F.lit(None).cast("double").alias("share_pct"))))
    return (items.select("part", "place", "name", "location", F.explode(kinds).alias("k"))
            .where("k IS NOT NULL").select("part", "place", "name", "location", "k.*"))


# ---- clock-free reads of the log ------------------------------------------

def live(claims) -> DataFrame:
    """Claims nothing ever revoked, whatever the clocks."""
    gone = (claims.where(F.col("revokes").isNotNull())
            .select(F.col("revokes").alias("id")).distinct())
    return claims.join(gone, "id", "left_anti")


def attribute_pivot(claims, slots) -> DataFrame:
    """One row per subject holding any of the slots, largest live value of each."""
    held = live(claims.where(F.col("slot").isin(list(slots)) | F.col("revokes").isNotNull()))
    return (held.where(F.col("slot").isin(list(slots)) & F.col("value").isNotNull())
            .groupBy("subject").agg(*[
                F.max(F.when(F.col("slot") == s, F.col("value"))).alias(s) for s in slots]))


def packed_pivot(packs, slots, revocations, alone=()) -> DataFrame:
    """`attribute_pivot` of claims packed by subject, with the index of the log."""
    return pivot_packs(packs, {s: s for s in slots}, lambda c: F.lit(True), (), revocations,
                       alone, lambda c: c["revoked"])


def place_totals(lines, packings, places) -> DataFrame:
    """(part, place, total) of lines (part, container, place, pieces; signed or not) at
    the places given, in single pieces: `packings` (part, container, factor) says how
    many a container holds, 1 if it does not. Lines are summed before they meet either."""
    summed = (lines.where("place IS NOT NULL").groupBy("part", "container", "place")
              .agg(F.sum("pieces").alias("_n")))
    return (summed.join(places.select("place").distinct(), "place")
            .join(packings, ["part", "container"], "left")
            .groupBy("part", "place")
            .agg(F.sum(F.col("_n") * F.coalesce("factor", F.lit(1))).alias("total")))


def balance(lines, packings, places) -> DataFrame:
    """(part, place, remaining) where lines signed by their direction leave something."""
    return (place_totals(lines, packings, places)
            .select("part", "place", F.col("total").alias("remaining")).where("remaining > 0"))


def in_and_out(delivered, returned) -> DataFrame:
    """The same from two ready tables (part, place, total), by a full outer join."""
    both = delivered.join(returned.withColumnRenamed("total", "_back"), ["part", "place"], "full")
    left = F.coalesce("total", F.lit(0)) - F.coalesce("_back", F.lit(0))
    return both.select("part", "place", left.alias("remaining")).where("remaining > 0")


def class_counts(claims, type_slot, alone=None) -> DataFrame:
    """Distinct subjects ever said to be of each class. `alone` are further claims, whose
    subjects have one claim of a class each and none in `claims`: they are only counted."""
    def by_class(df):
        return df.where((F.col("slot") == type_slot) & F.col("value").isNotNull()).groupBy(
            F.col("value").alias("class"))

    found = by_class(claims).agg(F.countDistinct("subject").alias("subjects"))
    return found if alone is None else found.unionByName(
        by_class(alone).agg(F.count("subject").alias("subjects"))).groupBy("class").agg(
            F.sum("subjects").alias("subjects"))


def log_shape(claims) -> DataFrame:
    day = F.to_date("recorded_at")
    return claims.agg(
        F.count(F.lit(1)).alias("assertions"),
        F.count("revokes").alias("revoking"),
        F.count_if(F.col("value").isNull()).alias("retractions"),
        F.countDistinct(day).alias("recorded_days"),
        F.min(F.to_date("valid_from")).alias("first_valid"),
        F.max(F.to_date("valid_from")).alias("last_valid"),
        F.min(day).alias("first_recorded"), F.max(day).alias("last_recorded"))

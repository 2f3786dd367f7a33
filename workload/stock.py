"""The trade model, in the terms of the given tables, and what is derived from it.

A line item is a delivery of a part by a supplier to the buyer's nation, or, flagged R, a
return from that nation to the supplier. Finished lines were counted on arrival. Packings
say how many pieces of a part its containers hold.
"""

from twoclock.operators import report
from twoclock.plans import (Aggregate, Convert, EntitySpec, Expression, GroupedSpec, Model,
                            Parameter)

KIND = "kind_of_thing"

_PART_SLOTS = ["part_name", "part_brand", "part_container", "list_price", "floor_stock"]
_REFERENCES = {
    "part_brand": None, "part_container": "Container",
    "packed_part": "Part", "packed_in": "Container",
    "delivered_part": "Part", "delivered_to": "Place", "delivered_by": "Supplier",
    "delivered_in": "Container",
    "returned_part": "Part", "returned_from": "Place", "returned_to": "Supplier",
    "returned_in": "Container",
    "counted_part": "Part", "counted_at": "Place", "counted_in": "Container",
}
_DECIMALS = ["list_price", "floor_stock", "pieces_each", "delivered_pieces",
             "returned_pieces", "counted_pieces"]


def _having(*slots, **more):
    return {"slots": [KIND, *slots], **more}


MODEL = Model.from_dict({
    "classes": {
        "Place": _having("place_name"),
        "HomeNation": {"is_a": "Place"},
        "Supplier": {"is_a": "Place"},
        "Part": _having(*_PART_SLOTS),
        "PromoPart": {"is_a": "Part"},
        "Container": _having("container_label"),
        "Packing": _having("packed_part", "packed_in", "pieces_each"),
        "Delivery": _having("delivered_part", "delivered_to", "delivered_by",
                            "delivered_pieces", "delivered_in"),
        "Return": _having("returned_part", "returned_from", "returned_to",
                          "returned_pieces", "returned_in"),
        "Inventory": _having("counted_part", "counted_at", "counted_pieces", "counted_in"),
    },
    "slots": {
        KIND: {"designates_type": True},
        **{name: {"identifier": True} for name in ("part_name", "place_name", "container_label")},
        **{name: {"range": kind} if kind else {} for name, kind in _REFERENCES.items()},
        **{name: {"range": "decimal"} for name in _DECIMALS},
    },
})


def _sum_of(kind, prefix, place, home=True, in_pieces=True, container=False):
    """Pieces of a class of line items by part and place, and by container if asked."""
    part, held = f"{prefix}_part", f"{prefix}_in"
    by = {"part": part, "place": place}
    return Aggregate(
        kind, f"{prefix}_pieces", {**by, "container": held} if container else by,
        where={place: "HomeNation", part: "Part"} if home else {},
        convert=Convert("Packing", {"packed_part": part, "packed_in": held}, "pieces_each")
        if in_pieces else None)


def _of_part(slot):
    return Parameter("part", slot, "Part")


_ARRIVALS_COUNTED = _sum_of("Inventory", "counted", "counted_at")

# What home nations should still have of each part, against what was counted there.
RECONCILIATION = GroupedSpec(MODEL, "TradeBalance", {
    "part": "key", "place": "key",
    "delivered": _sum_of("Delivery", "delivered", "delivered_to"),
    "sent_back": _sum_of("Return", "returned", "returned_from"),
    "counted": _ARRIVALS_COUNTED,
    "brand": _of_part("part_brand"),
    "list_price": _of_part("list_price"),
    "floor_stock": _of_part("floor_stock"),
    "remaining": Expression("{delivered} - {sent_back}"),
    "counted_value": Expression("{counted} * {list_price}"),
    "gap": Expression("{counted} - {remaining}"),
    "gap_value": Expression("{gap} * {list_price}"),
})

# Every place in pieces: lines with no place have a NULL key, suppliers get returns back.
ON_HAND = GroupedSpec(MODEL, "PartFlow", {
    "part": "key", "place": "key",
    "delivered": _sum_of("Delivery", "delivered", "delivered_to", home=False),
    "sent_back": _sum_of("Return", "returned", "returned_from", home=False),
    "taken_back": _sum_of("Return", "returned", "returned_to", home=False),
    "net": Expression("{delivered} + {taken_back} - {sent_back}"),
    "brand": _of_part("part_brand"),
    "floor_stock": _of_part("floor_stock"),
    "list_price": _of_part("list_price"),
    "net_value": Expression("{net} * {list_price}"),
})

# Not turned into pieces: the container is a third key.
ON_HAND_BY_UNIT = GroupedSpec(MODEL, "PartFlowByContainer", {
    "part": "key", "place": "key", "container": "key",
    "delivered": _sum_of("Delivery", "delivered", "delivered_to", False, False, True),
    "sent_back": _sum_of("Return", "returned", "returned_from", False, False, True),
    "lines": Aggregate("Delivery", "delivered_pieces",
                       {"part": "delivered_part", "place": "delivered_to",
                        "container": "delivered_in"}, operator="count"),
    "net": Expression("{delivered} - {sent_back}"),
})

COUNTED_ON_HAND = GroupedSpec(MODEL, "CountedParts", {
    "part": "key", "place": "key",
    "brand": _of_part("part_brand"),
    "container": _of_part("part_container"),
    "counted": _ARRIVALS_COUNTED,
})

# What the reports over the balance are made from.
REPORTED = report.Named(
    label="part_name", unit="part_container", level="floor_stock", price="list_price",
    unit_label="container_label", converted_item="packed_part", converted_unit="packed_in",
    factor="pieces_each", place_label="place_name", item="part", place="place",
    remaining="remaining", counted="counted", gap="gap", counted_value="counted_value",
    gap_value="gap_value")

ENTITY_SPECS = {c: EntitySpec(MODEL, c) for c in
                ("Part", "Place", "HomeNation", "Supplier", "Container", "Packing")}

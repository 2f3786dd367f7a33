"""What a derived table is: plain dataclasses, checked when they are made.

A `Model` holds classes (with `is_a` parents), slots and their ranges. A class
becomes an `EntitySpec`; aggregates, parameters and expressions over classes become
a `GroupedSpec`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.expressions import ExpressionError, evaluation_order
from ..schema import range_type

IDENTITY = "entity_uri"          # first column of an entity list
EMPTY = {"sum": 0, "count": 0}   # what each operator is over no rows


class SpecError(ValueError):
    """A table that cannot be derived as described."""


@dataclass(frozen=True)
class Slot:
    name: str
    range: str = "string"
    identifier: bool = False
    designates_type: bool = False
    uri: str | None = None
    type: str | None = None       # Spark type overriding the range's

    @property
    def key(self):
        return self.uri or self.name


@dataclass(frozen=True)
class Model:
    """classes: name -> (parent or None, [slot names]); slots: name -> Slot."""
    classes: dict
    slots: dict

    def __post_init__(self):
        for name, (parent, own) in self.classes.items():
            if parent is not None and parent not in self.classes:
                raise SpecError(f"{name} is_a {parent}, which is not a class")
            for slot in own:
                if slot not in self.slots:
                    raise SpecError(f"{name} lists {slot}, which is not a slot")

    @classmethod
    def from_dict(cls, described):
        slots = {n: Slot(name=n, **(d or {})) for n, d in described["slots"].items()}
        classes = {n: ((d or {}).get("is_a"), list((d or {}).get("slots", [])))
                   for n, d in described["classes"].items()}
        return cls(classes, slots)

    def need(self, class_name, role="class"):
        if class_name not in self.classes:
            raise SpecError(f"{role} {class_name!r} is not one of {sorted(self.classes)}")

    def slots_of(self, class_name):
        """Own slots, then each ancestor's."""
        self.need(class_name)
        seen, out = set(), []
        while class_name is not None:
            parent, own = self.classes[class_name]
            out += [self.slots[s] for s in own if s not in seen]
            seen.update(own)
            class_name = parent
        return out

    def descendants(self, class_name):
        """The class and everything below it."""
        self.need(class_name)
        out, grown = {class_name}, True
        while grown:
            more = {n for n, (parent, _) in self.classes.items() if parent in out} - out
            out |= more
            grown = bool(more)
        return sorted(out)

    def type_slot(self, class_name):
        for slot in self.slots_of(class_name):
            if slot.designates_type:
                return slot
        raise SpecError(f"{class_name} has no slot saying what an entity is, so no "
                        f"claim can make one")

    def slot_of(self, class_name, slot_name, role):
        for slot in self.slots_of(class_name):
            if slot.name == slot_name:
                return slot
        raise SpecError(f"{role} names {slot_name!r}, which {class_name} has no slot for")

    def identifier(self, class_name):
        return next((s for s in self.slots_of(class_name) if s.identifier), None)

    def column_type(self, slot):
        if slot.range in self.classes:
            return "string"
        return slot.type or range_type(slot.range)

    def is_ref(self, slot):
        return slot.range in self.classes


@dataclass(frozen=True)
class Convert:
    """Factor looked up in class `using`, matching its slots to the source's."""
    using: str
    on: dict                 # conversion slot -> source slot
    factor: str
    factor_type: str = "decimal(13,6)"


@dataclass(frozen=True)
class Aggregate:
    over: str
    measure: str
    by: dict                 # key column -> source slot
    operator: str = "sum"
    where: dict = field(default_factory=dict)   # source slot -> class it must be
    convert: Convert | None = None


@dataclass(frozen=True)
class Parameter:
    of: str                  # key column naming the entity
    slot: str
    of_class: str


@dataclass(frozen=True)
class Expression:
    text: str


@dataclass(frozen=True)
class Unfilled:
    type: str = "string"


def _numeric(type_):
    return type_.startswith("decimal") or type_ in ("bigint", "double")


class EntitySpec:
    """One row per entity of a class, one typed column per slot."""

    def __init__(self, model: Model, class_name: str):
        self.model, self.class_name = model, class_name
        self.type_slot = model.type_slot(class_name)
        self.columns = model.slots_of(class_name)
        if any(s.name == IDENTITY for s in self.columns):
            raise SpecError(f"{class_name} has a slot called {IDENTITY!r}, which carries "
                            f"the entity itself")
        self.classes = model.descendants(class_name)

    @property
    def table(self):
        return _table_name(self.class_name)


class GroupedSpec:
    """One row per combination of keys any aggregate produces."""

    def __init__(self, model: Model, name: str, columns: dict):
        self.model, self.name, self.columns = model, name, dict(columns)
        self.aggregates = {c: r for c, r in columns.items() if isinstance(r, Aggregate)}
        self.parameters = {c: r for c, r in columns.items() if isinstance(r, Parameter)}
        self.expressions = {c: r.text for c, r in columns.items() if isinstance(r, Expression)}
        self.keys = [c for c, r in columns.items() if r == "key"]
        if not self.aggregates:
            raise SpecError(f"{name} has no aggregate, so nothing fills it")
        for column, rule in self.aggregates.items():
            self._check_aggregate(f"{name}.{column}", rule)
        for column, rule in self.parameters.items():
            if rule.of not in self.keys:
                raise SpecError(f"{name}.{column} reads off {rule.of!r}, which is not a key")
            if not any(rule.slot == s.name for c in model.descendants(rule.of_class)
                       for s in model.slots_of(c)):
                raise SpecError(f"{name}.{column}: no {rule.of_class} has slot {rule.slot!r}")
        try:
            self.order = evaluation_order(self.expressions, set(columns))
        except ExpressionError as exc:
            raise SpecError(f"{name}: {exc}") from None

    def _check_aggregate(self, where, rule):
        model = self.model
        if rule.operator not in EMPTY:
            raise SpecError(f"{where}: operator {rule.operator!r} is not one of {sorted(EMPTY)}")
        model.need(rule.over, f"{where}: `over`")
        model.type_slot(rule.over)
        measure = model.slot_of(rule.over, rule.measure, f"{where}: measure")
        if rule.operator == "sum" and not _numeric(model.column_type(measure)):
            raise SpecError(f"{where}: {rule.measure} cannot be totalled")
        if not rule.by:
            raise SpecError(f"{where}: an aggregate with no keys groups nothing")
        if set(rule.by) != set(self.keys):
            raise SpecError(f"{where}: groups by {sorted(rule.by)}, the table by "
                            f"{sorted(self.keys)}")
        for slot in [*rule.by.values(), *rule.where]:
            model.slot_of(rule.over, slot, where)
        for target in rule.where.values():
            model.need(target, f"{where}: scope")
            model.type_slot(target)
        if rule.convert:
            cv = rule.convert
            if rule.operator != "sum":
                raise SpecError(f"{where}: only a sum can be converted")
            model.need(cv.using, f"{where}: `using`")
            model.type_slot(cv.using)
            if not cv.on:
                raise SpecError(f"{where}: a conversion matches on at least one slot")
            factor = model.slot_of(cv.using, cv.factor, f"{where}: factor")
            if not _numeric(model.column_type(factor)):
                raise SpecError(f"{where}: {cv.factor} is not a number")
            for theirs, ours in cv.on.items():
                model.slot_of(cv.using, theirs, where)
                model.slot_of(rule.over, ours, where)

    @property
    def table(self):
        return _table_name(self.name)


def _table_name(name):
    out = "".join(("_" + c.lower()) if c.isupper() else c for c in name).lstrip("_")
    return "p_" + out

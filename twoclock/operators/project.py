"""Derived tables from the state at two clocks.

A view answers two reads: `wide(slots)`, one row per subject with a column per slot
(with `classes`, subjects never said to be of any of them may be left out),
and `of_class(…)`, the same for the subjects of a class. `LogView` answers them from
the claims, `PackedView` from claims packed by subject, `StatedView` from an already
resolved (subject, slot, value) frame such as a written snapshot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import arithmetic
from ..plans.spec import IDENTITY, EntitySpec, GroupedSpec
from ..session import kept
from .resolve import standing_packs, standing_wide


class LogView:
    """`revocations` is the index of a log, needed where `claims` is a part of it."""

    def __init__(self, claims, valid_at, as_of, revocations=None):
        self.claims, self.valid_at, self.as_of = claims, valid_at, as_of
        self.revocations = revocations

    def wide(self, slots, classes=None):
        return standing_wide(self.claims, slots, self.valid_at, self.as_of,
                             revocations=self.revocations)

    def about(self, subjects):
        """The same view of some subjects only."""
        return LogView(self.claims.join(subjects.select("subject"), "subject", "left_semi"),
                       self.valid_at, self.as_of, self.revocations)

    def of_class(self, type_slot, classes, slots):
        """Rows of the subjects whose class at the clocks is one of `classes`.

        Every entity has a class claim, so most of that slot is about others. Who was
        never said to be of the class cannot be: other class claims count only for
        subjects that have one naming it. A small class is broadcast, and the rest of
        the slot goes no further than its scan.
        """
        c = self.claims
        names_it = F.col("value").isin(list(classes))
        typed = F.col("slot") == type_slot
        ever = c.where(typed & names_it).select("subject").distinct()
        others = c.where(typed & ~names_it).join(ever, "subject", "left_semi")
        kept = (c.where((F.col("slot").isin(sorted(set(slots.values()) - {type_slot})))
                        | (typed & names_it)).select(*c.columns)
                .unionByName(others.select(*c.columns)))
        won = standing_wide(kept, {**slots, "_type": type_slot}, self.valid_at, self.as_of,
                            revoking=c, revocations=self.revocations)
        return won.where(F.col("_type").isin(list(classes))).drop("_type")


class PackedView:
    """A log whose claims come packed: `read(slots)` gives, as `resolve.pivot_packs` takes
    them, rows with the claims in some slots; `revocations` is its index. `alone(slots)`
    gives rows that hold all claims of their subject: those are resolved where they stand,
    and the index need not name their claims. Nothing is written of the state, and what a
    class does not need is dropped before a shuffle. With `by_class`, both also take the
    classes asked for, and may leave out subjects that were never said to be of any;
    `revocations` then is a function of the same."""

    def __init__(self, read, valid_at, as_of, revocations, alone=None, by_class=False):
        self.read, self.valid_at, self.as_of = read, valid_at, as_of
        self.revocations = revocations
        self.alone = alone or (lambda *asked: [])
        self.by_class = by_class
        self._ever = {}

    def _asked(self, slots, classes):
        slots = sorted(set(slots))
        return (slots, classes) if self.by_class else (slots,)

    def _won(self, packs, asked, slots):
        index = self.revocations(*asked) if self.by_class else self.revocations
        return standing_packs(packs, slots, self.valid_at, self.as_of, index, self.alone(*asked))

    def wide(self, slots, classes=None):
        asked = self._asked(slots.values(), classes)
        return self._won(self.read(*asked), asked, slots)

    def of_class(self, type_slot, classes, slots):
        """As `LogView.of_class`: only subjects ever said to be of the class are resolved.
        They are written down once, so that few of them are broadcast."""
        wanted = {**slots, "_type": type_slot}
        asked = self._asked(wanted.values(), classes)
        packs = self.read(*asked)
        if packs:
            ever = self._named(type_slot, tuple(sorted(classes)))
            packs = [(rows.join(ever, "subject", "left_semi"), claims) for rows, claims in packs]
        won = self._won(packs, asked, wanted)
        return won.where(F.col("_type").isin(list(classes))).drop("_type")

    def _named(self, type_slot, classes):
        if (type_slot, classes) not in self._ever:
            named = [rows.where(reduce(lambda a, b: a | b, [
                c["value"].isin(list(classes)) for c in claims[type_slot]])).select("subject")
                for rows, claims in self.read(*self._asked([type_slot], classes))
                if claims.get(type_slot)]
            self._ever[type_slot, classes] = kept(
                reduce(lambda a, b: a.union(b), named).distinct())
        return self._ever[type_slot, classes]


class StatedView:
    def __init__(self, stated):
        self.stated = stated

    def wide(self, slots, classes=None):
        held = self.stated.where(F.col("slot").isin(sorted(set(slots.values()))))
        return held.groupBy("subject").agg(*[
            F.max(F.when(F.col("slot") == slot, F.col("value"))).alias(name)
            for name, slot in slots.items()])

    def of_class(self, type_slot, classes, slots):
        won = self.wide({**slots, "_type": type_slot})
        return won.where(F.col("_type").isin(list(classes))).drop("_type")


def members(view, model, class_name) -> DataFrame:
    """Subjects that are of the class, or of one below it, at the clocks."""
    return view.of_class(model.type_slot(class_name).key, model.descendants(class_name),
                         {}).select("subject")


# ---- entity lists ---------------------------------------------------------

def entities(view, spec: EntitySpec, safe_cast=False) -> DataFrame:
    """One row per entity; unstated cells NULL. The class test is made on the pivoted
    row, so a single aggregation gives both the rows and their cells."""
    model = spec.model
    held = view.of_class(spec.type_slot.key, spec.classes,
                         {s.name: s.key for s in spec.columns})
    return held.select(F.col("subject").alias(IDENTITY), *[
        _cast(F.col(s.name), model.column_type(s), safe_cast).alias(s.name)
        for s in spec.columns])


def _cast(col, type_, safe):
    if type_ == "string":
        return col
    return col.try_cast(type_) if safe else col.cast(type_)


# ---- grouped tables -------------------------------------------------------

def grouped(view, spec: GroupedSpec) -> DataFrame:
    """The union of all aggregates' groups, in four steps:

    1. one wide row per source entity, for all source classes at once;
    2. each row becomes one contribution per aggregate over its class, and
       contributions are summed by everything the later joins need, so a hot key
       is a handful of rows before it meets another table;
    3. scope (unique inner join) and conversion (left join) on those partial
       sums — a factor depends only on the matched columns, so it multiplies the sum;
    4. one groupBy on the keys with a conditional sum per aggregate. Grouping
       treats NULL keys as equal, which makes null-safe joins unnecessary.

    Without scopes and conversions the last step sums the contributions themselves. Else
    the partial sums are dealt once by the key that later joins ask most of, and meet
    them all, and each other, where they then are.
    """
    spread, checks, conversions = contributions(view, spec)
    at = [c for c in spread.columns if c != "_m"]
    partial = spread.groupBy(*at).agg(F.sum("_m").alias("_m"))
    if not checks and not conversions:
        kind = dict(partial.dtypes)["_m"]
        return _finish(view, spec, _totals(
            spec, spread.withColumn("_m", F.col("_m").cast(kind)), conversions))
    near = _meeting_key(spec, checks, conversions)
    checks = sorted(checks, key=lambda check: check["name"] == near)
    scoped = _apply_scopes(view, spec, partial, checks, near)
    if near and all(check["name"] != near for check in checks):
        scoped = scoped.repartition(near)
    converted = _apply_conversions(view, spec, scoped, conversions, near)
    return _finish(view, spec, _totals(spec, converted, conversions))


def _meeting_key(spec, checks, conversions):
    """The key that most scopes, conversions and parameters look at, if two or more do."""
    looked = [c["name"] for c in [*checks, *(m for cv in conversions for m in cv["matches"])]]
    looked += [rule.of for rule in spec.parameters.values()]
    most = max(spec.keys, key=looked.count)
    return most if looked.count(most) > 1 else None


def _totals(spec, converted, conversions):
    amount = F.col("_m") * F.col("_f") if conversions else F.col("_m")

    names = list(spec.aggregates)
    totals = converted.groupBy(*spec.keys).agg(*[
        F.sum(F.when(F.col("_agg") == i, amount)).alias(name)
        for i, name in enumerate(names)])
    return totals.select(*spec.keys, *[
        _total(F.col(n), spec, n).alias(n) for n in names])


def _total(col, spec, name):
    rule = spec.aggregates[name]
    value = F.coalesce(col, F.lit(0))
    if rule.operator == "count":
        return value.cast("bigint")
    measure = spec.model.slot_of(rule.over, rule.measure, name)
    type_ = spec.model.column_type(measure)
    if type_ == "double":
        return value.cast("double")
    if type_ == "bigint" and not rule.convert:
        return value.cast("bigint")
    return value


def _measure_type(spec):
    """One type for all contributions: doubles only if some measure is one; of decimals
    one that holds the whole digits and the places of each, within 38."""
    types = set()
    for rule in spec.aggregates.values():
        if rule.operator == "sum":
            slot = spec.model.slot_of(rule.over, rule.measure, "measure")
            types.add(spec.model.column_type(slot))
    if "double" in types:
        return "double"
    sizes = [tuple(map(int, t[8:-1].split(","))) for t in types if t.startswith("decimal")]
    if not sizes:
        return "bigint"
    if "bigint" in types:
        sizes.append((19, 0))
    places = max(s for _, s in sizes)
    whole = max(p - s for p, s in sizes)
    return f"decimal({min(38, whole + places)},{places})"


def source_slots(spec):
    """Column -> slot for all that is read of the entities summed over, but their class."""
    slots = {}
    for rule in spec.aggregates.values():
        wanted = [*rule.by.values(), rule.measure, *rule.where,
                  *(rule.convert.on.values() if rule.convert else [])]
        for name in wanted:
            slots[name] = spec.model.slot_of(rule.over, name, "source").key
    return slots


def contributions(view, spec):
    """(rows, scope checks, conversions): a row for every source entity and aggregate over
    its class, with the keys, the columns later steps look at, and the amount `_m`."""
    model = spec.model
    rules = list(spec.aggregates.values())
    checks = _shared_checks(rules)
    conversions = _shared_conversions(rules)
    slots = source_slots(spec)
    type_keys = {model.type_slot(rule.over).key for rule in rules}
    type_columns = {key: f"_type{i}" for i, key in enumerate(sorted(type_keys))}
    classes = frozenset(c for rule in rules for c in model.descendants(rule.over))
    wide = view.wide({**slots, **{c: k for k, c in type_columns.items()}}, classes)

    kind = _measure_type(spec)
    looked_at = [c for c in [*checks, *(m for cv in conversions for m in cv["matches"])]]
    for n, column in enumerate(looked_at):
        # A column that is a key in every aggregate reading it needs no copy.
        key = next((k for k in spec.keys
                    if all(s is None or s == rules[i].by[k]
                           for i, s in enumerate(column["slots"]))), None)
        everywhere = all(column["slots"])
        column["name"] = key if key and everywhere else f"_look{n}"
        column["copy"] = not (key and everywhere)
    made = []
    for i, rule in enumerate(rules):
        slot = model.slot_of(rule.over, rule.measure, "measure")
        if rule.operator == "count":
            amount = F.when(F.col(rule.measure).isNotNull(), F.lit(1)).cast(kind)
        else:
            amount = F.col(rule.measure).cast(model.column_type(slot)).cast(kind)
        fields = [F.lit(i).alias("_agg")]
        fields += [F.col(rule.by[k]).alias(k) for k in spec.keys]
        fields += [(F.col(c["slots"][i]) if c["slots"][i] else F.lit(None).cast("string"))
                   .alias(c["name"]) for c in looked_at if c["copy"]]
        fields.append(amount.alias("_m"))
        of_class = F.col(type_columns[model.type_slot(rule.over).key]).isin(
            model.descendants(rule.over))
        made.append(F.when(of_class, F.struct(*fields)))
    spread = (wide.select(F.explode(F.array(*made)).alias("_c"))
              .where("_c IS NOT NULL").select("_c.*"))
    return spread, checks, conversions


def _shared_checks(rules):
    """Scope checks, one entry per (class, turn), with the slot each aggregate tests."""
    checks = []
    for i, rule in enumerate(rules):
        taken = set()
        for slot, target in rule.where.items():
            spot = next((n for n, c in enumerate(checks)
                         if c["class"] == target and n not in taken), None)
            if spot is None:
                checks.append({"class": target, "slots": [None] * len(rules)})
                spot = len(checks) - 1
            checks[spot]["slots"][i] = slot
            taken.add(spot)
    return checks


def _shared_conversions(rules):
    """Conversions, one entry per lookup table, whatever source slots meet it."""
    found = {}
    for i, rule in enumerate(rules):
        if not rule.convert:
            continue
        cv = rule.convert
        entry = found.setdefault(
            (cv.using, tuple(sorted(cv.on)), cv.factor, cv.factor_type),
            {"rule": cv, "on": sorted(cv.on),
             "matches": [{"slots": [None] * len(rules)} for _ in cv.on]})
        for match, theirs in zip(entry["matches"], entry["on"]):
            match["slots"][i] = cv.on[theirs]
    return list(found.values())


def _apply_scopes(view, spec, partial, checks, near=None):
    """Every aggregate that states a check keeps only values of the class. Subjects of
    a class are unique, so meeting them is an inner join; unlike a semi-join it is
    not moved below the partial sums. A check only some aggregates make is a flag
    and a filter. Before the first check of the column `near` the sums are dealt by it."""
    failing = []
    for n, check in enumerate(checks):
        if check["name"] == near and all(c["name"] != near for c in checks[:n]):
            partial = partial.repartition(near)
        inside = members(view, spec.model, check["class"]).select(
            F.col("subject").alias(check["name"]))
        if all(check["slots"]):
            partial = partial.join(inside, check["name"])
        else:
            partial = partial.join(inside.withColumn(f"_in{n}", F.lit(True)),
                                   check["name"], "left")
            stating = [i for i, s in enumerate(check["slots"]) if s]
            failing.append(F.col("_agg").isin(stating) & F.col(f"_in{n}").isNull())
    if failing:
        partial = partial.where(~reduce(lambda a, b: a | b, failing))
    return partial


def _apply_conversions(view, spec, partial, conversions, near=None):
    """Partial sums with their factor; sums that are dealt by `near` stay where they are."""
    factors = []
    for n, entry in enumerate(conversions):
        table = conversion_table(view, spec.model, entry["rule"])
        names = [m["name"] for m in entry["matches"]]
        renamed = [f"_cv{n}_{j}" for j in range(len(names))]
        table = table.select(*[F.col(t).alias(r) for t, r in zip(entry["on"], renamed)],
                             F.col("_factor").alias(f"_f{n}"))
        used = {i for m in entry["matches"] for i, s in enumerate(m["slots"]) if s}
        # Joined by all columns, sums dealt by one of them would be dealt again.
        met = [F.col(a) == F.col(b) if near not in names or a == near
               else F.col(a).between(F.col(b), F.col(b)) for a, b in zip(names, renamed)]
        if len(used) < len(spec.aggregates):
            met.append(F.col("_agg").isin(sorted(used)))
        partial = partial.join(table, reduce(lambda a, b: a & b, met), "left").drop(*renamed)
        factors.append(F.col(f"_f{n}"))
    if conversions:
        # A decimal product keeps its digits only within 38; fix both sides' sizes.
        partial = partial.withColumn(
            "_f", F.coalesce(*factors,
                             F.lit(1).cast(conversions[0]["rule"].factor_type)))
        kind = dict(partial.dtypes)["_m"]
        if kind.startswith("decimal"):
            scale = kind.split(",")[1].rstrip(")")
            partial = partial.withColumn("_m", F.col("_m").cast(f"decimal(24,{scale})"))
    return partial


def conversion_table(view, model, cv) -> DataFrame:
    """(matched slots…, _factor) of a conversion class; rows lacking any part match
    nothing. Two rows for one match multiply the rows they meet, as stated facts do:
    `quality.unique_violations` is the guard."""
    slots = {name: model.slot_of(cv.using, name, "convert").key for name in [*cv.on, cv.factor]}
    held = view.of_class(model.type_slot(cv.using).key, model.descendants(cv.using), slots)
    return (held.select(*cv.on, F.col(cv.factor).cast(cv.factor_type).alias("_factor"))
            .where(reduce(lambda a, b: a & b,
                          [F.col(c).isNotNull() for c in [*cv.on, "_factor"]])))


def _finish(view, spec, totals):
    """Parameters, expressions, unfilled columns, in the table's column order."""
    model = spec.model
    by_key = {}
    for name, rule in spec.parameters.items():
        by_key.setdefault(rule.of, []).append((name, rule))
    out = totals
    for key, rules in by_key.items():
        found = [(name, _parameter_slot(model, rule)) for name, rule in rules]
        looked_up = view.wide({name: slot.key for name, slot in found}).select(
            F.col("subject").alias(key),
            *[_cast(F.col(n), model.column_type(s), False).alias(n) for n, s in found])
        out = out.join(looked_up, key, "left")
    for name, rule in spec.columns.items():
        if hasattr(rule, "type") and name not in out.columns and name not in spec.expressions:
            out = out.withColumn(name, F.lit(None).cast(rule.type))
    out = derive(out, spec.expressions, spec.order)
    return out.select(*spec.columns)


def _parameter_slot(model, rule):
    for c in model.descendants(rule.of_class):
        for slot in model.slots_of(c):
            if slot.name == rule.slot:
                return slot
    raise KeyError(rule.slot)


def derive(df, expressions, order=None) -> DataFrame:
    """Adds derived columns, each after the ones it reads."""
    for name in order or list(expressions):
        df = df.withColumn(name, arithmetic(expressions[name], dict(df.dtypes)))
    return df


def project(view, spec) -> DataFrame:
    return entities(view, spec) if isinstance(spec, EntitySpec) else grouped(view, spec)


def group_keys(frames, keys) -> DataFrame:
    """Distinct union of the key combinations of several aggregates."""
    return reduce(lambda a, b: a.unionByName(b),
                  [f.select(*keys).distinct() for f in frames]).distinct()


# ---- reading a derived table ----------------------------------------------

def in_key_order(df, keys):
    return df.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def containing(df, filters: dict) -> DataFrame:
    """Rows whose columns contain the given texts, case aside; NULL never matches."""
    for column, text in filters.items():
        df = df.where(F.lower(F.col(column).cast("string")).contains(str(text).lower()))
    return df


def only(df, chosen: dict) -> DataFrame:
    """Rows equal to the chosen values; an empty choice keeps all."""
    for column, value in chosen.items():
        if value not in (None, ""):
            df = df.where(F.col(column).cast("string") == value)
    return df


def choices(df, columns) -> DataFrame:
    """(column, choice): the distinct values each column holds."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("choice"))
                      for c in columns])
    return (df.select(F.explode(cells).alias("c")).select("c.*")
            .where("choice IS NOT NULL").distinct())


def labelled(df, columns, labels) -> DataFrame:
    """URIs replaced by labels (entity_uri, label); unlabelled ones stay."""
    for c in columns:
        side = labels.select(F.col(IDENTITY).alias("_uri"), F.col("label").alias("_label"))
        df = (df.join(side, F.col(c) == F.col("_uri"), "left")
              .withColumn(c, F.coalesce("_label", c)).drop("_uri", "_label"))
    return df


def labels_of(view, model, class_name) -> DataFrame:
    """(entity_uri, label) by the class's identifying slot."""
    slot = model.identifier(class_name)
    if slot is None:
        return members(view, model, class_name).select(
            F.col("subject").alias(IDENTITY), F.lit(None).cast("string").alias("label"))
    held = view.of_class(model.type_slot(class_name).key, model.descendants(class_name),
                         {"label": slot.key})
    return held.select(F.col("subject").alias(IDENTITY), "label")


def user_sort(df, column, descending=False, ties=()) -> DataFrame:
    """Numbers by value, other text as 0 and then by its lower-cased self, blanks last
    in both directions."""
    text = F.col(column).cast("string")
    number = text.try_cast("double")
    by = [F.coalesce(number, F.lit(0.0)),
          F.when(number.isNull(), F.lower(text)).otherwise(F.lit(""))]
    order = [F.col(column).isNull().asc()]
    order += [c.desc() if descending else c.asc() for c in by]
    return df.orderBy(*order, *ties)


def cell_sources(table, spec) -> DataFrame:
    """(cells) of a derived table that were read from one fact: the row's keys, the
    column, and the (subject, slot) pair behind it."""
    if isinstance(spec, EntitySpec):
        keys = [IDENTITY]
        reads = [(s.name, IDENTITY, s.key) for s in spec.columns]
    else:
        keys = spec.keys
        reads = [(n, r.of, _parameter_slot(spec.model, r).key)
                 for n, r in spec.parameters.items()]
    cells = F.array(*[F.struct(F.lit(name).alias("column"), F.col(of).alias("subject"),
                               F.lit(slot).alias("slot")) for name, of, slot in reads])
    return (table.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*")
            .where("subject IS NOT NULL"))

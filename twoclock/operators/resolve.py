"""What stood at two clocks.

A claims frame has `id, seq, subject, slot, value, valid_from, recorded_at,
revokes`. The kernel's assertion table, keyed by entity ids, is turned into one
by `as_claims` or, with URIs looked up, by `stated`.

Two plans answer the same question and the caller picks by shape of the result:

* `standing` keeps one row per (subject, slot). Its `row_number() = 1` filter
  gives a `WindowGroupLimit` on the map side, so of a hot pair only one row per
  map task is shuffled.
* `standing_wide` resolves and pivots in a single aggregation by subject: the
  largest (rank, value) per wanted slot, combined on the map side, one shuffle for both steps
  and one row per subject and map task whatever the subject's size.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.clocks import instant, instant_column
from ..session import kept
from .versions import version_as_of  # noqa: F401  (part of this module's interface)

RANK = ("valid_from", "recorded_at", "seq")


def _clock(df, column, clock):
    return instant_column(clock, df.schema[column].dataType)


def visible(df, valid_at, as_of) -> Column:
    return ((F.col("valid_from") <= _clock(df, "valid_from", valid_at))
            & (F.col("recorded_at") <= _clock(df, "recorded_at", as_of)))


def states_something(df) -> Column:
    """Exactly one value. A claim that revokes and replaces states something; a
    pure retraction does not."""
    if "value_ref" in df.columns:
        return F.col("value_literal").isNotNull() != F.col("value_ref").isNotNull()
    return F.col("value").isNotNull()


def as_claims(assertions: DataFrame) -> DataFrame:
    """Assertion rows under the names used here; ids stay ids, both value columns
    are kept."""
    return (assertions.withColumnRenamed("subject_id", "subject")
            .withColumnRenamed("predicate_id", "slot"))


def revoked_ids(claims: DataFrame, as_of) -> DataFrame:
    """Ids withdrawn by something already recorded at `as_of`, for an anti-join. The
    revoker's own fate and `valid_from` do not matter, and it may belong to any pair."""
    return (claims.where(F.col("revokes").isNotNull()
                         & (F.col("recorded_at") <= _clock(claims, "recorded_at", as_of)))
            .select(F.col("revokes").alias("id")))


def withdrawn_ids(revocations: DataFrame, as_of) -> DataFrame:
    """The same from an index of revocations, or a part of one."""
    return (revocations.where(F.col("revoked_at") <= _clock(revocations, "revoked_at", as_of))
            .select("id"))


def not_withdrawn(claims, withdrawn) -> DataFrame:
    """`claims` without the withdrawn (slot, subject, id) of an index. Only claims in slots
    that have any are met by id; the others go no further than their scan. Slots are a
    closed list, so their names are collected."""
    slots = [r["slot"] for r in withdrawn.select("slot").distinct().collect()
             if r["slot"] is not None]
    if not slots:
        return claims
    doubted = F.coalesce(F.col("slot").isin(slots), F.lit(False))
    return claims.where(~doubted).unionByName(
        claims.where(doubted).join(withdrawn.select("id"), "id", "left_anti")
        .select(*claims.columns))


def candidates(claims, valid_at, as_of, slots=None, revoking=None,
               revocations=None) -> DataFrame:
    """Claims in the running at the two clocks. `slots` reaches the scan, where a
    log laid out by slot prunes whole folders. Where `claims` is only part of a log,
    `revoking` is the whole of it: any row may revoke any other. With an index,
    `revocations`, only the folders of the wanted slots are read of that too."""
    wanted = claims if slots is None else claims.where(F.col("slot").isin(list(slots)))
    held = wanted.where(visible(claims, valid_at, as_of) & states_something(claims))
    if revocations is None:
        return held.join(revoked_ids(claims if revoking is None else revoking, as_of),
                         "id", "left_anti")
    known = revocations.where(
        F.col("revoked_at") <= _clock(revocations, "revoked_at", as_of))
    if slots is not None:
        known = known.where(F.col("slot").isin(list(slots)))
    return not_withdrawn(held, known)


def _newest(keys):
    return W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in RANK])


def standing(claims, valid_at, as_of, slots=None, revocations=None) -> DataFrame:
    """The winner of every (subject, slot)."""
    return (candidates(claims, valid_at, as_of, slots, revocations=revocations)
            .withColumn("_place", F.row_number().over(_newest(["subject", "slot"])))
            .where("_place = 1").drop("_place"))


def standing_by_aggregate(claims, valid_at, as_of, slots=None) -> DataFrame:
    """`standing` computed a second way, to compare against: one `max_by` per pair."""
    held = candidates(claims, valid_at, as_of, slots)
    row = F.struct(*[c for c in held.columns if c not in ("subject", "slot")])
    won = held.groupBy("subject", "slot").agg(
        F.max_by(row, F.struct(*RANK)).alias("_row"))
    return won.select("subject", "slot", "_row.*").select(*held.columns)


def standing_of(claims, pairs, valid_at, as_of, revocations=None) -> DataFrame:
    """`standing` for the given pairs only: a frame with `subject`, `slot` or both. Without
    an index, revocations are read from the whole log, since they may cross pairs; with
    one, those of the given pairs."""
    keys = [k for k in ("subject", "slot") if k in pairs.columns]
    wanted = pairs.select(*keys).distinct()
    held = claims.join(wanted, keys, "left_semi")
    gone = revoked_ids(claims, as_of) if revocations is None else withdrawn_ids(
        revocations.join(wanted, keys, "left_semi"), as_of)
    held = (held.where(visible(claims, valid_at, as_of) & states_something(claims))
            .join(gone, "id", "left_anti"))
    return (held.withColumn("_place", F.row_number().over(_newest(["subject", "slot"])))
            .where("_place = 1").drop("_place"))


def resolve_point(claims, subject, slot, valid_at, as_of, revocations=None) -> DataFrame:
    """One pair; the key filter is pushed below the join, to the scan of the log and, with
    an index, to that of the revocations: nothing of another pair is read."""
    def of_pair(df):
        return df.where((F.col("subject") == subject) & (F.col("slot") == slot))

    gone = revoked_ids(claims, as_of) if revocations is None else withdrawn_ids(
        of_pair(revocations), as_of)
    held = (of_pair(claims).where(visible(claims, valid_at, as_of) & states_something(claims))
            .join(gone, "id", "left_anti"))
    return held.orderBy(*[F.col(c).desc() for c in RANK]).limit(1)


def clock_grid(claims, clocks, slots=None, revocations=None) -> DataFrame:
    """`standing` at many clock pairs, `clocks` being a list of (valid_at, as_of) that its
    caller wrote down.

    The moments of the list cut both clocks into steps. A claim can win from the step it
    becomes valid in, between the step it is learned in and the one it is withdrawn in:
    a rectangle of whole steps. Of the claims of a pair with one rectangle only the newest
    can win, so before anything is shuffled a pair is down to as many rows as there are
    rectangles, however long its history; no row is made for a claim and a clock. The
    rows of a pair, newest first, then meet the clocks within one row: the first rectangle
    around a clock is the winner there, and one row leaves for every pair and clock that
    has one.
    """
    va_type = claims.schema["valid_from"].dataType
    ra_type = claims.schema["recorded_at"].dataType
    if not clocks:
        return claims.limit(0).withColumns({"valid_at": F.lit(None).cast(va_type),
                                            "as_of": F.lit(None).cast(ra_type)})
    pairs = [(instant(va), instant(ao)) for va, ao in clocks]
    valid_steps, known_steps = (sorted({p[k] for p in pairs}) for k in (0, 1))
    withdrawn = (
        claims.where(F.col("revokes").isNotNull()).groupBy(F.col("revokes").alias("id"))
        .agg(F.min("recorded_at").alias("_revoked_at")) if revocations is None else
        (revocations if slots is None else revocations.where(F.col("slot").isin(list(slots))))
        .groupBy("id").agg(F.min("revoked_at").alias("_revoked_at")))
    wanted = claims if slots is None else claims.where(F.col("slot").isin(list(slots)))
    last = [instant_column(steps[-1], t) for steps, t in
            ((valid_steps, va_type), (known_steps, ra_type))]
    held = (wanted.where(states_something(claims) & (F.col("valid_from") <= last[0])
                         & (F.col("recorded_at") <= last[1]))
            .join(withdrawn, "id", "left"))

    def step(column, steps, type_):
        """The first step whose moment is not before the column."""
        return sum((F.when(F.col(column) > instant_column(m, type_), 1).otherwise(0)
                    for m in steps), F.lit(0))

    held = held.withColumns({
        "_valid": step("valid_from", valid_steps, va_type),
        "_known": step("recorded_at", known_steps, ra_type),
        "_gone": F.when(F.col("_revoked_at").isNull(), len(known_steps)).otherwise(
            step("_revoked_at", known_steps, ra_type))}).where("_known < _gone")
    rectangle = ["subject", "slot", "_valid", "_known", "_gone"]
    newest = (held.withColumn("_place", F.row_number().over(_newest(rectangle)))
              .where("_place = 1"))
    rest = [c for c in claims.columns if c not in ("subject", "slot")]
    row = F.struct(*[F.col(c).alias(f"r{n}") for n, c in enumerate(RANK)],
                   *[F.col(c).alias(f"c{n}") for n, c in enumerate(rest)],
                   *rectangle[2:])
    by_pair = newest.groupBy("subject", "slot").agg(
        F.sort_array(F.collect_list(row), asc=False).alias("_rows"))
    asked = F.array(*[F.struct(
        instant_column(va, va_type).alias("valid_at"), instant_column(ao, ra_type).alias("as_of"),
        F.lit(valid_steps.index(va)).alias("valid"), F.lit(known_steps.index(ao)).alias("known"))
        for va, ao in dict.fromkeys(pairs)])
    won = F.transform(asked, lambda k: F.struct(
        k["valid_at"].alias("valid_at"), k["as_of"].alias("as_of"),
        F.get(F.filter("_rows", lambda r: (r["_valid"] <= k["valid"])
                       & (r["_known"] <= k["known"]) & (r["_gone"] > k["known"])),
              F.lit(0)).alias("row")))
    return (by_pair.select("subject", "slot", F.explode(won).alias("_won"))
            .where("_won.row is not null")
            .select(*[F.col(c) if c in ("subject", "slot") else
                      F.col(f"_won.row.c{rest.index(c)}").alias(c) for c in claims.columns],
                    "_won.valid_at", "_won.as_of"))


def standing_wide(claims, slots: dict, valid_at, as_of, revoking=None,
                  revocations=None) -> DataFrame:
    """One row per subject, one text column per entry of `slots` (column -> slot)."""
    held = candidates(claims, valid_at, as_of, sorted(set(slots.values())), revoking,
                      revocations)
    newest = F.struct(*RANK, "value")
    return held.groupBy("subject").agg(*[
        F.max(F.when(F.col("slot") == slot, newest)).getField("value").alias(name)
        for name, slot in slots.items()])


def pivot_packs(packs, slots: dict, wanted, rank, withdrawn, alone=(), undone=None) -> DataFrame:
    """One row per subject holding any of `slots` (column -> slot): of each the value of the
    claim that is largest by (rank, value), of those that `wanted` (a condition on a claim)
    takes and the index rows `withdrawn` do not name.

    `packs` lists pairs (rows, claims): `rows` has `subject`, and `claims` says for a slot
    which columns of a row, structs or NULL, are its claims. A subject may have many rows.
    A row gives at once the largest claim it has of a slot, or, in a slot where claims were
    withdrawn, all it has with their ids; so a row is shuffled once for all its slots,
    together with the subject's withdrawn ids, and no claim on its own. All rows of one
    subject meet in one task.

    `alone` lists such pairs, too, of rows that hold all claims of their subject, which no
    other row has. They are pivoted where they stand, without a shuffle; `undone`, a condition
    on a claim, tells those withdrawn."""
    held = [_in_place(df, claims, slots, wanted, rank, undone) for df, claims in alone]
    if packs or not held:
        held.append(_pivot_shuffled(packs, slots, wanted, rank, withdrawn))
    return reduce(lambda a, b: a.unionByName(b), held)


def _ranked(claim, when, rank, *more):
    return F.when(when & claim["value"].isNotNull(), F.struct(
        *[claim[k].alias(k) for k in (*rank, "value", *more)]))


def _in_place(df, claims, slots, wanted, rank, undone):
    found = {}
    for slot in set(slots.values()):
        held = [(c, wanted(c) & ~F.coalesce(undone(c), F.lit(False)))
                for c in claims.get(slot, [])]
        if len(held) == 1:
            found[slot] = F.when(held[0][1], held[0][0]["value"])
        else:
            found[slot] = (_largest([_ranked(c, when, rank) for c, when in held])["value"]
                           if held else F.lit(None).cast("string"))
    return (df.select("subject", *[found[slot].alias(name) for name, slot in slots.items()])
            .where(F.coalesce(*slots).isNotNull()))


def _pivot_shuffled(packs, slots, wanted, rank, withdrawn):
    asked = sorted(set(slots.values()))
    withdrawn = withdrawn.where(F.col("slot").isin(asked))
    doubted = {r["slot"] for r in withdrawn.select("slot").distinct().collect()}
    columns = {}

    def ranked(claim, when, *more):
        return _ranked(claim, when, rank, *more)

    def cells(claims):
        for i, slot in enumerate(asked):
            held = claims.get(slot, [])
            if slot in doubted:
                held = [ranked(c, wanted(c), "id") for c in held]
            elif held:
                held = [_largest([ranked(c, wanted(c)) for c in held])]
            for j, cell in enumerate(held):
                columns.setdefault(slot, {})[f"_c{i}_{j}"] = True
                yield cell.alias(f"_c{i}_{j}")

    def anything(df):
        return df.where(reduce(lambda a, b: a | b, [
            F.col(c).isNotNull() for c in df.columns if c.startswith("_c")], F.lit(False)))

    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        anything(df.select("subject", *cells(claims))) for df, claims in packs])
    rows = rows.repartition("subject")
    if doubted:
        gone = withdrawn.groupBy("subject").agg(F.collect_set("id").alias("_gone"))
        rows = rows.join(gone, "subject", "left")
        stays = {s: [ranked(F.col(c), ~F.coalesce(F.array_contains("_gone", F.col(c)["id"]),
                                                  F.lit(False))) for c in columns.get(s, {})]
                 for s in doubted}
        rows = anything(rows.select("subject", *[
            F.col(c) for s, held in columns.items() if s not in doubted for c in held], *[
            _largest(claims).alias(next(iter(columns[s]))) for s, claims in stays.items()
            if claims]))
    place = {s: next(iter(held)) for s, held in columns.items()}
    won = rows.groupBy("subject").agg(*[
        F.max(c).getField("value").alias(c) for c in place.values()] or [F.lit(None)])
    return won.select("subject", *[
        (F.col(place[s]) if s in place else F.lit(None).cast("string")).alias(name)
        for name, s in slots.items()])


def _largest(values):
    return values[0] if len(values) == 1 else F.greatest(*values)


def standing_packs(packs, slots: dict, valid_at, as_of, revocations, alone=()) -> DataFrame:
    """`standing_wide` of a log whose claims come packed by subject, see `pivot_packs`."""
    kind = revocations.schema["revoked_at"].dataType
    at, known = instant_column(valid_at, kind), instant_column(as_of, kind)
    return pivot_packs(
        packs, slots, lambda c: (c["valid_from"] <= at) & (c["recorded_at"] <= known), RANK,
        revocations.where(F.col("revoked_at") <= known), alone,
        lambda c: c["revoked"] & (c["revoked_at"] <= known))


def _winner(claims, valid_at, as_of) -> Column:
    """The winner among the claims of one pair that one row holds, ranked."""
    at, known = instant_column(valid_at), instant_column(as_of)
    return _largest([
        _ranked(c, (c["valid_from"] <= at) & (c["recorded_at"] <= known)
                & ~F.coalesce(c["revoked"] & (c["revoked_at"] <= known), F.lit(False)), RANK)
        for c in claims])


def standing_alone(packs, valid_at, as_of, keep=()) -> DataFrame:
    """(subject, slot, value, *RANK), with columns `keep` of the rows: the winner of every pair
    of subjects whose row holds all claims of theirs, as `alone` of `pivot_packs`. It is found
    where the row stands, and nothing is shuffled. None for no packs."""
    made = []
    for rows, claims in (pack for pack in packs if pack[1]):
        won = F.array(*[F.struct(F.lit(slot).alias("slot"), _winner(
            held, valid_at, as_of).alias("won")) for slot, held in sorted(claims.items())])
        made.append(rows.select("subject", *keep, F.explode(won).alias("_c"))
                    .where("_c.won IS NOT NULL")
                    .select("subject", *keep, "_c.slot", "_c.won.*"))
    return reduce(lambda a, b: a.unionByName(b), made) if made else None


# ---- identities -----------------------------------------------------------

class PackedEntities:
    """Assertions of entities whose row holds all there is of them, their own registration
    under the predicate `naming` included. They come with URIs, of which `identity` makes the
    ids. `read(slots)`, None for all, gives packs as `standing_alone` takes them; `refs` are
    the slots whose values name entities. `uris` is a frame (uri) of at least all that the
    rows refer to, as a slot or as a value.

    An id mostly is named as the URI it was made of. So each URI meets the names once, and
    rows meet only those `_odd` ones that are named otherwise or not at all."""

    def __init__(self, read, naming, refs, uris, identity=F.md5):
        self.read, self.naming, self.refs = read, naming, list(refs)
        self.uris, self.identity = uris, identity

    def _odd(self, names):
        """(uri, name) of URIs whose id has another name, or none, in `names` (id, name)."""
        return kept(self.uris.select("uri", self.identity("uri").alias("_id"))
                    .join(names.select(F.col("id").alias("_id"), "name"), "_id", "left")
                    .where(~F.col("uri").eqNullSafe(F.col("name")))
                    .select("uri", "name", F.lit(True).alias("_is_odd")))

    def _packs(self, own, slots=None):
        """Packs with the id of the subject and its name `_own`, which `own` finds in the
        claims that name it."""
        return [(rows.withColumns({"_own": own(claims[self.naming]),
                                   "_id": self.identity("subject")}),
                 {s: c for s, c in claims.items() if slots is None or s in slots})
                for rows, claims in self.read(slots)]

    def _named(self, won, odd, column, out, when=None):
        """Adds what the URI in a column is named, NULL if it is not."""
        side = odd.select(F.col("uri").alias("_uri"), F.col("name").alias("_name"), "_is_odd")
        met = F.col(column) == F.col("_uri")
        return (won.join(side, met if when is None else met & when, "left")
                .withColumn(out, F.when(F.col("_is_odd"), F.col("_name"))
                            .otherwise(F.col(column))).drop("_uri", "_name", "_is_odd"))

    def stated(self, names, naming, valid_at, as_of, slots=None):
        """As `stated`, of these entities, with the names of all others."""
        odd = self._odd(names)
        if slots is not None:
            other = odd.where(F.col("name").isin(list(slots)) | F.col("uri").isin(list(slots)))
            other = {r["uri"]: r["name"] for r in other.collect()}
            slots = sorted({s for s in slots if s not in other}
                           | {uri for uri, name in other.items() if name in slots})

        def own(claims):
            first = F.array_min(F.array(*[F.when(c["value"].isNotNull(), F.struct(
                c["seq"].alias("seq"), c["value"].alias("value"))) for c in claims]))
            return F.when(naming == self.identity(F.lit(self.naming)), first["value"])

        won = standing_alone(self._packs(own, slots), valid_at, as_of, ["_own", "_id"])
        if won is None:
            return None
        points = F.col("slot").isin(self.refs)
        won = self._named(self._named(won, odd, "slot", "_slot"), odd, "value", "_value", points)
        return won.where(F.col("_slot").isNotNull()).select(
            F.col("_id").alias("subject_id"), F.col("_own").alias("subject"),
            F.col("_slot").alias("slot"), F.col("_value").alias("value"))

    def replay(self, labels, labelling, valid_at, as_of):
        """As `replay`, of these entities, with the labels of all others."""
        odd = self._odd(labels)

        def bare(column):
            return F.concat(F.lit("<"), self.identity(column), F.lit(">"))

        def own(claims):
            return F.when(labelling == self.identity(F.lit(self.naming)),
                          _winner(claims, valid_at, as_of)["value"])

        won = standing_alone(self._packs(own), valid_at, as_of, ["_own", "_id"])
        if won is None:
            return None
        points = F.col("slot").isin(self.refs)
        won = self._named(self._named(won, odd, "slot", "_slot"), odd, "value", "_value", points)
        own_label = bare("_own") if self.naming in self.refs else F.col("_own")
        return won.select(
            F.coalesce(own_label, F.concat(F.lit("<"), "_id", F.lit(">"))).alias("subject"),
            F.coalesce("_slot", bare("slot")).alias("predicate"),
            F.when(points, F.concat(F.lit("-> "), F.coalesce("_value", bare("value"))))
            .otherwise(F.col("value")).alias("value"), "valid_from", "recorded_at", "seq")


def _naming(assertions, registry_uri) -> Column:
    """The id of the predicate that registers itself."""
    return (assertions.where((F.col("subject_id") == F.col("predicate_id"))
                             & (F.col("value_literal") == registry_uri))
            .agg(F.min_by("subject_id", "seq").alias("id")).scalar())


def registry(assertions, registry_uri) -> DataFrame:
    """(entity_id, uri): the first URI each entity was registered under, whatever
    the clocks. The registering predicate is the one that registers itself."""
    return (assertions.where((F.col("predicate_id") == _naming(assertions, registry_uri))
                             & F.col("value_literal").isNotNull())
            .groupBy(F.col("subject_id").alias("entity_id"))
            .agg(F.min_by("value_literal", "seq").alias("uri")))


def _spread_nulls():
    """`value_ref` to join on. Most claims are literals; their NULLs would all hash to
    one task, so they meet nothing under many keys of their own."""
    return F.coalesce("value_ref", F.concat(
        F.lit("\u0000"), F.pmod(F.xxhash64("subject_id"), F.lit(1 << 20)).cast("string")))


def _standing_ids(assertions, gone, valid_at, as_of, more=()) -> DataFrame:
    """The winner of every (subject_id, predicate_id), of claims that `gone` (id) leaves."""
    held = (assertions.where(visible(assertions, valid_at, as_of)
                             & states_something(assertions))
            .join(gone, "id", "left_anti")
            .select("subject_id", "predicate_id", "value_literal", "value_ref", *RANK, *more))
    return (held.withColumn("_place", F.row_number().over(
                _newest(["subject_id", "predicate_id"])))
            .where("_place = 1").drop("_place"))


def stated(assertions, registry_uri, valid_at, as_of, slots=None, alone=None) -> DataFrame:
    """(subject_id, subject, slot, value) standing at the clocks, ids as URIs.

    Slot names are looked up before resolution: predicates are a closed list, so
    filtering the registry by `slots` first also prunes the log. Names and withdrawn ids
    are written once, so that few of them are broadcast. `alone` (`PackedEntities`) are
    further entities, which nothing in `assertions` speaks of: they are resolved and named
    where they stand.
    """
    naming = _naming(assertions, registry_uri)
    names = kept(registry(assertions, registry_uri))
    # Few entities are predicates: cut the registry down to them, so that no
    # join is keyed by a hot predicate against the whole registry.
    slot_names = names.select(F.col("entity_id").alias("predicate_id"), F.col("uri").alias("_slot"))
    if slots is not None:
        slot_names = slot_names.where(F.col("_slot").isin(list(slots)))
    slot_names = kept(slot_names.join(assertions.select("predicate_id").distinct(),
                                      "predicate_id", "left_semi"))
    assertions_ = assertions if slots is None else assertions.join(
        slot_names.select("predicate_id"), "predicate_id", "left_semi")
    won = _standing_ids(assertions_, kept(revoked_ids(assertions, as_of)), valid_at, as_of)
    found = (won.join(slot_names, "predicate_id").withColumn("_points_at", _spread_nulls())
             .join(names.select(F.col("entity_id").alias("_points_at"),
                                F.col("uri").alias("_ref")), "_points_at", "left")
             .join(names.select(F.col("entity_id").alias("subject_id"),
                                F.col("uri").alias("subject")), "subject_id", "left")
             .select("subject_id", "subject", F.col("_slot").alias("slot"),
                     F.coalesce("_ref", "value_literal").alias("value")))
    more = None if alone is None else alone.stated(
        names.select(F.col("entity_id").alias("id"), F.col("uri").alias("name")), naming,
        valid_at, as_of, slots)
    return found if more is None else found.unionByName(more)


def latest_class(claims, type_slot, alone=None) -> DataFrame:
    """Class last written for each subject by a row that revokes nothing: the loose
    rule that routes a correction, blind to both clocks. `alone` are further claims, whose
    subjects have one claim of a class each and none in `claims`: they meet nothing."""
    def held(df):
        return df.where((F.col("slot") == type_slot) & F.col("revokes").isNull())

    last = held(claims).groupBy("subject").agg(F.max_by("value", "seq").alias("class"))
    return last if alone is None else last.unionByName(
        held(alone).select("subject", F.col("value").alias("class")))


def replay(assertions, label_literal, valid_at, as_of, alone=None) -> DataFrame:
    """Current value of every pair with labels read from the log itself.

    The labelling predicate is the one labelled by itself. What has no label shows
    as `<id>`; a reference shows as `-> label`. `alone` as in `stated`, of a log without
    a column `source`.
    """
    labelling = _naming(assertions, label_literal)
    gone = kept(revoked_ids(assertions, as_of))
    source = ["source"] if "source" in assertions.columns else []
    won = _standing_ids(assertions, gone, valid_at, as_of, source)
    labels = kept(
        _standing_ids(assertions.where(F.col("predicate_id") == labelling), gone, valid_at, as_of)
        .select(F.col("subject_id").alias("id"),
                F.coalesce("value_literal",
                           F.concat(F.lit("<"), "value_ref", F.lit(">"))).alias("name")))
    used = kept(labels.join(assertions.select(F.col("predicate_id").alias("id")).distinct(),
                            "id", "left_semi"))

    def named(df, column, out):
        # As in `stated`: the label table is cut to predicates before meeting them.
        held = used if column == "predicate_id" else labels
        side = held.select(F.col("id").alias(column), F.col("name").alias(out))
        return (df.join(side, column, "left").withColumn(
            out, F.coalesce(out, F.concat(F.lit("<"), column, F.lit(">")))))

    out = named(named(named(won.withColumn("_points_at", _spread_nulls()), "predicate_id",
                            "slot_label"), "_points_at", "ref_label"),
                "subject_id", "subject_label")
    found = out.select(
        F.col("subject_label").alias("subject"), F.col("slot_label").alias("predicate"),
        F.when(F.col("value_ref").isNotNull(), F.concat(F.lit("-> "), "ref_label"))
        .otherwise(F.col("value_literal")).alias("value"),
        "valid_from", "recorded_at", "seq", *source)
    more = None if alone is None else alone.replay(labels, labelling, valid_at, as_of)
    found = found if more is None else found.unionByName(more)
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd")
                              for c in ("valid_from", "recorded_at")})


def ever_typed(claims, type_slot, classes, valid_at, as_of) -> DataFrame:
    """Subjects ever said to be of a class, re-resolved at the clocks. Only their
    type claims enter the resolution."""
    typed = claims.where((F.col("slot") == type_slot) & F.col("value").isin(list(classes)))
    won = standing_of(claims.where((F.col("slot") == type_slot)
                                   | F.col("revokes").isNotNull()),
                      typed.select("subject", "slot"), valid_at, as_of)
    return won.where((F.col("slot") == type_slot)
                     & F.col("value").isin(list(classes))).select("subject")

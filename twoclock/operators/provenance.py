"""Who said what, when, and what became of it. Nothing here hides a row.

`claims` is the compact frame with `intent_id`; `intents` has `id, occurred_at,
actor_id, action_name, note`.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import kept
from .ranking import position, running_max_before
from .resolve import RANK


def with_intent(claims, intents) -> DataFrame:
    if intents is None:
        return claims
    acts = intents.select(F.col("id").alias("intent_id"), "actor_id", "action_name",
                          "occurred_at", "note",
                          *[c for c in intents.columns if c == "agent_id"])
    return claims.join(acts, "intent_id")


def with_revoked_by(rows, claims, within_pair=False) -> DataFrame:
    """Adds `revoked_by`. Over the whole log it is the first revoker by `seq`; within a
    pair it is the last of the pair's own revokers in history order."""
    revokers = claims.where(F.col("revokes").isNotNull())
    if within_pair:
        found = (revokers.groupBy("subject", "slot", F.col("revokes").alias("_target"))
                 .agg(F.max_by("id", F.struct(*RANK)).alias("revoked_by"))
                 .withColumnsRenamed({"subject": "_s", "slot": "_p"}))
        met = ((F.col("id") == F.col("_target")) & (F.col("subject") == F.col("_s"))
               & (F.col("slot") == F.col("_p")))
        return rows.join(found, met, "left").drop("_target", "_s", "_p")
    found = (revokers.groupBy(F.col("revokes").alias("_target"))
             .agg(F.min_by("id", "seq").alias("revoked_by")))
    return rows.join(found, F.col("id") == F.col("_target"), "left").drop("_target")


class UnknownURI(LookupError):
    """A URI that the log has never registered."""


def history(claims, intents, pairs, strict=False) -> DataFrame:
    """Everything ever said under the given pairs, whatever the clocks. A pair nobody ever
    spoke of has no rows; with `strict`, a URI of it that the log does not know is an
    error, found by a look at the log before anything is returned."""
    if strict:
        unknown = [r["uri"] for r in unregistered(pairs, claims).orderBy("uri").limit(5).collect()]
        if unknown:
            raise UnknownURI(f"never registered: {', '.join(map(str, unknown))}")
    keys = [k for k in ("subject", "slot") if k in pairs.columns]
    held = claims.join(pairs.select(*keys).distinct(), keys, "left_semi")
    return with_intent(with_revoked_by(held, held, within_pair=True), intents)


def unregistered(pairs, claims) -> DataFrame:
    """The pairs' URIs the log has never registered."""
    named = (pairs.select(F.explode(F.array("subject", "slot")).alias("uri")).distinct())
    known = (claims.select(F.explode(F.array("subject", "slot")).alias("uri")).distinct())
    return named.join(known, "uri", "left_anti")


def trace(claims, intents, subjects) -> DataFrame:
    """All slots of the given subjects; `revoked_by` among the subject's own rows."""
    held = claims.join(subjects.select("subject").distinct(), "subject", "left_semi")
    found = (held.where(F.col("revokes").isNotNull())
             .groupBy(F.col("subject").alias("_s"), F.col("revokes").alias("_target"))
             .agg(F.min_by("id", F.struct(*RANK)).alias("revoked_by")))
    met = (F.col("id") == F.col("_target")) & (F.col("subject") == F.col("_s"))
    return with_intent(held.join(found, met, "left").drop("_target", "_s"), intents)


def oldest_first(rows):
    return rows.orderBy(*RANK)


def newest_first(rows):
    return rows.orderBy(*[F.col(c).desc() for c in RANK])


def steps(rows, pieces=None) -> DataFrame:
    """Adds `step`, the row's place in its pair's history. A pair may be any size."""
    return position(rows, ["subject", "slot"], list(RANK), name="step", pieces=pieces)


# ---- the ledger -----------------------------------------------------------

def recent(claims, intents, k=40, offset=0, kind=None, actor=None, search=None,
           action_groups=None) -> DataFrame:
    """The newest claims by `seq`. Filters come first, then the limit: a search answers
    with k matches and not with whichever of the last k match.

    `kind` is "revocations" (revoking or revoked) or a name in `action_groups`.
    """
    rows = _searched(claims, search)
    asked = None
    if action_groups and kind in action_groups:
        asked = F.col("action_name").isin(list(action_groups[kind]))
    if actor:
        own = F.col("actor_id") == actor
        asked = own if asked is None else asked & own
    if asked is not None:
        acts = intents.where(asked).select(F.col("id").alias("intent_id"))
        rows = rows.join(acts, "intent_id", "left_semi").select(*claims.columns)
    if kind == "revocations":
        withdrawn = claims.where(F.col("revokes").isNotNull()).select(F.col("revokes").alias("id"))
        rows = rows.where(F.col("revokes").isNotNull()).unionByName(
            rows.where(F.col("revokes").isNull()).join(withdrawn, "id", "left_semi")
            .select(*claims.columns))
    return _told(rows.orderBy(F.col("seq").desc()).offset(offset).limit(k), claims, intents)


def _searched(rows, search):
    if not search:
        return rows
    text = search.lower()
    return rows.where(F.lower("subject").contains(text) | F.lower("slot").contains(text)
                      | F.coalesce(F.lower("value").contains(text), F.lit(False)))


def _told(rows, claims, intents):
    """The k rows that were picked, with their intents and first revokers: only they meet
    those. At most k rows are broadcast; neither the log nor the intents are shuffled."""
    if intents is not None:
        acts = intents.join(F.broadcast(rows.select(F.col("intent_id").alias("id")).distinct()),
                            "id", "left_semi")
        rows = with_intent(rows, acts)
    own = claims.where(F.col("revokes").isNotNull()).join(
        F.broadcast(rows.select(F.col("id").alias("revokes")).distinct()), "revokes", "left_semi")
    return with_revoked_by(rows, own)


def status(rows) -> DataFrame:
    """Adds `status`, from `revoked_by`, `revokes` and `value`. A retraction always
    names what it revokes, so it is told apart before corrections are."""
    return rows.withColumn(
        "status",
        F.when(F.col("revoked_by").isNotNull(), "revoked")
        .when(F.col("value").isNull(), "retraction")
        .when(F.col("revokes").isNotNull(), "correction").otherwise("active"))


def event_kind(claims, pieces=None) -> DataFrame:
    """Adds `event`: what kind of act each claim was, in the order things were learned.

    `retract` withdraws and states nothing; `revoke_replace` withdraws and states;
    `change` starts later than anything said before of the pair (the world moved);
    `correct` does not (we were wrong); `state` is the first word on the pair.
    """
    seen = running_max_before(claims, ["subject", "slot"], ["recorded_at", "seq"],
                              "valid_from", "_latest", pieces)
    return seen.withColumn(
        "event",
        F.when(F.col("revokes").isNotNull() & F.col("value").isNull(), "retract")
        .when(F.col("revokes").isNotNull(), "revoke_replace")
        .when(F.col("_latest").isNull(), "state")
        .when(F.col("valid_from") > F.col("_latest"), "change")
        .otherwise("correct")).drop("_latest")


def log_window(claims, intents) -> DataFrame:
    """How much the log holds and between which clocks, in one row."""
    held = claims.agg(
        F.count(F.lit(1)).alias("assertions"),
        F.min("valid_from").alias("first_valid_from"),
        F.max("valid_from").alias("last_valid_from"),
        F.min("recorded_at").alias("first_recorded_at"),
        F.max("recorded_at").alias("last_recorded_at"),
        F.count("revokes").alias("revocations"))
    acts = intents.agg(F.count(F.lit(1)).alias("n"))
    return held.withColumn("intents", acts.scalar())


def correction_target(claims, pairs=None, chosen=None) -> DataFrame:
    """The claim a correction of each pair would withdraw: the chosen id if it is the
    pair's, else the latest unrevoked claim with a value, else the last claim.

    One aggregate over the pair, so a pair of any size is combined on the map side.
    """
    held = claims
    if pairs is not None:
        held = held.join(pairs.select("subject", "slot").distinct(), ["subject", "slot"],
                         "left_semi")
    rows = with_revoked_by(held, held, within_pair=True)
    if chosen is not None:
        # One id may be chosen per pair; several are settled by order of id.
        picks = chosen.select(F.col("id"), F.lit(True).alias("_chosen")).distinct()
        rows = rows.join(picks, "id", "left")
    else:
        rows = rows.withColumn("_chosen", F.lit(None).cast("boolean"))
    grade = (F.when(F.col("_chosen"), 2)
             .when(F.col("revoked_by").isNull() & F.col("value").isNotNull(), 1)
             .otherwise(0))
    best = F.max_by(F.struct("id", "value", "revoked_by"), F.struct(grade, *RANK))
    return rows.groupBy("subject", "slot").agg(best.alias("_b")).select(
        "subject", "slot", F.col("_b.id").alias("target"), F.col("_b.value").alias("value"),
        F.col("_b.revoked_by").alias("revoked_by"))


def known_actors(intents, people) -> DataFrame:
    """Everyone who signed an act, with the person they are where a person's first
    name, lower-cased, is the actor's; and people who never signed anything."""
    actors = intents.where("actor_id IS NOT NULL").select("actor_id").distinct()
    named = people.select(
        F.col("entity_uri"), F.col("label"),
        F.lower(F.split("label", " ")[0]).alias("_first"))
    return (actors.join(named, F.lower("actor_id") == F.col("_first"), "full_outer")
            .select(F.coalesce("actor_id", "_first").alias("actor"), "label", "entity_uri"))


def evidence(cells, claims, intents=None) -> DataFrame:
    """The claims behind derived cells: `cells` carries (subject, slot) pairs and the
    row and column they fill. Cells are read twice and written down first; where they are
    few they are broadcast, and other claims go no further than their scan."""
    cells = kept(cells)
    history_ = history(claims, intents, cells.select("subject", "slot"))
    return cells.join(history_, ["subject", "slot"])

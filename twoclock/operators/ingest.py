"""Bulk ingest: wide rows and corrections become claims, gates set bad rows aside.

Ids are digests of what they name, so re-running a batch writes the same ids and
an anti-join on them makes the append idempotent.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.clocks import instant_column
from ..functions.scalars import stable_id
from ..schema import CONFIDENCE, SOURCES
from ..session import kept
from .ranking import position


# ---- rows to claims -------------------------------------------------------

def melt(df, subject, fields, refs=(), type_slot=None, class_name=None) -> DataFrame:
    """One wide row to one claim per non-empty field.

    `fields` maps column -> slot; fields in `refs` name entities, so their value
    lands in `value_ref`. `class_name` adds the claim saying what the subject is.
    Fields not asked for are never read from the source.
    """
    keep = [c for c in df.columns if c not in fields and c != subject]
    wide = df.select(F.col(subject).alias("subject"), *keep,
                     *[F.col(c).cast("string").alias(c) for c in fields])
    columns = dict(fields)
    if type_slot:
        wide = wide.withColumn("_class", F.lit(class_name))
        columns["_class"] = type_slot
    # One pass over the row: an array of (slot, ref?, value), blanks dropped.
    cells = F.array(*[F.struct(F.lit(slot).alias("slot"),
                               F.lit(c in refs).alias("is_ref"),
                               F.col(c).alias("value")) for c, slot in columns.items()])
    spread = (wide.withColumn("_cell", F.explode(cells))
              .where((F.col("_cell.value").isNotNull()) & (F.col("_cell.value") != "")))
    return spread.select(
        "subject", *keep, F.col("_cell.slot").alias("slot"),
        F.when(~F.col("_cell.is_ref"), F.col("_cell.value")).alias("value_literal"),
        F.when(F.col("_cell.is_ref"), F.col("_cell.value")).alias("value_ref"))


def corrections(fixes, standing_) -> DataFrame:
    """Corrections and retractions. `fixes` has subject, slot, value: the claim now
    standing is withdrawn, with a replacement where `value` is given and with
    nothing in its place where it is NULL. Pairs where nothing stands are refused:
    `correction_rejects` gives them."""
    target = standing_.select("subject", "slot", F.col("id").alias("revokes"))
    return (fixes.join(target, ["subject", "slot"])
            .withColumn("id", stable_id("revokes", F.coalesce("value", F.lit("")),
                                        F.lit("correction"))))


def correction_rejects(fixes, standing_) -> DataFrame:
    """The rows of `fixes` whose pair has no standing claim to withdraw."""
    return fixes.join(standing_.select("subject", "slot").distinct(), ["subject", "slot"],
                      "left_anti")


def append_batch(batch, *, intent_id, occurred_at, recorded_at=None, last_seq=0,
                 batch_order="batch_order", source="imported",
                 ontology_version="v1") -> DataFrame:
    """Assertion rows for one act. `valid_from` defaults to when the act happened,
    `recorded_at` to now; `seq` continues from `last_seq` in batch order. Ids come from
    the act and the batch order, unique in a batch, so a retry after other appends makes
    the same ids, whatever `seq` it gets."""
    when = instant_column(occurred_at)
    rows = batch.withColumn(
        "valid_from", F.coalesce("valid_from", when) if "valid_from" in batch.columns else when)
    rows = rows.withColumn("recorded_at", instant_column(recorded_at))
    rows = assign_seq(rows, batch_order, last_seq)
    for name, default in [("value_literal", None), ("value_ref", None), ("revokes", None),
                          ("confidence", None), ("authority", None)]:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(default).cast("string"))
    if "source" not in rows.columns:
        rows = rows.withColumn("source", F.lit(source))
    return rows.select(
        stable_id(F.lit(intent_id), F.col(batch_order).cast("string")).alias("id"), "seq", "subject_id", "predicate_id",
        "value_literal", "value_ref", "valid_from", "recorded_at", "revokes",
        F.lit(intent_id).alias("intent_id"), "source", "confidence", "authority",
        F.lit(ontology_version).alias("ontology_version"),
        F.lit(None).cast("string").alias("subject_key_id"))


def append_act(batch, *, intent_id, actor_id, action_name, occurred_at, reason_code=None,
               note=None, agent_id=None, **append):
    """(intent, entities, assertions) of one act, to be written in that order: the intent
    as one row, an entity for each subject of `batch` (rows with a true `mint`, or all if
    there is no such column), and the rows of `append_batch`."""
    spark, when = batch.sparkSession, instant_column(occurred_at)
    intent = spark.range(1).select(
        F.lit(intent_id).alias("id"), when.alias("occurred_at"), F.lit(actor_id).alias("actor_id"),
        F.lit(agent_id).cast("string").alias("agent_id"),
        F.lit(action_name).alias("action_name"),
        F.lit(reason_code).cast("string").alias("reason_code"),
        F.lit(note).cast("string").alias("note"))
    minted = batch.where(F.col("mint")) if "mint" in batch.columns else batch
    entities = minted.select(F.col("subject_id").alias("id")).distinct().select(
        "id", when.alias("minted_at"), F.lit(intent_id).alias("intent_id"))
    return intent, entities, append_batch(batch.drop("mint"), intent_id=intent_id,
                                          occurred_at=occurred_at, **append)


def correct_by_id(fixes, claims, *, recorded_at=None):
    """(corrections, rejects) of claims named by their id. `fixes`: claim_id, value (NULL
    withdraws), valid_from (NULL: the target's own), reason. A correction says the same of
    the same pair and revokes its target; a fix whose claim is unknown is a reject."""
    target = claims.select(F.col("id").alias("claim_id"), "subject", "slot",
                           F.col("valid_from").alias("_was"))
    found = fixes.join(target, "claim_id")
    made = found.select(
        stable_id("claim_id", F.coalesce("value", F.lit("")), F.lit("correction")).alias("id"),
        "subject", "slot", "value", F.coalesce("valid_from", "_was").alias("valid_from"),
        instant_column(recorded_at).alias("recorded_at"), F.col("claim_id").alias("revokes"),
        "reason")
    return made, fixes.join(target.select("claim_id"), "claim_id", "left_anti")


def correction_act(fixes, assertions, *, intent_id, actor_id, occurred_at, action_name="correct",
                   reason_code=None, note=None, agent_id=None, **append):
    """(intent, assertions, rejects) of an act that corrects claims named by their id, whole
    rows to be appended in that order. `fixes`: claim_id, value (NULL withdraws), valid_from
    (NULL: the target's own). A correction speaks of the target's pair and says its value
    the way the target did, as a literal or a reference; rows take their `seq`, in the order
    of the claims' ids, from `last_seq` on. A fix of an unknown claim is a reject, and so is
    a second fix of one claim: the first by value and valid_from is made."""
    target = assertions.select(
        F.col("id").alias("claim_id"), "subject_id", "predicate_id",
        F.col("valid_from").alias("_was"), F.col("value_ref").isNotNull().alias("_is_ref"))
    placed = fixes.select("claim_id", "value", "valid_from").withColumn(
        "_turn", F.row_number().over(W.partitionBy("claim_id").orderBy("value", "valid_from")))
    first = placed.where("_turn = 1").drop("_turn")
    made = first.join(target, "claim_id").select(
        "subject_id", "predicate_id", F.when(~F.col("_is_ref"), F.col("value")).alias("value_literal"),
        F.when(F.col("_is_ref"), F.col("value")).alias("value_ref"),
        F.coalesce("valid_from", "_was").alias("valid_from"), F.col("claim_id").alias("revokes"))
    made = made.withColumn("batch_order", F.col("revokes")).withColumn("mint", F.lit(False))
    intent, _, rows = append_act(
        made, intent_id=intent_id, actor_id=actor_id, action_name=action_name,
        occurred_at=occurred_at, reason_code=reason_code, note=note, agent_id=agent_id, **append)
    rejects = (first.join(target.select("claim_id"), "claim_id", "left_anti")
               .unionByName(placed.where("_turn > 1").drop("_turn")))
    return intent, rows, rejects


def assign_seq(batch, batch_order, last_seq=0) -> DataFrame:
    """Dense `seq` in batch order; pieces of the order are numbered side by side."""
    return position(batch, [], [batch_order], name="seq", start=last_seq + 1)


def register_uris(mentions, registry_) -> DataFrame:
    """(entity_id, uri) to mint: mentioned, not yet known, each once. `mentions` has
    one column `uri`, from subjects and from values that name entities alike."""
    return (mentions.where(F.col("uri").isNotNull()).select("uri").distinct()
            .join(registry_.select("uri"), "uri", "left_anti")
            .select(stable_id("uri").alias("entity_id"), "uri"))


# ---- gates ----------------------------------------------------------------

def _first_error(*tests):
    """Message of the first test that fails, else NULL."""
    return F.coalesce(*[F.when(bad, F.lit(message)) for message, bad in tests],
                      F.lit(None).cast("string"))


def constraint_errors(claims) -> DataFrame:
    """Adds `error`: the first row constraint broken, NULL for a sound row."""
    stated = (F.col("value_literal").isNotNull().cast("int")
              + F.col("value_ref").isNotNull().cast("int"))
    blank = reduce(lambda a, b: a | b, [
        F.col(c).isNull() for c in
        ("id", "subject_id", "predicate_id", "valid_from", "recorded_at", "intent_id",
         "source", "ontology_version")])
    return claims.withColumn("error", _first_error(
        ("not_null", blank),
        ("value_exactly_one",
         ~((stated == 1) | ((stated == 0) & F.col("revokes").isNotNull()))),
        ("confidence_levels",
         F.col("confidence").isNotNull() & ~F.col("confidence").isin(CONFIDENCE)),
        ("source_known", ~F.col("source").isin(SOURCES))))


def split_valid(checked):
    """(sound rows, quarantine)."""
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def fact_errors(facts, slots) -> DataFrame:
    """Adds `error` and `is_ref` to stated facts (subject, predicate, value,
    confidence). `slots` is the vocabulary: (predicate, is_ref)."""
    known = slots.select("predicate", F.col("is_ref")).distinct()
    return (facts.join(known, "predicate", "left")
            .withColumn("error", _first_error(
                ("missing_key", F.col("subject").isNull() | F.col("predicate").isNull()),
                ("bad_confidence",
                 F.col("confidence").isNotNull() & ~F.col("confidence").isin(CONFIDENCE)),
                ("unknown_predicate", F.col("is_ref").isNull()),
                ("no_value", F.col("value").isNull()))))


def dangling_references(assertions, entities, intents, alone=None) -> DataFrame:
    """Every reference to something that is not there: (reference, claim, missing).

    References to one kind of thing are spread in one pass and met with the known ids of
    that kind. Ids referred to over and over are looked up once; the missing ones are written
    down and joined back, so that few of them are broadcast.

    `alone` are further assertions whose subjects are entities that no other row refers to, of
    acts that are there, and which withdraw none but each other: `entities` and `intents`
    need not hold those, and only what else they refer to is looked up.
    """
    found = []
    for names, known in ((["subject_id", "predicate_id", "value_ref"], entities),
                         (["revokes"], assertions), (["intent_id"], intents)):
        asked = _references(assertions, names)
        if alone is not None and "value_ref" in names:
            asked = asked.unionByName(_references(alone, ["predicate_id", "value_ref"]))
        gone = kept(asked.select("missing").distinct().join(
            known.select(F.col("id").alias("missing")), "missing", "left_anti"))
        found.append(asked.join(gone, "missing", "left_semi"))
    return reduce(lambda a, b: a.unionByName(b), found).select("reference", "claim", "missing")


def _references(assertions, names):
    links = F.array(*[F.struct(F.lit(name).alias("reference"), F.col(name).alias("missing"))
                      for name in names])
    return (assertions.select(F.col("id").alias("claim"), F.explode(links).alias("l"))
            .select("claim", "l.*").where("missing IS NOT NULL"))


def append_only_summary(previous, current) -> DataFrame:
    """Proof that nothing was updated or deleted: every earlier row must still be in
    the log, unchanged. One summary row (check, counted, failed)."""
    columns = previous.columns
    tagged = (previous.select(*columns, F.lit(1).alias("_was"), F.lit(0).alias("_is"))
              .unionByName(current.select(*columns, F.lit(0).alias("_was"),
                                          F.lit(1).alias("_is"))))
    per_row = tagged.groupBy(*columns).agg(F.sum("_was").alias("_was"),
                                           F.sum("_is").alias("_is"))
    return per_row.agg(
        F.lit("append_only").alias("check"),
        F.coalesce(F.sum("_was"), F.lit(0)).alias("counted"),
        F.coalesce(F.sum(F.greatest(F.col("_was") - F.col("_is"), F.lit(0))), F.lit(0))
        .alias("failed"))

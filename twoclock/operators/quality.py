"""Checks over tables. Each gives failures as (check, subject, detail) and knows how
many rows it looked at; `summary` puts several together."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from ..sources.ledger import PARTS, multiset


def _failures(df, check, subject, detail):
    return df.select(F.lit(check).alias("check"), subject.cast("string").alias("subject"),
                     detail.alias("detail"))


def mass_balance(outputs, weights, inputs, tolerance=0.005) -> DataFrame:
    """Batches putting out more than went in: Σ units · weight · share against input
    plus allowance, as (batch, out, allowed, reason). A batch with a format of no weight
    fails as `no weight`, with no sum; one with no input as `no input`. `outputs`: batch,
    format, units, share; `weights`: format, weight; `inputs`: batch, input, allowance.
    Outputs are summed per format before weights are met."""
    made = (outputs.groupBy("batch", "format")
            .agg(F.sum(F.col("units") * F.col("share")).alias("_units"))
            .join(weights, "format", "left")
            .groupBy("batch").agg(F.sum(F.col("_units") * F.col("weight")).alias("out"),
                                  F.count_if(F.col("weight").isNull()).alias("_bare")))
    reason = (F.when(F.col("_bare") > 0, "no weight").when(F.col("input").isNull(), "no input")
              .when(F.col("out") - F.col("allowed") > tolerance, "too much"))
    return (made.join(inputs, "batch", "left")
            .withColumn("allowed", F.col("input") + F.coalesce("allowance", F.lit(0)))
            .withColumn("reason", reason).where("reason IS NOT NULL")
            .select("batch", F.when(F.col("_bare") == 0, F.col("out")).alias("out"),
                    "allowed", "reason"))


def parts_against_total(parts, totals, exempt=None, tolerance=0.005) -> DataFrame:
    """Groups whose parts (key, amount) do not sum to their total (key, total), as (key,
    total, worked, reason). A part without an amount makes its key fail as `no amount`,
    with no sum: what is not priced cannot be checked. Other failures `differ`. Keys in
    `exempt` say so themselves. A key with no parts is not judged."""
    summed = parts.groupBy("key").agg(
        F.sum("amount").alias("worked"), F.count_if(F.col("amount").isNull()).alias("_bare"))
    reason = (F.when(F.col("_bare") > 0, "no amount")
              .when(F.abs(F.col("worked") - F.col("total")) > tolerance, "differ"))
    off = (totals.join(summed, "key").withColumn("reason", reason).where("reason IS NOT NULL")
           .withColumn("worked", F.when(F.col("_bare") == 0, F.col("worked"))))
    if exempt is not None:
        off = off.join(exempt.select("key").distinct(), "key", "left_anti")
    return off.select("key", "total", "worked", "reason")


def below_floor(observed, floors, acknowledged=None) -> DataFrame:
    """Observations (key, kind, amount) under the floor of their kind, unless the key
    is acknowledged."""
    low = observed.join(floors, "kind").where(F.col("amount") < F.col("floor"))
    if acknowledged is not None:
        low = low.join(acknowledged.select("key").distinct(), "key", "left_anti")
    return low


def off_schedule(observed, allowed, acknowledged=None) -> DataFrame:
    """Observations (key, kind, day) of a kind with allowed weekdays (kind, weekday; 1
    is Sunday) that fall on none of them."""
    ruled = allowed.groupBy("kind").agg(F.collect_set("weekday").alias("_days"))
    off = (observed.join(ruled, "kind")
           .where(~F.array_contains("_days", F.dayofweek("day"))).drop("_days"))
    if acknowledged is not None:
        off = off.join(acknowledged.select("key").distinct(), "key", "left_anti")
    return off


def wrong_weekday(df, day, name) -> DataFrame:
    """Rows whose weekday name is not their date's; three letters are enough."""
    stated = F.lower(F.substring(F.col(name), 1, 3))
    actual = F.lower(F.date_format(F.col(day), "EEE"))
    return df.where(F.col(day).isNull() | (stated != actual))


def uncovered(used, known, aliases=None, exempt=None) -> DataFrame:
    """Names used (name) that are not known (name), after aliases (name, target) and
    stated exceptions (name)."""
    loose = used
    if exempt is not None:
        loose = loose.join(exempt.select("name").distinct(), "name", "left_anti")
    if aliases is not None:
        loose = loose.join(aliases, "name", "left").withColumn(
            "target", F.coalesce("target", "name"))
    else:
        loose = loose.withColumn("target", F.col("name"))
    return loose.join(known.select(F.col("name").alias("target")).distinct(), "target",
                      "left_anti")


def orphans(parents, children, exempt=None) -> DataFrame:
    """Parents (key) no child (key) uses and no exemption (key) covers."""
    left = parents.join(children.select("key").distinct(), "key", "left_anti")
    if exempt is not None:
        left = left.join(exempt.select("key").distinct(), "key", "left_anti")
    return left


def stale_exemptions(exempt, parents, children) -> DataFrame:
    """(key, reason) of exemptions that exempt nothing: `unknown` names no parent, `used`
    names one that a child uses after all."""
    return (exempt.select("key").distinct()
            .join(parents.select("key", F.lit(True).alias("_is")).distinct(), "key", "left")
            .join(children.select("key", F.lit(True).alias("_used")).distinct(), "key", "left")
            .select("key", F.when(F.col("_is").isNull(), "unknown")
                    .when(F.col("_used"), "used").alias("reason"))
            .where("reason IS NOT NULL"))


def unmentioned(names, bodies) -> DataFrame:
    """Names (name) that occur in no body (id, text), case aside, as substrings.

    Testing every name on every text would be their product. Cut at single spaces, a name
    of one word occurs inside a word. A longer one occurs exactly where its inner words
    stand as whole words between a word ending in its first and one starting with its
    last. Of these pieces the one that fewest places of the texts hold is the name's
    anchor; the other pieces are tested around the places of the anchor.
    """
    lowered = names.select("name", F.lower("name").alias("_low")).distinct()
    split = lowered.withColumn("_w", F.split("_low", " ")).withColumn("_k", F.size("_w"))
    low = bodies.select(F.split(F.lower("text"), " ").alias("_w"))
    kinds = {r["k"] for r in split.select(F.least("_k", F.lit(2)).alias("k"))
             .distinct().collect()}
    vocabulary = kept(low.select(F.explode("_w").alias("_word")).groupBy("_word")
                      .agg(F.count(F.lit(1)).alias("_n")))
    found = [f(split, low, vocabulary) for k, f in
             ((1, _inside_a_word), (2, _across_words)) if k in kinds]
    if not found:
        return lowered.select("name")
    named = reduce(lambda a, b: a.unionByName(b), found).distinct()
    return lowered.select("name").join(named, "name", "left_anti")


def _inside_a_word(split, low, vocabulary):
    single = split.where("_k = 1")
    # Every piece of a word that is as long as some name.
    pieces = (vocabulary.select("_word", F.explode(_lengths(single, "_low")).alias("_n"))
              .where(F.col("_n") <= F.length("_word"))
              .select("_word", "_n", F.explode(F.sequence(
                  F.lit(1), F.length("_word") - F.col("_n") + 1)).alias("_at"))
              .select(F.col("_word").substr(F.col("_at"), F.col("_n")).alias("_low")))
    return single.join(pieces.distinct(), "_low", "left_semi").select("name")


def _lengths(df, column):
    """All lengths of a column as a literal array: as many as the longest text at most."""
    held = df.select(F.length(column).alias("n")).distinct().collect()
    return F.lit(sorted(r["n"] for r in held) or [0])


def _words_with(pieces, vocabulary):
    """(kind, piece, _word, _n): the words of the texts that a piece fits, each with how
    often it stands there. Only endings and beginnings as long as some piece's are cut."""
    def cut(kind, expression):
        wanted = pieces.where(F.col("kind") == kind).select("piece").distinct()
        return (vocabulary.select("_word", "_n", F.explode(_lengths(wanted, "piece")).alias("_m"))
                .where(F.col("_m") <= F.length("_word"))
                .select("_word", "_n", F.expr(expression).alias("piece"))
                .join(wanted, "piece", "left_semi"))

    whole = vocabulary.join(
        pieces.where("kind = 'whole'").select(F.col("piece").alias("_word")).distinct(),
        "_word", "left_semi").withColumn("piece", F.col("_word"))
    sides = [("whole", whole), ("end", cut("end", "substring(_word, length(_word) - _m + 1)")),
             ("start", cut("start", "substring(_word, 1, _m)"))]
    return reduce(lambda a, b: a.unionByName(b), [
        df.select(F.lit(kind).alias("kind"), "piece", "_word", "_n") for kind, df in sides])


def _fits(word, at, name, size):
    """Whether a word of a text is what a name has at a place."""
    piece = F.get(name, at)
    return (F.when(at == 0, word.endswith(piece)).when(at == size - 1, word.startswith(piece))
            .otherwise(word == piece))


def _across_words(split, low, vocabulary):
    pieces = (split.where("_k >= 2").select("name", "_k", F.posexplode("_w").alias("_at", "piece"))
              .withColumn("kind", F.when(F.col("_at") == 0, "end")
                          .when(F.col("_at") == F.col("_k") - 1, "start").otherwise("whole")))
    fitting = kept(_words_with(pieces, vocabulary))
    often = fitting.groupBy("kind", "piece").agg(F.sum("_n").alias("_often"))
    # A name with a piece that fits nowhere is nowhere.
    counted = pieces.join(often, ["kind", "piece"], "left").withColumn(
        "_often", F.coalesce("_often", F.lit(0)))
    anchors = (counted.groupBy("name").agg(F.min(F.struct("_often", "_at", "kind", "piece"))
                                           .alias("_a"))
               .where("_a._often > 0").select("name", "_a._at", "_a.kind", "_a.piece"))
    anchored = kept(anchors.join(fitting, ["kind", "piece"]).join(
        split.select("name", F.col("_w").alias("_name"), "_k"), "name")
        .select("_word", "name", "_at", "_name", "_k"))

    # Each word with its neighbours: most places of an anchor are settled by them alone.
    beside = F.arrays_zip(
        F.col("_w").alias("_word"),
        F.concat(F.array(F.lit(None).cast("string")), "_w").alias("_before"),
        F.concat(F.expr("slice(_w, 2, size(_w))"), F.array(F.lit(None).cast("string")))
        .alias("_after"))
    places = low.select(F.xxhash64("_w").alias("_text"), F.posexplode(beside).alias("_p", "_z")) \
        .where("_z._word is not null").select("_text", "_p", "_z.*")
    at, size = F.col("_at"), F.col("_k")
    hits = (places.join(anchored, "_word").where(
        ((at == 0) | _fits(F.col("_before"), at - 1, "_name", size))
        & ((at == size - 1) | _fits(F.col("_after"), at + 1, "_name", size)))
        .select("name", "_name", "_k", "_at", "_text", (F.col("_p") - at).alias("_first"))
        .distinct())
    hits = kept(hits.where("_first >= 0"))
    settled = (at <= 1) & (size - 1 - at <= 1)
    sure = hits.where(settled).select("name")
    # A text meets all its open places at once, and only if it has one.
    open_ = (hits.where(~settled).join(sure.distinct(), "name", "left_anti").groupBy("_text")
             .agg(F.collect_set(F.struct("name", "_name", "_k", "_first")).alias("_open")))
    tested = F.filter("_open", lambda h: (
        (F.slice("_w", h["_first"] + 2, h["_k"] - 2) == F.slice(h["_name"], F.lit(2), h["_k"] - 2))
        & F.get("_w", h["_first"]).endswith(F.get(h["_name"], F.lit(0)))
        & F.get("_w", h["_first"] + h["_k"] - 1).startswith(F.get(h["_name"], h["_k"] - 1))))
    rest = (low.withColumn("_text", F.xxhash64("_w")).join(open_, "_text")
            .select(F.explode(tested).alias("_h")).select("_h.name"))
    return sure.unionByName(rest).distinct()


def incomplete(df, key, required: dict) -> DataFrame:
    """(key, missing): rows whose column is NULL, blank, a dash, or not matching the
    pattern given for it. `required` maps column -> pattern or None."""
    def lacks(column, pattern):
        text = F.trim(F.col(column).cast("string"))
        bad = text.isNull() | text.isin("", "-", "—")
        return bad | ~text.rlike(pattern) if pattern else bad

    gaps = F.array(*[F.when(lacks(c, p), F.lit(c)) for c, p in required.items()])
    return (df.select(F.col(key).alias("key"), F.explode(gaps).alias("missing"))
            .where("missing IS NOT NULL"))


def childless(parents, children, key) -> DataFrame:
    return parents.join(children.select(key).distinct(), key, "left_anti")


def outside_vocabulary(df, column, words=None, pattern=None, dash=True) -> DataFrame:
    """Rows whose cell is neither one of the words, nor matches the pattern, nor is a
    dash where one is allowed; NULL fails."""
    text = F.col(column).cast("string")
    fine = F.lit(False)
    if words is not None:
        fine = fine | text.isin(list(words))
    if pattern is not None:
        fine = fine | text.rlike(pattern)
    if dash:
        fine = fine | (text == "—")
    return df.where(~F.coalesce(fine, F.lit(False)))


def sold_nowhere(prices, key, price) -> DataFrame:
    """Keys with no price in any row."""
    return (prices.groupBy(key).agg(F.count(F.col(price)).alias("_n"))
            .where("_n = 0").select(key))


def forbidden_phrases(texts, key, phrases) -> DataFrame:
    """(key, line, phrase): every line on which a phrase pattern occurs, case aside."""
    lines = texts.select(F.col(key).alias("key"),
                         F.posexplode(F.split("text", "\n")).alias("_n", "_line"))
    hits = F.array(*[F.when(F.col("_line").rlike("(?i)" + p), F.lit(p)) for p in phrases])
    # One alternation settles most lines before the phrases are tried apart.
    some = F.col("_line").rlike("(?i)" + "|".join(f"(?:{p})" for p in phrases))
    return (lines.where(some)
            .select("key", (F.col("_n") + 1).cast("bigint").alias("line"),
                    F.explode(hits).alias("phrase")).where("phrase IS NOT NULL"))


def unique_violations(df, keys) -> DataFrame:
    """Key values held by more than one row, with how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def summary(checks) -> DataFrame:
    """(check, counted, failed, ok) of (name, rows looked at, failures) triples."""
    def one(name, counted, failed):
        return (counted.agg(F.count(F.lit(1)).alias("n"))
                .select(F.lit(name).alias("check"), F.col("n").alias("counted"),
                        F.lit(0).cast("bigint").alias("failed"))
                .unionByName(failed.agg(F.count(F.lit(1)).alias("n"))
                             .select(F.lit(name).alias("check"),
                                     F.lit(0).cast("bigint").alias("counted"),
                                     F.col("n").alias("failed"))))

    rows = reduce(lambda a, b: a.unionByName(b), [one(*c) for c in checks])
    return (rows.groupBy("check").agg(F.sum("counted").alias("counted"),
                                      F.sum("failed").alias("failed"))
            .withColumn("ok", F.col("failed") == 0))


# ---- comparing two reads --------------------------------------------------

def differing_cells(left, right, key) -> DataFrame:
    """(key, column, left_value, right_value) wherever two tables disagree, rows present
    on one side only included."""
    columns = [c for c in left.columns if c != key]

    def packed(df, name):
        return df.select(F.col(key), F.struct(*[F.col(c).cast("string").alias(c)
                                                for c in columns]).alias(name))

    met = packed(left, "_l").join(packed(right, "_r"), key, "full_outer")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_l.{c}").alias("left_value"),
                               F.col(f"_r.{c}").alias("right_value")) for c in columns])
    return (met.where(~F.col("_l").eqNullSafe(F.col("_r")))
            .select(key, F.explode(cells).alias("c")).select(key, "c.*")
            .where(~F.col("left_value").eqNullSafe(F.col("right_value"))))


def same_rows(left, right, name="same_rows") -> DataFrame:
    """(check, counted, failed): rows of either side the other lacks, duplicates
    counted. One grouping of the two sides together, no join."""
    columns = left.columns
    both = (left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
            .unionByName(right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))))
    per_row = both.groupBy(*columns).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    return per_row.agg(F.lit(name).alias("check"),
                       F.coalesce(F.sum("_l"), F.lit(0)).alias("counted"),
                       F.coalesce(F.sum(F.abs(F.col("_l") - F.col("_r"))), F.lit(0))
                       .alias("failed"))


def same_results(left, right, name="same_results", buckets=4096) -> DataFrame:
    """`same_rows` of two runs too large to be written down or moved: rows are counted and
    digested by SHA-256 where they are made, in buckets by their hash. Only rows of buckets
    whose digests differ are compared, one by one."""
    def bucketed(df):
        return df.withColumn("_bucket", F.pmod(F.xxhash64(*left.columns), F.lit(buckets)))

    def noted(df):
        return kept(multiset(bucketed(df), "_bucket", columns=left.columns))

    ours, theirs = noted(left), noted(right.select(*left.columns))
    same = ["_bucket", "rows", *PARTS]
    doubted = kept(ours.select(*same).unionByName(theirs.select(*same)).groupBy(*same)
                   .agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select("_bucket").distinct())
    counted = ours.agg(F.lit(name).alias("check"), F.coalesce(F.sum("rows"), F.lit(0))
                       .alias("counted"))
    if doubted.isEmpty():
        return counted.withColumn("failed", F.lit(0).cast("bigint"))
    differing = same_rows(*[bucketed(df).join(doubted, "_bucket", "left_semi").select(*left.columns)
                            for df in (left, right)])
    return counted.withColumn("failed", differing.select("failed").scalar())


def fingerprint(df) -> DataFrame:
    """Row count and an order-free digest, to tell whether two runs gave the same."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))

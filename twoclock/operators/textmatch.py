"""Which paragraph speaks of a thing, weighed by how rare its words are."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import SHORTEST_WORD, words
from ..session import kept

# Fixed value: what a word of the name counts against one of the description.
NAME_WEIGHT = 6
# Scores are sums of weight / paragraphs-with-the-word. Whole units of 1e-12 add up
# the same in any order, so equal paragraphs tie exactly.
UNIT = 1_000_000_000_000
# Fixed value: every white-space character, as a regular-expression class body.
SPACE = (r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
         r"\x{202f}\x{205f}\x{3000}")


def paragraphs(texts, key="doc_id") -> DataFrame:
    """(key, position, paragraph): blocks between blank lines, trimmed, empty ones
    dropped and positions counted over what is left."""
    blocks = F.filter(F.transform(F.split("text", rf"\n[{SPACE}]*\n"),
                                  lambda b: F.regexp_replace(
                                      b, rf"^[{SPACE}]+|[{SPACE}]+$", "")),
                      lambda b: b != "")
    return texts.select(key, F.posexplode(blocks).alias("position", "paragraph")) \
        .withColumn("position", F.col("position").cast("bigint"))


def wanted_words(subjects) -> DataFrame:
    """(key, word, weight) of subjects (key, name, description): each word of the name
    counts six, each distinct word of the description one more."""
    terms = (subjects.select("key", F.explode(words(F.col("name"))).alias("word"),
                             F.lit(NAME_WEIGHT).alias("weight"))
             .unionByName(subjects.select(
                 "key", F.explode(F.array_distinct(words(F.col("description")))).alias("word"),
                 F.lit(1).alias("weight"))))
    return terms.groupBy("key", "word").agg(F.sum("weight").alias("weight"))


def word_starts(texts, vocabulary, longest) -> DataFrame:
    """(index, word) for every vocabulary word some token of the paragraph starts with.

    Tokens are made distinct inside the row. Of all distinct tokens, those that start with
    a vocabulary word are found once; a token then meets its words in one step, wherever
    it stands."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    spots = (texts.select("index", F.explode(tokens).alias("token"))
             .where(F.length("token") >= SHORTEST_WORD))
    starts = (spots.select("token").distinct()
              .select("token", F.explode(F.sequence(
                  F.lit(SHORTEST_WORD), F.least(F.length("token"), F.lit(longest)))).alias("n"))
              .select("token", F.expr("substring(token, 1, n)").alias("word"))
              .join(vocabulary, "word", "left_semi"))
    return spots.join(kept(starts), "token").select("index", "word").distinct()


def _bounds(terms):
    """Adds `_first`, the units of a subject's weightiest word, and `_rest`, those of a
    word and all that weigh less together: the most a paragraph can score that holds
    none of the weightier ones."""
    along = W.partitionBy("key").orderBy(F.col("units").desc(), "word")
    return terms.withColumns({
        "_first": F.first("units").over(along),
        "_rest": F.sum("units").over(along.rowsBetween(0, W.unboundedFollowing))})


def best_paragraph(subjects, texts) -> DataFrame:
    """(key, index, score): the best-scoring paragraph of `texts` (index, text) for each
    subject, the lowest index on a tie, NULL where no word is found.

    A word is worth its weight in the subject by the paragraphs that hold it, so a common
    word is worth little and has long postings. A subject's words are taken by worth. Some
    paragraph holds the first one, so the best scores at least its worth; once the words
    that are left come to less together, a paragraph that holds only those cannot be best,
    and their postings are not opened. Paragraphs found by the words before are scored in
    part, and only those that the words left could lift to the best part score are
    completed, by looking those words up in them. The answer is exact.
    """
    wanted = wanted_words(subjects)
    vocabulary = wanted.select("word").distinct()
    longest = vocabulary.agg(F.max(F.length("word"))).head()[0] or SHORTEST_WORD
    # Read several times below: texts are cut into words once, and the pairs kept.
    held = kept(word_starts(texts, vocabulary, longest))
    common = held.groupBy("word").agg(F.count(F.lit(1)).alias("_df"))
    terms = kept(_bounds(wanted.join(common, "word").select(
        "key", "word", F.expr(f"weight * {UNIT} div _df").alias("units"))))
    opened = terms.where("_rest >= _first").select("key", "word", "units")
    closed = terms.where("_rest < _first")

    partial = kept(opened.join(held, "word").groupBy("key", "index")
                   .agg(F.sum("units").alias("units")))
    best = (partial.groupBy("key").agg(F.max("units").alias("_best"))
            .join(closed.groupBy("key").agg(F.max("_rest").alias("_rest")), "key", "left"))
    near = kept(partial.join(best, "key").where("units + coalesce(_rest, 0) >= _best")
                .select("key", "index", "units"))
    added = (near.select("key", "index").join(closed.select("key", "word", "units"), "key")
             .join(held, ["index", "word"]).select("key", "index", "units"))
    scored = near.unionByName(added).groupBy("key", "index").agg(F.sum("units").alias("units"))
    top = scored.groupBy("key").agg(
        F.max(F.struct("units", (-F.col("index")).alias("_minus"))).alias("_t"))
    return (subjects.select("key").join(top, "key", "left")
            .select("key", (-F.col("_t._minus")).alias("index"),
                    F.round(F.col("_t.units") / UNIT, 9).alias("score")))

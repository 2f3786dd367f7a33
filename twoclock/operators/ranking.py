"""Positions inside groups of any size.

A window over a whole group puts the group in one task. Here the order is first cut into
ranges at splitters drawn from the data: whole sort keys, of any types and lengths, so
texts that differ after a long common beginning are told apart like any others. Each range
of a group is ranked on its own, and the sizes of its earlier ranges are added. Splitters
are literals by the time rows are assigned, so every pass cuts the same way.
"""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Sampled keys for each range; ranges then differ in size by little.
_DRAWN = 50


def splitters(df, order, pieces):
    """At most `pieces` - 1 sort keys of the data that cut it into ranges of about one
    size, ascending: every so manieth of a sample of about 50 keys a range."""
    rows = df.select(*[F.col(c).alias(f"k{n}") for n, c in enumerate(order)])
    total = rows.count()
    share = _DRAWN * pieces / total if total else 1.0
    drawn = rows if share >= 1 else rows.sample(share, seed=17)
    names = rows.columns
    whole = drawn.orderBy(*names).collect()
    found = []
    for k in range(1, pieces):
        at = k * len(whole) // pieces
        if at < len(whole) and (not found or whole[at] != found[-1]):
            found.append(whole[at])
    return found


def _with_below(df, key, values, name):
    """Adds how many of the ascending columns `values` are less than `key`: a binary
    search of a constant array, one projection a step, so the plan grows with the
    logarithm of the splitters and so does the work a row costs."""
    df = df.withColumn(name, F.lit(0))
    if not values:
        return df
    table = F.array(*values)
    step = 1 << (len(values).bit_length() - 1)
    while step:
        # Past the end there is nothing less.
        further = F.coalesce(F.get(table, F.col(name) + (step - 1)) < key, F.lit(False))
        df = df.withColumn(name, F.col(name) + F.when(further, step).otherwise(0))
        step //= 2
    return df


def with_piece(df, order, pieces, name="_piece"):
    """Adds the number of the range each row falls in; ranges follow `order`. Rows with
    equal whole keys fall in one."""
    types = [df.schema[c].dataType for c in order]
    values = [F.struct(*[F.lit(bytes(v) if isinstance(v, bytearray) else v).cast(t).alias(f"k{n}")
                         for n, (v, t) in enumerate(zip(row, types, strict=True))])
              for row in splitters(df, order, pieces)]
    key = F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(order)])
    return _with_below(df, key, values, name)


def position(df, keys, order, name="position", start=1, pieces=None):
    """1, 2, 3 … (from `start`) within `keys` by `order`, a list of column names
    ascending. With no keys, one dense numbering of the whole frame."""
    spark = df.sparkSession
    pieces = pieces or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = with_piece(df, order, pieces)
    at = [*keys, "_piece"]
    sizes = cut.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        earlier = (sizes.withColumn("_before", F.coalesce(F.sum("_n").over(
            W.partitionBy(*keys).orderBy("_piece")
            .rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n"))
        placed = _null_safe_join(cut, earlier, at)
        before = F.col("_before")
    else:
        # One row per piece, and the number of pieces is fixed above.
        running, table = 0, {}
        for piece, n in sorted((r["_piece"], r["_n"]) for r in sizes.collect()):
            table[piece] = running
            running += n
        placed = cut
        before = F.coalesce(F.get(F.array(*[F.lit(table.get(p, 0)).cast("bigint") for p in range(
            max(table, default=0) + 1)]), F.col("_piece")), F.lit(0))
    within = F.row_number().over(W.partitionBy(*at).orderBy(*order))
    return (placed.withColumn(name, (within + before + F.lit(start - 1)).cast("bigint"))
            .drop("_piece", "_before"))


def running_max_before(df, keys, order, value, name, pieces=None):
    """Largest `value` among the rows that come earlier in the group, NULL for the
    first; same cutting as `position`."""
    spark = df.sparkSession
    pieces = pieces or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = with_piece(df, order, pieces)
    at = [*keys, "_piece"]
    tops = cut.groupBy(*at).agg(F.max(value).alias("_top"))
    earlier = tops.withColumn("_sofar", F.max("_top").over(
        W.partitionBy(*keys).orderBy("_piece")
        .rowsBetween(W.unboundedPreceding, -1))).drop("_top")
    here = F.max(value).over(W.partitionBy(*at).orderBy(*order)
                             .rowsBetween(W.unboundedPreceding, -1))
    return (_null_safe_join(cut, earlier, at)
            .withColumn(name, F.greatest(here, F.col("_sofar")))
            .drop("_piece", "_sofar"))


def _null_safe_join(left, right, on):
    """Left join with NULL keys meeting; plans as an equi-join."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c)
                             for c in right.columns])
    cond = None
    for c in on:
        here = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = here if cond is None else cond & here
    return left.join(renamed, cond, "left").drop(*[f"_r_{c}" for c in on])
